"""Personal data in disguise, found on a normalised text and marked on the original one.

A transducer rewrites a text step by step - look-alike characters, spelled digits,
written-out at and dot - and keeps for every character of its output the span of the
source it came from. Identifiers are looked for in the source as it is (the base
spans) and in the output; what only the output shows is mapped back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the identifiers in a text as it stands, by start, then kind."""
    found = []
    last = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                found.append((start, 0, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# Digits as words, by language, from 0 to 9.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
MORE_DIGIT_WORDS = {"oh": "0", "zwo": "2", "fuenf": "5", "zero": "0"}
# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТХУ": "ABESIJKMHOPCTXY",
    "авеѕіјкмнорстхуԁԛԝһ": "abesijkmhopctxydqwh",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "αιοκνρυχ": "aioknpux",
    "‐‑‒–—―−﹣－": "---------",
    "․。．｡": "....",
    "﹫＠": "@@",
    "﹢＋": "++",
}
_UNSEEN = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"

_WORDS = {w: str(n) for words in DIGIT_WORDS.values() for n, w in enumerate(words.split())} | MORE_DIGIT_WORDS
_ONE = "|".join(sorted(_WORDS, key=lambda w: (-len(w), w)))
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_DOT_WORD, _AT_WORD = "(?:dot|punkt|point|punto)", "(?:at|ät|arroba|arobase)"
_SHY_DOT = rf"(?:{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}|\s{{1,3}}dot\s{{1,3}})"
_BRACKETED = re.compile(rf"[\[({{<]\s{{0,3}}(?:{_AT_WORD}|@|{_DOT_WORD}|\.)\s{{0,3}}[\])}}>]", re.I)
_LOOSE_AT = re.compile(r"\s@|@\s")
_FIGURE = re.compile(r"[0-9][OolI]|[OolI][0-9]")
_SIGN_WORD = re.compile(rf"\s(?:{_DOT_WORD}|ät|arroba|arobase)\s", re.I)
_WORD = re.compile(r"\w+")
_LATIN_ALIKE = re.compile("[\xa0\xad\xb2\xb3\xb9]")


def disguised(text: str) -> bool:
    """Whether some rule for written-out signs or digits may apply: cheap, and true too often rather than too rarely.

    No rule rewrites a text for which this is false: each needs a bracketed sign, a loose @ or dot, a word for
    one between spaces, a letter beside a figure, or two digit words, alike or not, each a whole word.
    """
    if any(c in text for c in "[({<") and _BRACKETED.search(text):
        return True
    if " . " in text or _SIGN_WORD.search(text) or "@" in text and _LOOSE_AT.search(text):
        return True
    if _DIGIT.search(text) and _FIGURE.search(text):
        return True
    words = _WORD.findall(text.lower())
    known = _WORDS.keys() & set(words)
    return len(known) > 1 or any(words.count(w) > 1 for w in known)


@cache
def _alike() -> tuple[dict[int, str], re.Pattern]:
    """What each look-alike character stands for, nothing for unseen ones; a pattern that finds one."""
    table = {ord(a): b for many, plain in LOOK_ALIKES.items() for a, b in zip(many, plain, strict=True)}
    table |= dict.fromkeys(map(ord, _UNSEEN), "")
    for block in ((0x2070, 0x20A0), (0x2460, 0x24FF), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x00B2, 0x00BA)):
        for c in range(*block):
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1 and "!" <= plain <= "~":
                table.setdefault(c, plain)
    for c in range(0x660, 0x1D800):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            table.setdefault(c, str(d))
    for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        table.setdefault(c, " ")
    return table, re.compile("[" + "".join(map(re.escape, map(chr, sorted(table)))) + "]")


class Rewriting:
    """A text under rewriting, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def apply(self, pattern: re.Pattern, replace) -> None:
        """Replace what ``pattern`` finds by replace(match), None leaves it; one output character maps to the whole match."""
        pieces, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            if (new := replace(m)) is None or new == m.group():
                continue
            if self.start is None:
                self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
            a, b = m.span()
            pieces += self.text[at:a], new
            starts += self.start[at:a]
            ends += self.end[at:a]
            if new and len(new) == b - a:
                starts += self.start[a:b]
                ends += self.end[a:b]
            elif new:
                starts += [self.start[a]] * len(new)
                ends += [self.end[b - 1]] * len(new)
            at = b
        if at:
            self.text = "".join([*pieces, self.text[at:]])
            self.start, self.end = starts + self.start[at:], ends + self.end[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


_RUN_DIGIT = rf"(?:(?:double|triple)\s{{1,3}})?(?:{_ONE}|[0-9]+)\b"
_DIGIT_RUN = re.compile(rf"\b(?:plus\s{{1,3}})?{_RUN_DIGIT}(?:[\s,-]{{1,3}}(?:{_DOT_WORD}[\s,-]{{1,3}})?{_RUN_DIGIT})*", re.I)
_RUN_PART = re.compile(rf"plus|double|triple|{_DOT_WORD}|{_ONE}|[0-9]+", re.I)
_OCTETS = re.compile(r"(?<=[0-9])\s{1,3}(?:dot|punkt|point|punto)\s{1,3}(?=[0-9])", re.I)
_MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OolI]*[0-9][0-9OolI]*(?![A-Za-z0-9])")
_RULES_AT = re.compile(rf"(?<=[A-Za-z0-9]){_OPEN}(?:{_AT_WORD}|@){_CLOSE}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\s{{1,3}}at\s{{1,3}}(?=[A-Za-z0-9-]{{1,63}}{_SHY_DOT}[A-Za-z0-9])", re.I)
# Words that stand for nothing else where a domain follows; "at" does only before a disguised dot. "point" is an
# ordinary word after "at this", so there it needs a top-level domain after it.
_LABEL, _END = "[A-Za-z0-9-]{1,63}", r"(?![A-Za-z0-9-])"
_FIRM_AT = r"\s{1,3}(?:ät|arroba|arobase)\s{1,3}"
_BARE_DOT = rf"\s{{1,3}}{_DOT_WORD}\s{{1,3}}"
_ANY_DOT = rf"(?:{_SHY_DOT}|{_BARE_DOT}|\.| \. )"
_TOP = rf"(?:com|org|net|edu|gov|info|biz|eu|fr|ch|de|uk){_END}"
_WORD_AT = re.compile(
    rf"(?<=[A-Za-z0-9]){_FIRM_AT}(?={_LABEL}{_ANY_DOT}[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9])\s{{1,3}}at\s{{1,3}}(?={_LABEL}(?:\s{{1,3}}(?:punkt|punto)\s{{1,3}}[A-Za-z0-9]|(?:\s{{1,3}}point\s{{1,3}}{_LABEL}){{0,4}}\s{{1,3}}point\s{{1,3}}{_TOP}))",
    re.I,
)
_NAME = "[A-Za-z0-9._%+-]"
_WORD_LOCAL = re.compile(rf"(?<!{_NAME}){_NAME}{{1,64}}(?:{_BARE_DOT}{_NAME}{{1,64}}){{1,8}}(?={_FIRM_AT}{_LABEL}{_ANY_DOT}[A-Za-z0-9])", re.I)
_WORD_DOMAIN = re.compile(rf"(?<=[A-Za-z0-9])@{_LABEL}(?:(?:{_SHY_DOT}|{_BARE_DOT}){_LABEL})+", re.I)
_SEPARATOR = re.compile(rf"{_SHY_DOT}|{_BARE_DOT}", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\s{0,3}@\s{0,3}(?=[A-Za-z0-9])")
_RULES_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_SHY_DOT}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9]) \. (?=[A-Za-z0-9])", re.I)


def _digits(m: re.Match) -> str | None:
    parts = [p.lower() for p in _RUN_PART.findall(m.group())]
    if sum(p in _WORDS for p in parts) < 2:
        return None
    out, times = [], 1
    for p in parts:
        if p == "plus":
            out.append("+")
        elif p in ("dot", "punkt", "point", "punto"):
            out.append(".")
        elif p in ("double", "triple"):
            times = 2 if p == "double" else 3
        else:
            out.append(_WORDS.get(p, p) * times)
            times = 1
    return "".join(out)


_FIGURES = str.maketrans("OolI", "0011")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def normalise(text: str) -> Rewriting:
    """The text with disguises taken off, and the way back."""
    r = Rewriting(text)
    if not text.isascii() and not (_latin(text) and not _LATIN_ALIKE.search(text)):
        table, pattern = _alike()
        r.apply(pattern, lambda m: table[ord(m.group())])
    if disguised(r.text):
        r.apply(_MIXED, lambda m: m.group().translate(_FIGURES) if sum(map(str.isdigit, m.group())) * 2 > len(m.group()) >= 3 else None)
        r.apply(_DIGIT_RUN, _digits)
        r.apply(_OCTETS, lambda m: ".")
        if _SIGN_WORD.search(r.text):
            r.apply(_WORD_LOCAL, lambda m: _SEPARATOR.sub(".", m.group()))
            r.apply(_WORD_AT, lambda m: "@")
        r.apply(_RULES_AT, lambda m: "@")
        r.apply(_SPACED_AT, lambda m: "@")
        r.apply(_WORD_DOMAIN, lambda m: _SEPARATOR.sub(".", m.group()))
        r.apply(_RULES_DOT, lambda m: ".")
    return r


def pii_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the method adds: none that lies within a base span of its kind."""
    base = identifiers(text)
    r = normalise(text)
    if r.start is None:
        return base, []
    known = {(k, i) for s, k, e in base for i in (s, e)}
    added = []
    for a, kind, b in identifiers(r.text):
        start, end = r.source(a, b)
        if (kind, start) in known and (kind, end) in known or any(k == kind and s <= start and end <= e for s, k, e in base):
            continue
        added.append((start, kind, end))
    return base, added


def render(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with what was found in the whole text.

    n_email, n_ip, n_card and n_phone count the base spans, base_sha256 is their digest;
    spans lists base and added spans as kind:start:end by start, then kind, in code points
    with the end left out; n_added counts the added ones. A null text is an empty one and
    has no spans; repeated rows are each returned; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, added = pii_spans(text or "")
                n = [sum(k == i for _, k, _ in base) for i in range(4)]
                rows.append((*n, hashlib.sha256(render(base).encode()).hexdigest(), render(sorted({*base, *added})), len(added)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str) -> str:
    """The text with each found span replaced by its kind; spans that overlap are replaced together."""
    base, added = pii_spans(text)
    out, at, open_end = [], 0, 0
    for s, k, e in sorted({*base, *added}):
        if s < open_end:
            at = open_end = max(open_end, e)
            continue
        out += text[at:s], f"[{KINDS[k].upper()}]"
        at = open_end = e
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; all else as it is, null texts stay null.

    n_chars, where there is such a column, is counted anew for texts that change.
    """

    def run(batches):
        for batch in batches:
            old = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([None if t is None else mask(t) for t in old], pa.string()), *batch.columns[1:]], names)

    small_batches(docs.sparkSession)
    names = ["text", *(c for c in docs.columns if c != "text")]
    new = docs.select(names)
    masked = new.mapInArrow(run, new.schema)
    if "n_chars" in names:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)

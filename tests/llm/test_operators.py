"""Each corpus operator against brute force, and on the cases that break things: nulls, empty and long texts, repeats, no rows, extra columns."""

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from specweave.llm import chat, components, decontamination, kneser_ney, language_id, mixing, nearest, pii, quality, simhash, suffix_dedup, url_filter
from specweave.llm.common import flat, held_bytes

DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:4] for r in rows], DOCS)


def words(n, seed, alphabet="abcdefg", length=5):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, length))) for _ in range(n))


#: Extra columns whose names clash with those that operators use inside.
CLASHING = ("h", "fp", "row", "size", "key", "block", "data", "component", "target", "rule", "cost", "part", "message")


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


# --- components --------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 decontamination ---------------------------------------------------------------------------


def distance(item, text):
    """Least edits of item against any stretch of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    items = [(i, words(rng.randint(8, 40), i)) for i in range(12)] + [(90, "too short"), (91, None), (92, "Same, as: " + words(20, 3)), (93, words(20, 3))]
    rows = [(1, None), (2, ""), (3, "x" * 20_000), (4, words(3000, 77))]
    for k in range(60):
        i, item = items[rng.randrange(12)]
        chars = list(item)
        for _ in range(rng.randint(0, len(chars) // 8)):
            p = rng.randrange(len(chars))
            chars[p : p + 1] = rng.choice([[], ["q"], [chars[p], "z"]])
        rows.append((100 + k, words(30, k) + ". " + "".join(chars).upper() + "! " + words(30, -k)))
    rows.append(rows[-1])
    d, b = clash(docs(spark, rows)), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontamination.find_leaks(d, b).collect())
    index = decontamination.build_index(items)
    want = []
    for doc, text in rows:
        if text and len(text) < 10_000:
            n = decontamination.normalised(text)
            for i, item, k in zip(index.ids, index.items, index.budget.tolist(), strict=True):
                if (e := distance(item, n)) <= k:
                    want.append((doc, i, e))
    assert got == sorted(want) and len(got) > 30
    # in blocks of items, the same
    again = decontamination.find_leaks(d, b, block_bytes=300)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in again.collect()) == got
    kept = {r.doc_id for r in decontamination.drop_leaks(d, b).collect()}
    assert kept == {r[0] for r in rows} - {g[0] for g in got}
    one = decontamination.find_leaks(docs(spark, [(7, "é!! " + items[0][1] + " end")]), b).first()
    assert (one.start, one.end) == (4, 4 + len(items[0][1]))
    none = decontamination.find_leaks(docs(spark, []), b)
    assert none.count() == 0 and decontamination.find_leaks(d, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_a_word_in_ten_replaced_and_short_items(spark):
    item = words(60, 5)
    chars = list(item)
    for p in range(5, len(chars), 11):
        chars[p] = "q"
    assert 0.085 * len(item) < sum(a != b for a, b in zip(chars, item, strict=True)) <= 0.1 * len(item)
    items = [(1, item), (2, "Paris!"), (3, "the long road"), (4, "no"), (5, "?!"), (6, "東京"), (7, "seven b"), (8, "12345678"), (9, "no")]
    rows = [(1, "x " + "".join(chars) + " y"), (2, "in Paris, they"), (3, "The long\troad."), (4, "comparison nothing parisian along the long roads"), (5, "No; 私は東京に住む"), (6, "seven-b 12345678"), (7, "seven bb 123456789"), (8, ""), (9, "paris")]
    for some in (items, items[1:2], items[4:5], items[3:4]):
        named = {i for i, _ in some}
        b = spark.createDataFrame(some, "item_id long, text string")
        got = sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(docs(spark, rows), b).collect())
        assert got == [g for g in [(1, 1), (2, 2), (3, 3), (5, 4), (5, 6), (5, 9), (6, 7), (6, 8), (9, 2)] if g[1] in named]
        assert {r.doc_id for r in decontamination.drop_leaks(docs(spark, rows), b).collect()} == {r[0] for r in rows} - {d for d, _ in got}


# --- 2 personal data --------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "..", "0", " ", "é", "-", "1", "256", "@@a.b", "%_+"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert pii.identifiers(text) == base_spans(text), text
    for text in ("9" * 5000, "1." * 3000, "+1" + "(" * 4000, "a@" * 3000, "a" * 5000 + "@b.c"):
        assert pii.identifiers(text) == base_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"), ("bob at example dot co dot uk!", "email", "bob at example dot co dot uk"),
        ("a.b (at) mail.example.org", "email", "a.b (at) mail.example.org"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("x @ y . org", "email", "x @ y . org"),
        ("plus one two one two five five five zero one nine nine ok", "phone", "plus one two one two five five five zero one nine nine"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"), ("192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
        ("card ４５３９１４８８０３４３６４６７.", "card", "４５３９１４８８０３４３６４６７"), ("4539 1488 O343 6467", "card", "4539 1488 O343 6467"),
        ("vier fünf drei neun eins vier acht acht null drei vier drei sechs vier sechs sieben", "card", "vier fünf drei neun eins vier acht acht null drei vier drei sechs vier sechs sieben"),
    ],
)
def test_disguises_map_back(text, kind, found):
    base, added = pii.pii_spans(text)
    assert not base
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in added] == [(kind, found)]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("ip 192 punkt 168 punkt 1 punkt 20 ok", "ip", "192 punkt 168 punkt 1 punkt 20"), ("192 Point 168 POINT 1 point 20", "ip", "192 Point 168 POINT 1 point 20"), ("192 punto 168 punto 1 punto 20", "ip", "192 punto 168 punto 1 punto 20"),
        ("192 dOt 168 dOt 1 dOt 20", "ip", "192 dOt 168 dOt 1 dOt 20"), ("x john.smith@example . com", "email", "john.smith@example . com"),
        ("call plus four four four four four four four four four four now", "phone", "plus four four four four four four four four four four"),
        ("(plus acht acht acht acht acht acht acht acht acht acht)", "phone", "plus acht acht acht acht acht acht acht acht acht acht"),
        ("(null 1 2 3 4 5 6 7 8 9 1 2 3 4 null)", None, None), ("(four 539 1488 0343 646 seven)", "card", "four 539 1488 0343 646 seven"), ("1O0.0.0.1", "ip", "1O0.0.0.1"), ("a@ b.org", "email", "a@ b.org"),
        ("de ana arroba ejemplo punto com", "email", "ana arroba ejemplo punto com"), ("ana punto ruiz arroba mail punto ejemplo punto com", "email", "ana punto ruiz arroba mail punto ejemplo punto com"),
        ("jean arobase exemple point fr", "email", "jean arobase exemple point fr"), ("jean arobase exemple.fr", "email", "jean arobase exemple.fr"), ("jean at exemple point co point fr ici", "email", "jean at exemple point co point fr"),
        ("max ät beispiel punkt de", "email", "max ät beispiel punkt de"), ("max at beispiel punkt de", "email", "max at beispiel punkt de"), ("max@beispiel punkt de", "email", "max@beispiel punkt de"),
        ("ana [arroba] ejemplo punto com", "email", "ana [arroba] ejemplo punto com"), ("ana@mail dot ejemplo punto com", "email", "ana@mail dot ejemplo punto com"),
    ],
)
def test_each_rule_alone_passes_the_gate(text, kind, found):
    base, added = pii.pii_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in added if (k, s, e) not in base] == ([(kind, found)] if kind else [])


def test_no_rule_rewrites_what_the_gate_stops(monkeypatch):
    rng = random.Random(22)
    pieces = ["four", "Oh", "acht", "plus", "double", "dot", "Punkt", "punto", "point", "DOT", "at", "ät", "arroba", "arobase", "@", ".", " . ", "[", "(", ")", "]", "192", "1O", "l", "x", "ejemplo", "com", "-", ",", "/", "_", "é"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(rng.randint(1, 7))) for _ in range(20_000)]
    stopped = [t for t in texts if not pii.disguised(t)]
    monkeypatch.setattr(pii, "disguised", lambda text: True)
    assert len(stopped) > 1000 and not [t for t in stopped if pii.normalise(t).text != t]


def test_ordinary_uses_of_sign_words_add_nothing():
    for text in ("look at this point we see", "at some point he left", "media arroba de trigo", "en este punto ana@ejemplo.com", "contact point bob@example.com point it out", "joe@x.com punto y aparte", "am Punkt 3", "3 punto 14"):
        assert not pii.pii_spans(text)[1], text


def test_clean_texts_have_nothing_added():
    for text in ("We met at noon. The dot com era began at home.", "un deux trois", "room 101 at 5", "a (at) b", "10O1", "", "The at of dot."):
        assert pii.pii_spans(text) == ([], [])


def test_pii_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.co and x [at] y [dot] org"), (3, "a@b.co and x [at] y [dot] org"), (4, "z" * 100_000)]
    got = sorted(map(tuple, pii.find_pii(clash(docs(spark, rows))).collect()))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0][:7] == (1, 0, 0, 0, 0, empty, "") and got[1][5] == empty and got[4][6] == ""
    assert got[2] == got[3] == (3, 1, 0, 0, 0, hashlib.sha256(b"email:0:6").hexdigest(), "email:0:6,email:11:29", 1)
    masked = {r.doc_id: r.text for r in pii.mask_pii(clash(docs(spark, rows))).collect()}
    assert masked[3] == "[EMAIL] and [EMAIL]" and masked[1] is None and masked[2] == ""
    assert pii.find_pii(docs(spark, [])).count() == 0


# --- 3 and 8 language models ------------------------------------------------------------------------


def brute_kneser_ney(texts, order, symbols, modified):
    """p(gram) by the definition, with dictionaries."""
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        s = " " * (order - 1) + "".join(chr(symbols[ord(c)]) for c in t)
        for i in range(len(t)):
            g = s[i : i + order]
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        table = counts[len(gram)]
        n = [sum(c == i for c in table.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        if modified:
            d = [max(0.05, min(i - 0.05, i - (i + 1) * y * (n[i + 1] / n[i] if n[i] else 0.5))) for i in (1, 2, 3)]
        else:
            d = [max(0.05, min(0.95, y))] * 3
        same = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return p(gram[1:])
        off = lambda c: d[min(c, 3) - 1]
        gamma = sum(map(off, same.values())) / total
        own = same.get(gram, 0)
        return (own - off(own) if own else 0) / total + gamma * p(gram[1:])

    return p


@pytest.mark.parametrize("modified", [True, False])
def test_scores_equal_the_definition(spark, modified):
    train = [(i, words(12, i, "abc"), "en", None) for i in range(6)] + [(i, words(12, i, "bcdé"), "fr", None) for i in range(10, 14)]
    test = [(100, "abc bca zz", None, None), (101, "é", None, None), (102, "", None, None), (103, None, None, None)]
    d = docs(spark, train + test)
    keyed = d.select("doc_id", "text", F.col("lang").alias("key"))
    model = kneser_ney.smooth(kneser_ney.count_grams(keyed.filter("key is not null"), 3, kneser_ney.letters), 3, modified)
    from specweave.llm.blocks import in_blocks

    blocks, n = in_blocks(keyed, block_bytes=100)
    assert kneser_ney.learned_keys(model) == ["en", "fr"]

    def finish(batch, size, sums):
        import pyarrow as pa

        return pa.table([batch.column("doc_id"), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["doc_id", "en", "fr"])

    out = {r.doc_id: (r.en, r.fr) for r in kneser_ney.score(blocks, n, model, ["en", "fr"], 3, kneser_ney.letters, False, finish, "doc_id long, en double, fr double").collect()}
    symbols = kneser_ney.letters()
    for k, lang in enumerate(("en", "fr")):
        p = brute_kneser_ney([r[1] for r in train if r[2] == lang], 3, symbols, modified)
        for i, text, *_ in train + test:
            s = "  " + "".join(chr(symbols[ord(c)]) for c in text or "")
            want = sum(np.log(p(s[j : j + 3])) for j in range(len(text or "")))
            assert abs(out[i][k] - want) < 1e-3 * max(1, abs(want)), (i, lang)


def test_quality_keeps_the_trusted_kind(spark):
    good = [(i, words(60, i, "abcde"), "en", None) for i in range(60)]
    bad = [(1000 + i, words(60, i, string.punctuation), "en", None) for i in range(10)]
    odd = [(2000, None, "en", None), (2001, "", "en", None), (2002, words(60, 1, "abcde"), None, None), (2003, words(60, 2, "abcde"), "xx", None), (2004, words(30_000, 5, "abcde"), "en", None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(1000, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    d = clash(docs(spark, good + bad + odd + good[:1]))
    got = {r.doc_id: r for r in quality.judge(d, labels).collect()}
    assert all(got[i].kept for i in [*range(60), 2002, 2003, 2004]) and not any(got[i].kept for i in [*range(1000, 1010), 2000, 2001])
    assert got[2000].perplexity is None and got[2003].model == quality.ANY
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r.key for r in kept.collect()} == {"x"}
    assert sorted(r.doc_id for r in kept.collect()) == sorted([0, *range(60), 2002, 2003, 2004])
    none = spark.createDataFrame([], labels.schema)
    assert {r.doc_id for r in quality.keep_good(d, none).collect()} == {r[0] for r in good + bad + odd if r[1]}
    assert all(r.kept == bool(r.n_symbols) for r in quality.judge(d, none).collect())
    assert quality.judge(docs(spark, []), labels).count() == 0


def test_limits_equal_the_definition(spark):
    """Perplexities by the other half's model, limits by language and length, and what is kept, with dictionaries."""
    rng = random.Random(33)
    rows = [(i, words(rng.choice([2, 9, 40]), i, "abcd" if i % 2 else "cdef"), ["en", "fr"][i % 2] if i % 9 else None, None) for i in range(120)]
    rows += [(200 + i, words(30, i, "xyz!"), "en", None) for i in range(5)] + [(300, "abc dea", "it", None), (301, "", "en", None), (302, None, None, None)]
    good = {i for i in range(120) if i % 4}
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows), spark.createDataFrame([(i, 1) for i in good], "doc_id long, quality int"), order=3, quantile=0.9).collect()}
    halves = {r.doc_id: int(r.h) for r in docs(spark, rows).select("doc_id", quality.half(F.col("doc_id")).alias("h")).collect()}
    symbols = kneser_ney.characters()
    models = {}
    for h in (0, 1):
        texts = {lang: [r[1] for r in rows if r[0] in good and halves[r[0]] == h and (lang == "*" or r[2] == lang)] for lang in ("en", "fr", "*")}
        models |= {(lang, h): brute_kneser_ney(own, 3, symbols, True) for lang, own in texts.items()}
    loss, limits = {}, {}
    for i, text, lang, _ in rows:
        name = lang if lang in ("en", "fr") else "*"
        if text:
            s = "  " + "".join(chr(symbols[ord(c)]) for c in text)
            p = models[name, 1 - halves[i]]
            loss[i] = -sum(np.log(p(s[j : j + 3])) for j in range(len(text))) / len(text)
            if i in good:
                limits.setdefault((name, int(np.floor(np.log(len(text)) / np.log(4) + 1e-9))), []).append(loss[i])
    limits = {k: np.ceil(sorted(v)[int(np.ceil(0.9 * len(v))) - 1] * 1000) / 1000 for k, v in limits.items()}
    for i, text, lang, _ in rows:
        name = lang if lang in ("en", "fr") else "*"
        assert got[i].model == name
        if not text:
            assert not got[i].kept and got[i].perplexity is None
            continue
        most = limits.get((name, int(np.floor(np.log(len(text)) / np.log(4) + 1e-9))), max(v for (n, _), v in limits.items() if n == name))
        assert abs(np.log(got[i].perplexity) - loss[i]) < 1e-4 and abs(np.log(got[i].threshold) - most) < 1.1e-3
        assert got[i].kept == (loss[i] <= most) or abs(loss[i] - most) < 1.1e-3
    assert not any(got[200 + i].kept for i in range(5))


def test_languages_held_out(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in got)
    extra = clash(d.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "123 !!", None), (None, "the the", None)], "doc_id long, text string, lang string")))
    more = {r.doc_id: r for r in language_id.identify(extra).collect()}
    assert [more[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and more[None].held_out is False
    untaught = language_id.identify(docs(spark, [(1, "abc", None, None)])).first()
    assert untaught.lang_pred == "und" and language_id.identify(docs(spark, [])).count() == 0


def test_scores_and_rejections_equal_the_definition(spark):
    rng = random.Random(88)
    letters = {"en": "abcdet ", "fr": "cdeéàu ", "xx": "xyz "}
    text = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(5, 80)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(rng.choices(["en", "fr"], k=120))] + [(500, "zyx zyx", "xx"), (501, None, "en"), (502, "12", "fr"), (503, "qqq ñññ ωωω", None)]
    rows += rows[:5]
    df = docs(spark, rows)
    marks = {(r.doc_id, r.text): (r.a, r.h) for r in df.select("doc_id", "text", (F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(language_id.CALIBRATION)) == 0).alias("a"), language_id.held_out().alias("h")).collect()}
    own = [(i, t, lang, *marks[i, t]) for i, t, lang in rows]
    taught = {lang for _, t, lang, aside, out in own if lang and t is not None and not aside and not out}
    train = {}
    for _, t, lang, aside, out in own:
        if lang and not out and not (aside and lang in taught):
            train.setdefault(lang, []).append(t or "")
    symbols = kneser_ney.letters()
    models = {lang: brute_kneser_ney(ts, 3, symbols, False) for lang, ts in sorted(train.items()) if any(ts)}
    want, losses = {}, {}
    for i, t, lang, aside, out in own:
        s = "  " + "".join(chr(symbols[ord(c)]) for c in t or "")
        sums = {k: sum(np.log(p(s[j : j + 3])) for j in range(len(t or ""))) for k, p in models.items()}
        best = max(sums, key=sums.get)
        if not any(c.isalpha() for c in t or ""):
            want[i] = ("und", 0.0, None)
            continue
        n, loss = len(t), -sums[best] / len(t)
        want[i] = (best, 1 / sum(np.exp((v - sums[best]) * min(n, language_id.EVIDENCE) / n) for v in sums.values()), loss)
        if best == lang and not out:
            losses.setdefault((best, bool(aside and lang in taught)), []).append(loss)
    limits = {}
    for lang in models:
        found = sorted(np.ceil(x * 1000) for x in losses.get((lang, True)) or losses.get((lang, False), []))
        limits[lang] = found[int(np.ceil(0.9 * len(found))) - 1] / 1000 if found else -1
    got = language_id.identify(df, order=3, quantile=0.9).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score, loss = want[r.doc_id]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3, r
        if loss is None or abs(loss - limits[lang]) > 2e-3:
            assert r.rejected == (loss is None or loss > limits[lang]), r
    assert {r.rejected for r in got} == {True, False}


# --- 4 chat --------------------------------------------------------------------------------------------


def cheapest(roles):
    import heapq

    best, queue = {}, [(0, 0, 0)]
    while queue:
        c, i, s = heapq.heappop(queue)
        if (i, s) in best:
            continue
        best[i, s] = c
        for cost, a, b, _, _ in chat.OPTIONS[roles[i]] if i < len(roles) else []:
            if a == s:
                heapq.heappush(queue, (c + cost, i + 1, b))
    return min(best[len(roles), s] + chat.FINAL[s] for s in range(4) if (len(roles), s) in best)


def test_repair_is_cheapest_wherever_it_is_cut(spark):
    rng = random.Random(4)
    rows = [(c or None, i, rng.choice(["user", "assistant", "system", "human", "Bot", None, "?"]), rng.choice([f"t{c}.{i}", None, ""])) for c in range(30) for i in range(rng.choice([1, 2, 5, 9, 80]))]
    rows += [(77, 0, "user", "a"), (77, 0, "user", "a"), (77, None, "system", "s")]
    rows += [(88, i, rng.choice(["user", "assistant"]), f"m{i}") for i in range(3000)]
    turns = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = [sorted(map(tuple, chat.repair(turns, parts, longest).drop("rendered").collect()), key=str) for parts, longest in ((1, 0), (5, 0), (17, 0), (3, 4), (None, 512))]
    assert all(f == found[0] for f in found)
    by_conv = {}
    for conv, message, turn, role, text, action, cost in found[0]:
        by_conv.setdefault(conv, []).append((message, role, text, action, cost))
    for conv, messages in by_conv.items():
        messages.sort()
        roles = [m[1] for m in messages]
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2) and body and [m[0] for m in messages] == list(range(len(messages)))
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        if conv != 77:
            assert messages[0][4] == cheapest([chat.known_role(r[2]) for r in own])
            assert [t for m in messages for t in m[2].split("\n\n") if t] == [r[3] for r in own if r[3]]
    first = chat.repair(turns, 3).filter("conv_id = 77 and message = 0").first()
    assert first.rendered == "<|im_start|>system\ns<|im_end|>\n" and first.role == "system"
    assert chat.repair(turns.limit(0)).count() == 0


# --- 5 repeats ---------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    first = {}
    for i, t in rows:
        t = (t or "").encode()
        for k in range(len(t) - length + 1) if i is not None else []:
            first[t[k : k + length]] = min(i, first.get(t[k : k + length], i))
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1) if i is not None else []:
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark, small):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    vocabulary = [words(1, i, "abcdé", 14) for i in range(12)]
    random_rows = [(rng.choice([i, i, i // 2, None]), rng.choice([" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))), "ab" * rng.randint(0, 200), None])) for i in range(200)]
    for rows in (table, random_rows, [(2, "x" * 20_000), (1, "x" * 60), (3, "x" * 49)], [(1, None)]):
        for wide, bits in ((suffix_dedup.WIDE_RUNS, 64), (1, 64), (suffix_dedup.WIDE_RUNS, 8), (3, 8)):  # few runs under an anchor are sorted together, or every window apart; hashes that collide
            got = sorted(map(tuple, suffix_dedup.remove_repeats(clash(docs(spark, rows)), wide=wide, bits=bits).collect()), key=str)
            assert got == brute_repeats(rows, 50)
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    kept = suffix_dedup.remove_repeats(docs(spark, [(1, "a" * 60), (2, "b" + "a" * 60 + "c")]), with_text=True).orderBy("doc_id").collect()
    assert [bytes(r.kept) for r in kept] == [b"a" * 60, b"bc"]


def test_a_word_on_which_polynomial_hashes_vanish(spark):
    rng = random.Random(7)
    at = lambda t: suffix_dedup.Prefixes(np.frombuffer(t, np.uint8)).every(24)
    x = min((bytes(rng.choice(b"klmnopqrst") for _ in range(24)) for _ in range(4000)), key=lambda t: at(t)[0])
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    word = lambda flip: b"".join((b"aaa", b"bbb")[t ^ flip] + x for t in thue)
    texts = [(1, (b"ccc" + x + word(1)).decode()), (2, (b"ccc" + x + word(0)).decode()), (3, (b"ccc" + x + word(0)).decode())]
    for partitions in (1, 3):
        got = sorted(map(tuple, suffix_dedup.remove_repeats(docs(spark, texts).repartition(partitions, "doc_id")).collect()), key=str)
        assert got == brute_repeats(texts, 50)


def test_repeats_whose_hashes_collide(spark):
    rng = random.Random(8)
    rows, seen = [], []
    for i in range(150):
        pieces = [rng.choice(seen) if seen and rng.random() < 0.5 else "".join(rng.choice("abcdef ") for _ in range(rng.randint(20, 120))) for _ in range(rng.randint(1, 5))]
        seen += pieces
        rows.append((i, "".join(pieces)))
    for bits, wide in ((8, 2048), (4, 2048), (8, 2), (64, 2048)):
        got = sorted(map(tuple, suffix_dedup.remove_repeats(docs(spark, rows).repartition(4), wide=wide, bits=bits).collect()), key=str)
        assert got == brute_repeats(rows, 50)


def test_documents_that_repeat_their_own_blocks(spark):
    rng = random.Random(55)
    text = lambda n: "".join(rng.choice(string.ascii_letters) for _ in range(n))
    rows = []
    for k in range(40):
        shared, block = text(rng.randint(50, 130)), [text(rng.randint(3, 40)) for _ in range(4)]
        rows.append((3 * k, block[0] + shared + block[1]))
        rows.append((3 * k + 1, (block[2] + shared + block[3]) * rng.randint(2, 6)))
        if k % 4 == 0:  # the doc_id again, with another text that holds the block; and an equal row
            rows += [(3 * k + 1, "+" * 70 + (block[2] + shared + block[3]) * 2), rows[-1]]
        if k % 5 == 0:  # a later document has the block too
            rows.append((3 * k + 2, (block[2] + shared + block[3]) * 3))
    for wide in (suffix_dedup.WIDE_RUNS, 1):
        got = sorted(map(tuple, suffix_dedup.remove_repeats(docs(spark, rows), wide=wide).collect()), key=str)
        assert got == brute_repeats(rows, 50)


# --- 6 nearest ----------------------------------------------------------------------------------------------


def _paged(df, rows):
    """The same search with pages that hold parts of leaves only."""
    before, nearest.PAGE = nearest.PAGE, rows
    try:
        return nearest.nearest(df, leaf=64).cache()
    finally:
        nearest.PAGE = before


def test_recall_and_ties(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((3000, 16))
    v[1000:2000] = v[7]  # a third of all rows are one vector
    rows = [(i, v[i].tolist()) for i in range(3000)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0]), (None, [1.0] * 16), (5200, [1.0] * 15 + [None])]
    df = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, leaf=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 3000, 50):
        scores = np.round(unit @ unit[q], 12)
        scores[q] = -9
        best = np.lexsort((np.arange(3000), -scores))[:5]
        hits += len({i for i, *_ in got[q]} & set(best.tolist()))
        total += 5
        assert [r for *_, r in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s - unit[q] @ unit[i]) < 1e-12 for i, s, _ in got[q])
    assert hits >= 0.9 * total and set(got) == set(range(0, 3000, 50))
    assert [i for i, *_ in got[1000]] == [7, 1001, 1002, 1003, 1004]
    nearest_in_parts = {(r.query_id, r.vec_id) for r in _paged(df, 50).collect()}
    assert nearest_in_parts == {(q, i) for q, own in got.items() for i, *_ in own}
    few = nearest.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]
    assert nearest.nearest(df.limit(0)).count() == 0


def test_parallel_vectors_tie_by_id(spark):
    rng = np.random.default_rng(66)
    way = rng.standard_normal(8)
    rows = [(0, (way + 0.1).tolist())] + [(i, (way * 2.0 ** (i % 37 - 18)).tolist()) for i in range(1, 38)] + [(i, (-way + rng.standard_normal(8) / 9).tolist()) for i in range(38, 50)]
    got = nearest.nearest(spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>").repartition(3)).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in range(1, 6)]


def test_each_length_of_vectors_is_searched(spark):
    rng = np.random.default_rng(67)
    rows = [(i, rng.standard_normal(4 if i < 300 else 8).tolist()) for i in range(500)] + [(350, rng.standard_normal(4).tolist()), (600, [1.0]), (650, [])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), trees=8).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in range(0, 700, 50)}
    assert all(len(found[q]) == 5 and len(set(found[q])) == 5 for q in range(0, 500, 50)) and found[600] == found[650] == []
    assert all((v < 300) == (q < 300) for q in range(0, 300, 50) for v in found[q] if v != 350)


def test_structured_vectors_need_few_leaves(spark):
    rng = np.random.default_rng(67)
    v = np.repeat(rng.standard_normal((120, 24)), 50, 0) + rng.standard_normal((6000, 24)) / 4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    asked = []
    plain = nearest.leaves_for

    def noted(entries, forest, *rest):
        asked.append((plain(entries, forest, *rest), len(forest.planes) << forest.depth))
        return asked[-1][0]

    nearest.leaves_for = noted
    try:
        got = nearest.nearest(df, leaf=64).collect()
    finally:
        nearest.leaves_for = plain
    unit = nearest._unit(v.astype(np.float32).astype(float))
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-(unit @ unit[q]))[1:6].tolist())) for q in range(0, 6000, 50))
    assert hits >= 0.9 * 5 * 120 and asked[0][0] < asked[0][1] / 8


# --- 7 SimHash ------------------------------------------------------------------------------------------------


def brute_simhash(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, "Ä B"), (9003, "ä B"), (9004, " \t"), (9005, "w " * 50_000)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(clash(docs(spark, rows))).collect()}
    fps = {i: brute_simhash(t) for i, t in rows}
    want = brute_classes(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    twice = simhash.near_duplicates(docs(spark, [(1, "a b c d"), (1, "a b c d"), (None, "z z z z"), (2, "a b c d")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in twice if r.doc_id) == [(1, 1), (1, 1), (2, 1)]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [1, 4, 64])
def test_links_lose_nothing(spark, limit):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)] + [0]
    fps = set(base)
    for _ in range(300):
        f = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 3)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    own = {i: f for i, f in enumerate(sorted(fps))}
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in own.items()]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long, rep long"), list_limit=limit)
    got = {r.node: r.component for r in components.components(links).collect()}
    assert {i: got.get(i, i) for i in own} == brute_classes(own)


# --- 9 mixing -----------------------------------------------------------------------------------------------------


def filled(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, words(rng.randint(0, 60), i), "en", rng.choice(["a", "a", "a", "b", "c", "É", None, "z"])) for i in range(400)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "only"), (1002, "w " * 30_000, "en", "big"), (5, "x y", "en", "a")]
    d = clash(docs(spark, rows))
    got = mixing.mix_report(d).collect()
    sizes, taken, target = {}, {}, {}
    source = {}
    for r in rows:
        source.setdefault((r[0], len((r[1] or "").split())), r[3])
    for r in got:
        s = source[r.doc_id, r.size]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = filled(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - target[s]) <= 0.5
    assert sorted(map(tuple, mixing.mix_report(d.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)
    mixed = mixing.mix(d).collect()
    assert [r.mix_position for r in mixed] == sorted(r.mix_position for r in mixed) and all(0 <= r.mix_position < 1 for r in mixed)
    assert sum(r.mix_words for r in mixed) == sum(r.taken for r in got) and mixed[0].target == "x"
    assert mixing.mix_report(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, None)])).count() == 0


def test_positions_invert_the_demand(spark):
    df = spark.range(0, 100).select((F.col("id") / 100).alias("u"))
    for ramp in (-0.5, 0.0, 0.5):
        t = F.col("t")
        back = df.withColumn("t", mixing.position(F.col("u"), F.lit(1.0), F.lit(ramp))).select("u", (t + ramp * (t * t - t)).alias("b"), "t")
        assert all(abs(r.u - r.b) < 1e-9 and 0 <= r.t < 1 for r in back.collect())


# --- 10 urls --------------------------------------------------------------------------------------------------------


def test_rules_and_aliases(spark):
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"></html>'
    move = lambda u: f"<meta content='0; url={u}' http-equiv=refresh>"
    pages = [
        (1, "http://A.example.COM/en/x?q#f", None), (2, "http://www.example.com/en/x", ""), (3, "http://example.com?en", ""), (4, "ftp://x.net/es/", ""), (5, "http://notexample.org/en/", ""),
        (6, "http://b.org/1", move("/2")), (7, "http://b.org/2", link("//evil.net/fr/p")), (8, "http://evil.net/fr/p", ""), (9, "http://c.org/ok", link("http://evil.net/fr/p")),
        (10, "http://www.example.com/en/y", link("http://example.com/en/y")), (11, None, link("http://evil.net/fr/p")), (12, "no scheme", ""), (13, "http://b.org/1", ""), (14, "http://d.org/a/b", move("c?x=1&amp;y=2")), (15, "http://d.org/a/c?x=1&y=2", ""), (16, "http://com/en", ""),
    ]
    df = clash(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.decided_by) for r in url_filter.filter_urls(df).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block", "rule") and got[2][2:4] == ("www.example.com/en/", "allow")
    assert got[3] == ("example.com", "", None, "allow", "default") and got[4][2:4] == ("net/es/", "block") and got[5][3] == "allow"
    assert [got[i][3:] for i in (6, 7, 9, 13)] == [("block", "alias")] * 4 and got[8][2:4] == ("net/fr/", "block")
    assert got[10][3:] == ("allow", "rule") and got[11] == got[12] == ("", "", None, "allow", "default")
    assert got[14][3] == got[15][3] == "allow" and got[16][2] == "com/"
    seen = spark.createDataFrame([("http://d.org/a/b", "http://evil.net/fr/q"), (None, "x")], "from_url string, to_url string")
    more = {r.page_id: r.verdict for r in url_filter.filter_urls(df, redirects=seen).collect()}
    assert more[14] == more[15] == "block" and more[5] == "allow"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "links"),
    [
        ('<!-- <link rel="canonical" href="http://c.org/y"> -->', []), ('<!-- never closed <link rel="canonical" href="http://c.org/y">', []),
        ('<link rel="alternate canonical" href="http://c.org/y">', ["http://c.org/y"]), ('<link data-rel="canonical" href="http://c.org/y">', []), ('<link rel=canonicals href=x>', []),
        ('<LINK\nHREF=/y\tREL = Canonical />', ["/y"]), ("<link rel='canonical' title='a > b' href='/z'>", ["/z"]), ('<link rel="next" rel="canonical" href="/y">', []),
        ('<link rel="stylesheet" href="/s"><link rel="canonical" href="/1"><p><link rel="CANONICAL" href="/2">', ["/1", "/2"]), ("<script>'<link rel=canonical href=/y>'</script>", []),
        ('<title><link rel=canonical href=/y></title><link rel=canonical href=" /w ">', ["/w"]), ("<links rel=canonical href=/y><linkrel=canonical>", []), ("<link rel=canonical><link>", []),
        ('<meta http-equiv=" Refresh " content="5; URL=\'http://d.org/?a=1&amp;b=2\'">', ["http://d.org/?a=1&b=2"]), ('<meta name="refresh" content="0; url=/y">', []), ('<meta content="0;url=/1" http-equiv=refresh><meta http-equiv=refresh content=30>', ["/1"]),
        ('<link rel="canonical" ' + 'x="y" ' * 3000 + 'href="/far">' + "<" * 5000, ["/far"]), (None, []), ("", []),
    ],
)
def test_links_of_html(spark, html, links):
    got = url_filter.page_links(spark.createDataFrame([("http://a.org/x", html), (None, html)], "url string, html string"))
    assert sorted(map(tuple, got.collect())) == [("http://a.org/x", t) for t in sorted(links)]


def test_texts_of_megabytes(spark):
    """One text of some three million characters goes through every operator on texts, beside an ordinary one."""
    own = words(700_000, 99)
    assert len(own) > 3_000_000
    item, late = "the quick brown item of a benchmark that nobody else would write down", " reach me at ann@example.org "
    rows = [(1, own[:400] + " first", "en", "a"), (2, own + ". " + item + late, "en", "a"), (3, None, "fr", None)]
    d = docs(spark, rows)
    leaks = decontamination.find_leaks(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, rows[1][1][r.start : r.end]) for r in leaks] == [(2, 7, item)]
    assert {r.doc_id: r.n_email for r in pii.find_pii(d).collect()} == {1: 0, 2: 1, 3: 0}
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(d).collect()}
    assert removed[1] == (406, 0) and removed[2] == (len(rows[1][1]), next(n for n in range(400, 500) if rows[0][1][: n + 1] != own[: n + 1])) and removed[3] == (0, 0)
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(d).collect()}[2] == f"{brute_simhash(rows[1][1]):016x}"
    assert {r.doc_id: r.lang_pred for r in language_id.identify(d).collect()}[3] == "und"
    assert {r.doc_id: r.size for r in mixing.mix_report(d).collect()}[2] == len(rows[1][1].split())


def test_repeats_are_met_in_blocks_of_their_own_size(spark, monkeypatch):
    from specweave.llm import blocks, suffix_dedup

    assert suffix_dedup.OWN_BLOCK_BYTES < blocks.BLOCK_BYTES
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=60)) for _ in range(12)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4)) + f" end {i}") for i in range(80)], "doc_id long, text string")
    whole = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "OWN_BLOCK_BYTES", 2_000)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == whole and any(r[2] for r in whole)


def test_suffixes_of_one_text_are_compared_once_however_many_they_are(monkeypatch):
    rng = np.random.default_rng(4)
    lines = rng.integers(97, 100, (6, 60), dtype=np.uint8)
    lines[:, :8] = 97  # they agree in their first bytes
    buffer = lines[rng.integers(0, 6, 5_000)].ravel()
    at, group = np.arange(0, len(buffer), 60), np.repeat([3, 9], 2_500)
    pairs, extension = [], suffix_dedup.common_extension
    monkeypatch.setattr(suffix_dedup, "common_extension", lambda p, a, *more: (pairs.append(len(a)), extension(p, a, *more))[1])
    order = suffix_dedup.suffix_sorted(suffix_dedup.Prefixes(buffer), buffer, at, group, 50)
    assert order.tolist() == suffix_dedup.exact_order(buffer, at, group, 50).tolist()
    assert 0 < sum(pairs) < 200  # of six lines in two groups; 10,000 and more if each copy is compared


def test_runs_go_to_a_bucket_in_one_message_and_come_back_as_they_were(spark):
    rng = random.Random(6)
    line = "".join(rng.choices("abcdefgh", k=90))
    ids = [-(2**63), -5, 0, 7, 2**40, 2**63 - 1]
    rows = [(i, "".join(rng.choices("abcdefgh", k=300)) + line + f" end {k}") for k, i in enumerate(ids)]
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs(spark, rows)).collect()), key=str)
    assert got == brute_repeats(rows, 50) and sum(r[2] > 0 for r in got) == len(ids) - 1
    text = pa.array([t.encode() for _, t in rows], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([3, -4, 5, -6, 7, -8], pa.int32()), text], ["doc_id", "h", "text"])
    sent = list(suffix_dedup._send(50, 24, 3, 64)(iter([batch])))
    assert [b.column("bucket").to_pylist() for b in sent] == [[0, 1, 2]]  # settled runs among the others
    x, sizes = suffix_dedup._unpack(sent[0].column("data"))
    runs = suffix_dedup.anchored_runs(*flat(batch))
    assert sizes.sum() == len(runs[0]) and (x["n"] & 1).sum() > 0
    whose = np.array(ids)[runs[0]]
    assert sorted(zip(x["doc"].tolist(), x["s"].tolist(), (x["n"] >> 1).tolist(), x["c"].tolist())) == sorted(zip(whose.tolist(), runs[1].tolist(), runs[2].tolist(), (runs[4] & np.uint64(2**24 - 1)).tolist()))


def test_texts_are_measured_once_for_buckets_and_blocks(spark):
    table, sc = docs(spark, [(i, f"text {i} " * 20) for i in range(20)]), spark.sparkContext
    jobs = []
    for name, f in (("size", lambda: held_bytes(table, "text")), ("plan", lambda: suffix_dedup.remove_repeats(table))):
        sc.setJobGroup(f"measured {name}", name)
        f()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"measured {name}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_stretches_that_differ_are_compared_run_by_run():
    text = bytes(range(97, 122)) * 12
    claims = {"doc": np.array([4, 4, 4, 4, 9]), "h": np.array([1, 1, 1, 1, 2], np.uint32), "s": np.array([40, 10, 25, 200, 0], np.uint32), "n": np.array([5, 14, 14, 3, 2], np.uint32)}
    claims |= {"td": np.array([6, 6, 6, 6, -6]), "th": np.array([8, 8, 8, 8, 2**32 - 1], np.uint32) ^ np.array([1, 1, 1, 1, 2], np.uint32), "shift": np.array([-10, -10, -10, -10, 7]).astype(np.uint32), "k": np.array([0, 1, 2, 1, 1], np.uint8)}
    x, known = suffix_dedup._stretches(claims, 50)
    ends = {(4, 1): [(10, 95), (200, 253)], (9, 2): [(0, 52)]}
    assert {name: sorted((int(x["s"][i]), int(x["end"][i])) for i in own) for name, own in known.items()} == ends
    message = suffix_dedup._sent(x, [(i, text[x["s"][i] : x["end"][i]]) for i in range(3)])
    got = suffix_dedup._sent_bytes(pa.array([message]))
    told = {name: sorted((s, data, source, list(suffix_dedup._runs_of(s, runs))) for s, data, source, runs in own) for name, own in got.items()}
    assert told == {(6, 8): [(0, text[10:95], (4, 1, 10), [(0, 14, 1), (15, 14, 2), (30, 5, 0)]), (190, text[200:253], (4, 1, 200), [(190, 3, 1)])], (-6, -1): [(7, text[0:52], (9, 2, 0), [(7, 2, 1)])]}

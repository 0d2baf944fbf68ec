"""Normal forms of names, routes and texts, as column expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from http import HTTPStatus
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


# Names and patterns whose lines or parts are secrets.
SECRET_LINE = r"(?i)(password|passwd|api[_-]?key|secret|connectionstrings?|access[_-]?token)[\"']?\s*[:=]"
SECRET_TOKEN = r"(?i)\bsk-[a-z0-9_-]{12,}"
PRIVATE_KEY = r"-----BEGIN [^-]*PRIVATE KEY-----[\s\S]*?-----END [^-]*PRIVATE KEY-----"
LINE_MARK, TOKEN_MARK, KEY_MARK = "// [REDACTED secret-bearing line]", "[REDACTED]", "[REDACTED PRIVATE KEY]"


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """What full case folding does that lower case does not: single characters, their folds, and characters that become several."""
    single, several = {}, {}
    for c in map(chr, range(0x80, 0x20000)):
        if not 0xD800 <= ord(c) < 0xE000 and (fold := c.casefold()) != c:
            (single if len(fold) == 1 else several)[c] = fold
    return "".join(single), "".join(single.values()), several


def casefold(x) -> Column:
    """Full Unicode case folding, as for comparing without regard to case. Texts of Latin-1 characters need lower case alone, ß aside."""
    text = F.replace(_c(x), F.lit("ß"), F.lit("ss"))
    single, folds, several = _folds()
    table = F.map_from_arrays(F.split(F.lit(" ".join(several)), " "), F.split(F.lit(" ".join(several.values())), " "))
    one_by_one = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    longer = F.when(text.rlike("[" + "".join(several) + "]"), one_by_one).otherwise(text)
    full = F.translate(longer, ascii_uppercase + single, ascii_lowercase + folds)
    return F.when(text.rlike(r"[^\x00-\xFF]|\xB5"), full).otherwise(F.lower(text))


def rounded(x, digits: int = 0) -> Column:
    """A double rounded by its exact binary value, halves to the even digit: what a careful reader of all its decimals would write.

    x times 10^digits is taken without error, as a product and what the product lost, so a value that only looks
    like a half (2.675 is a little less) goes where it belongs. Beyond 2^51 in that unit the decimal notation decides.
    """
    value, scale = F.abs(_c(x)), float(10**digits)
    split = lambda v: (v * 134217729.0) - ((v * 134217729.0) - v)  # noqa: E731  the upper half of a double's bits
    high, low = split(value), value - split(value)
    top = scale * 134217729.0 - (scale * 134217729.0 - scale)
    product = value * scale
    lost = ((high * top - product) + high * (scale - top) + low * top) + low * (scale - top)
    whole = F.floor(product).cast("double")
    over = (product - whole) - 0.5
    up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    exact = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    sign = F.when(_c(x) < 0, -1.0).otherwise(1.0)
    return F.when(F.isnan(_c(x)) | (value == float("inf")), _c(x)).when(product < float(1 << 51), exact * sign).otherwise(F.bround(_c(x), digits))


def compact_name(x) -> Column:
    """Lower-case letters and digits only, one trailing dto taken off: how names of two sources are compared."""
    return F.regexp_replace(comparison_key(x), "dto$", "")


def comparison_key(x) -> Column:
    return F.regexp_replace(casefold(x), "[^a-z0-9]", "")


def plain_route(x) -> Column:
    """Lower case, no trailing slashes, parameters without constraints; / if nothing is left."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(_c(x), "/+$", "")), r"\{([^}:]+):[^}]+\}", "{$1}")
    return F.when(bare == "", "/").otherwise(bare)


def route_segments(x) -> Column:
    """The segments of a route, every parameter as {}."""
    parts = F.filter(F.split(plain_route(x), "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.startswith("{"), "{}").otherwise(s))


def snake_identifier(x) -> Column:
    """Words of an identifier in lower case joined by underscores; unnamed if there are none."""
    split = F.regexp_replace(F.regexp_replace(_c(x), "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    words = F.lower(F.array_join(F.regexp_extract_all(split, F.lit("[A-Za-z0-9]+"), 0), "_"))
    return F.when(words == "", "unnamed").otherwise(words)


def portfolio_route(x) -> Column:
    """/-led route, static segments in lower case, parameters as snake-case identifiers without constraints."""
    route = F.regexp_replace(F.trim(_c(x)), "^/+|/+$", "")
    inner = lambda s: snake_identifier(F.split_part(F.regexp_extract(s, r"^\{([^}]+)\}", 1), F.lit(":"), F.lit(1)))
    one = lambda s: F.when(s.rlike(r"^\{[^}]+\}"), F.concat(F.lit("{"), inner(s), F.lit("}"), F.regexp_extract(s, r"^\{[^}]+\}(.*)$", 1))).otherwise(F.lower(s))
    return F.concat(F.lit("/"), F.array_join(F.transform(F.filter(F.split(route, "/"), lambda s: s != ""), one), "/"))


def terms(x, underscore: bool = True) -> Column:
    """The different words of a text and of its camel-case parts, in lower case."""
    text = F.coalesce(_c(x), F.lit(""))
    split = F.concat(text, F.lit(" "), F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
    both = casefold(F.when(text.rlike("[a-z0-9][A-Z]"), split).otherwise(text))  # most texts have no such parts
    return F.array_distinct(F.regexp_extract_all(both, F.lit("[a-z0-9_]+" if underscore else "[a-z0-9]+"), 0))


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def collapsed(x) -> Column:
    """White space as single spaces, null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(_c(x), r"\s+", " ")), F.lit(""))


def title(x) -> Column:
    """Each run of letters with a capital first, the rest small: unlike initcap, also after digits and apostrophes."""
    parts = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def route_domain(x) -> Column:
    """The first segment that is no parameter, as a title; API without one."""
    first = F.try_element_at(F.filter(F.split(_c(x), "/"), lambda s: (s != "") & ~s.startswith("{")), F.lit(1))
    found = title(F.trim(F.regexp_replace(first, "[-_]", " ")))
    return F.when(F.coalesce(found, F.lit("")) == "", "API").otherwise(found)


def humanized(x) -> Column:
    """An identifier as words: without Async and Controller endings, split at capitals and underscores."""
    bare = F.regexp_replace(_c(x), "(Async|Controller)$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))


def bare_type(x) -> Column:
    """A CLR type's innermost name, in lower case: without global::, ?, generic wrapper (its first argument counts), [] and namespace."""
    t = F.regexp_replace(F.trim(F.replace(_c(x), F.lit("global::"), F.lit(""))), r"\?+$", "")
    inner = F.trim(F.split_part(F.regexp_extract(t, r"<([^<>]+)>$", 1), F.lit(","), F.lit(1)))
    bare = F.regexp_replace(F.when(t.rlike(r"<[^<>]+>$"), inner).otherwise(t), r"\[\]$", "")
    return F.lower(F.regexp_replace(F.substring_index(bare, ".", -1), "[^A-Za-z0-9_]", ""))


# What types of two systems are called in common.
TYPE_NAMES = {
    "int": "integer", "int32": "integer", "int64": "integer", "long": "integer",
    "float": "number", "double": "number", "decimal": "number",
    "uuid": "string", "guid": "string", "datetime": "string", "date-time": "string",
}


def common_type(x) -> Column:
    """A type under the name that compatible types share; a missing one is unknown, and unknown types agree."""
    t = F.replace(F.lower(F.coalesce(_c(x), F.lit("unknown"))), F.lit("?"), F.lit(""))
    t = F.regexp_replace(t, r"^(list|array)\[|\]$", "")
    names = F.create_map(*[F.lit(v) for kv in TYPE_NAMES.items() for v in kv])
    return F.coalesce(F.try_element_at(names, t), t)


def clr_kind(x) -> Column:
    """The kind of value a CLR type holds; the order of tests matters."""
    t = F.lower(_c(x))
    return (
        F.when(F.contains(t, F.lit("guid")), "uuid").when(F.contains(t, F.lit("datetime")), "date-time").when(t.isin("int", "long", "short", "system.int32", "system.int64"), "integer")
        .when(t.isin("decimal", "double", "float", "system.decimal"), "number").when(t.isin("bool", "system.boolean"), "boolean")
        .when(t.isin("string", "system.string"), "string").otherwise("unknown")
    )


def published_type(x) -> Column:
    """The JSON schema type under which a canonical attribute is published."""
    t = F.replace(F.lower(_c(x)), F.lit("?"), F.lit(""))
    return (
        F.when(t.isin("integer", "int", "int32", "int64", "long"), "integer").when(t.isin("number", "decimal", "float", "double"), "number")
        .when(t.isin("boolean", "bool"), "boolean").when(t.startswith("array") | t.startswith("list"), "array").otherwise("string")
    )


# Which argument of a rule becomes which keyword. Places count from 1, or from the end; OWN is the rule's single
# argument, a name is an argument written name=figures. The last column says how many arguments the rule needs for that.
OWN = 0
KEYWORDS = (
    ("maximum", "maximum", OWN, 0), ("maxItems", "maxItems", OWN, 0), ("maxLength", "maxLength", OWN, 0), ("minimum", "minimum", OWN, 0), ("minItems", "minItems", OWN, 0),
    ("minLength", "minLength", OWN, 0), ("pattern", "pattern", OWN, 0), ("Range", "maximum", -1, 3), ("Range", "minimum", -2, 3), ("RegularExpression", "pattern", 1, 1),
    ("StringLength", "maxLength", 1, 1), ("StringLength", "minLength", "minimumlength", 2),
)


def schema_keywords(rule, value, values) -> Column:
    """A validation rule as a map of JSON schema keywords to JSON texts by KEYWORDS; empty for rules without a counterpart.

    value is the rule's single argument, values its list of texts. Places from the end are bounds, written as whole numbers if they are.
    """
    given, own, arguments = F.lower(_c(rule)), _c(value).cast("string"), _c(values)
    whole = lambda text: F.when(text.rlike(r"^[+-]?\d{1,15}$"), text).otherwise(F.regexp_replace(text, r"\.0+$", ""))

    def argument(place) -> Column:
        if isinstance(place, str):
            named = F.filter(F.transform(F.slice(arguments, 2, F.greatest(F.size(arguments), F.lit(1))), lambda x: F.regexp_extract(x, rf"(?i){place}=(\d+)", 1)), lambda x: x != "")
            return F.try_element_at(named, F.lit(1))
        if place == OWN:
            return own
        text = F.try_element_at(arguments, F.lit(place))
        return whole(text) if place < 0 else text

    entries = [F.when((given == name.lower()) & (F.coalesce(F.size(arguments), F.lit(0)) >= least), F.struct(F.lit(keyword).alias("k"), argument(place).alias("v"))) for name, keyword, place, least in KEYWORDS]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull() & e["v"].isNotNull()))


def openapi_kind(kind, form, has_enum) -> Column:
    """The kind of an OpenAPI schema: its type, then its format, then an enum reference."""
    k = _c(kind)
    base = F.when(k.isin("string", "integer", "number", "boolean", "object"), k).otherwise("unknown")
    return F.when(_c(has_enum), "enum").when(_c(form) == "uuid", "uuid").when(_c(form) == "date-time", "date-time").otherwise(base)


def display_type(name, collection, nullable) -> Column:
    shown = F.when(_c(collection), F.concat(F.lit("List["), _c(name), F.lit("]"))).otherwise(_c(name))
    return F.concat(shown, F.when(_c(nullable), "?").otherwise(""))


def pointer_escape(x) -> Column:
    return F.replace(F.replace(_c(x), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(x) -> Column:
    return F.replace(F.replace(_c(x), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def route_parameters(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"\{([^{}]+)\}"), 1)


def location(path, start, end, pointer) -> Column:
    """path#pointer, path:lines a-b, path:line a or path, the first that is known."""
    p, s, e = _c(path), _c(start), _c(end)
    return (
        F.when(_c(pointer).isNotNull(), F.concat(p, F.lit("#"), _c(pointer)))
        .when(s.isNotNull() & e.isNotNull() & (e != s), F.concat(p, F.lit(":lines "), s.cast("string"), F.lit("-"), e.cast("string")))
        .when(s.isNotNull(), F.concat(p, F.lit(":line "), s.cast("string"))).otherwise(p)
    )


def candidate_symbols(x, most: int = 8) -> Column:
    """Class names in a text that name a service, repository, handler, client or mediator; the first few."""
    found = F.regexp_extract_all(_c(x), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*(?:Service|Repository|Handler|Client|Mediator))\b"), 1)
    return F.slice(F.filter(F.array_distinct(found), lambda s: F.length(s) <= 160), 1, most)


def status_class(x) -> Column:
    """What the hundreds of a status code mean."""
    h = F.floor(_c(x) / 100)
    return F.when(h == 2, "Successful response").when(h == 4, "Client error response").when(h >= 5, "Server error response").otherwise("Response")


def status_phrase(x) -> Column:
    """The standard phrase of a status code, or that it is a custom one."""
    names = F.create_map(*[F.lit(v) for s in HTTPStatus for v in (int(s), s.phrase)])
    return F.coalesce(F.try_element_at(names, _c(x).cast("int")), F.lit("Custom status"))


def preview(x, most: int = 1_800) -> tuple[Column, Column]:
    """The first ``most`` characters of a text, and whether it has more."""
    return F.substring(_c(x), 1, most), F.length(_c(x)) > most


def embedding_text(path, symbol, text) -> Column:
    """What is embedded for a piece of code: where it lies, what it is called, and itself."""
    return F.concat_ws("\n", *[F.coalesce(_c(c), F.lit("")) for c in (path, symbol, text)])


def redacted(x) -> Column:
    """Secrets out of a text, line numbers as before: keys in PEM as a mark and their line breaks, tokens, and lines that assign a secret."""
    text = _c(x)
    # a key's lines: all but the first become empty, and the first becomes the mark
    pieces = F.regexp_extract_all(text, F.lit(PRIVATE_KEY), 0)
    around = F.split(text, PRIVATE_KEY)
    marks = F.transform(pieces, lambda k: F.concat(F.lit(KEY_MARK), F.repeat(F.lit("\n"), F.length(k) - F.length(F.replace(k, F.lit("\n"), F.lit(""))))))
    joined = F.array_join(F.flatten(F.zip_with(around, marks, lambda a, m: F.array(F.coalesce(a, F.lit("")), F.coalesce(m, F.lit(""))))), "")
    text = F.when(F.size(pieces) > 0, joined).otherwise(text)
    text = F.regexp_replace(text, SECRET_TOKEN, F.lit(TOKEN_MARK))
    return F.array_join(F.transform(F.split(text, "\n"), lambda s: F.when(s.rlike(SECRET_LINE), LINE_MARK).otherwise(s)), "\n")


def mermaid_text(x) -> Column:
    return F.replace(F.replace(_c(x), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))

import hashlib
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from specweave.functions import ids, similarity, text


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'long'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_identities_equal_hashlib(spark):
    assert one(spark, ids.discovery_id("entity", "c0", "c1"), " a\\b ", "ü") == "entity-" + sha("entity\x1ea/b\x1fü")[:20]
    assert one(spark, ids.joined_id("entity", "c0", "c1"), " a", None) == "entity-" + sha("entity\x1f a\x1f")[:20]
    assert one(spark, ids.regional_id("entity", "c0", "c1"), "a", "b") == "entity-" + sha("a\x1fb")[:20]
    assert one(spark, ids.digest("c0"), "x") == sha("x")


def test_names_and_routes(spark):
    assert one(spark, text.compact_name("c0"), "Address_DTO") == "address"
    assert one(spark, text.compact_name("c0"), "dto") == ""
    assert one(spark, text.plain_route("c0"), "/A/{Id:int}//") == "/a/{id}"
    assert one(spark, text.plain_route("c0"), "///") == "/"
    assert one(spark, text.route_segments("c0"), "/v1/{id}/x/") == ["v1", "{}", "x"]
    for given, want in (("HTTPServerName", "http_server_name"), ("quoteId2Go", "quote_id2_go"), ("--", "unnamed"), ("a b", "a_b")):
        assert one(spark, text.snake_identifier("c0"), given) == want
    assert one(spark, text.portfolio_route("c0"), " /Api/{quoteId:guid}//Items/ ") == "/api/{quote_id}/items"
    assert one(spark, text.portfolio_route("c0"), "") == "/"
    assert one(spark, text.slug("c0"), " My App! ") == "my-app"
    assert one(spark, text.title("c0"), "o'neil 3d x-ray") == "O'Neil 3D X-Ray"
    assert one(spark, text.route_domain("c0"), "/{id}/claim-lines/x") == "Claim Lines"
    assert one(spark, text.route_domain("c0"), "/{id}") == "API"
    assert one(spark, text.collapsed("c0"), "  ") is None
    assert one(spark, text.pointer_unescape(text.pointer_escape("c0")), "a/~b") == "a/~b"


def test_terms_split_camel_case(spark):
    def want(v):
        split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", v)
        return set(re.findall(r"[a-z0-9_]+", f"{v} {split}".lower()))

    for v in ("getQuoteById", "a_b C", "", "XMLFile x1Y"):
        assert set(one(spark, text.terms("c0"), v)) == want(v)
    assert one(spark, text.terms("c0"), None) == []


def test_types(spark):
    for given, want in (("Int32?", "integer"), ("List[Guid]", "string"), (None, "unknown"), ("array[x]", "x")):
        assert one(spark, text.common_type("c0"), given) == want
    for given, want in (("System.Guid", "uuid"), ("DateTimeOffset", "date-time"), ("long", "integer"), ("decimal", "number"), ("Foo", "unknown")):
        assert one(spark, text.clr_kind("c0"), given) == want
    assert one(spark, text.bare_type("c0"), "global::A.B.List<C.D>") == "d"
    for given, bare in (("Foo[]?", "foo"), ("List<Foo?>", "foo"), ("Dictionary<A, B>", "a"), ("List<global::X.Y_z[]>", "y_z"), ("N.Q??", "q"), ("Map<List<A>, B>", "maplistab")):
        assert one(spark, text.bare_type("c0"), given) == bare


def test_redaction_keeps_lines(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nabc\ndef\n-----END RSA PRIVATE KEY-----"
    got = one(spark, text.redacted("c0"), f"a\n{key}\nb\nPassword: x\nsk-abcdefghijklmnop!\nc")
    assert got.split("\n") == ["a", "[REDACTED PRIVATE KEY]", "", "", "", "b", "// [REDACTED secret-bearing line]", "[REDACTED]!", "c"]
    assert one(spark, text.redacted("c0"), "plain") == "plain"


def test_similarity(spark):
    pairs = [("quoteId", "quote_id"), ("premiumAmount", "amount"), ("", "x"), ("abc", "xyz")]
    got = spark.createDataFrame(pairs, "a string, b string").select(similarity.name_similarity("a", "b").alias("x")).collect()
    for (a, b), row in zip(pairs, got, strict=True):
        x, y = (re.sub("[^a-z0-9]", "", v.lower()) for v in (a, b))
        words = [set(re.findall("[a-z0-9]+", (v + " " + re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", v)).lower())) for v in (a, b)]
        want = 0.0 if not (x and y) else 100 * max(SequenceMatcher(None, x, y).ratio(), len(words[0] & words[1]) / len(words[0] | words[1]))
        assert abs(row["x"] - want) < 1e-9
    assert abs(one(spark, similarity.text_similarity("c0", "c1"), "a b", "b c") - 100 / 3) < 1e-9
    assert one(spark, similarity.text_similarity("c0", "c1"), None, "b c") == 0


def test_statuses(spark):
    df = spark.range(1).select(
        similarity.parent_status(F.lit(90.0), F.lit(True), F.lit(True)).alias("a"), similarity.parent_status(F.lit(90.0), F.lit(False), F.lit(True)).alias("b"),
        similarity.parent_status(F.lit(10.0), F.lit(False), F.lit(False)).alias("c"), similarity.attribute_status(F.lit(85.0)).alias("d"), similarity.attribute_status(F.lit(49.9)).alias("e"),
    )
    assert tuple(df.first()) == ("Full match", "Partial match", "Not matched", "Full match", "Not matched")


def test_schema_keywords(spark):
    cases = [("Range", None, ["int", "1", "5.0"], {"minimum": "1", "maximum": "5"}), ("StringLength", None, ["80", "MinimumLength=2"], {"maxLength": "80", "minLength": "2"}), ("minItems", "1", [], {"minItems": "1"}), ("RegularExpression", None, ["^x$"], {"pattern": "^x$"}), ("Required", None, [], {})]
    df = spark.createDataFrame([(r, v, vs) for r, v, vs, _ in cases], "r string, v string, vs array<string>")
    assert [x.k for x in df.select(text.schema_keywords("r", "v", "vs").alias("k")).collect()] == [c[3] for c in cases]
    assert one(spark, text.published_type("c0"), "List[Guid]") == "array" and one(spark, text.published_type("c0"), "Int32?") == "integer"


def test_case_folding_of_every_character(spark):
    characters = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = spark.createDataFrame([(c,) for c in [*characters, "ΑΣ", "ὈΔΥΣΣΕΎΣ Straße", "İSTANBUL", "ﬁN", "ABCß", "ſo…ſ"]], "c string")
    assert not [r.c for r in texts.select("c", text.casefold("c").alias("f")).collect() if r.f != r.c.casefold()]
    assert spark.createDataFrame([(None,)], "c string").select(text.casefold("c").alias("f")).first().f is None


def test_rounding_is_exact(spark):
    import math
    import random

    rng = random.Random(1)
    values = [0.25, 2.675, 0.5, 1.5, 2.5, -0.25, -0.04, 0.05, 0.15, 0.35, 1e300, 5e-324, 0.0, -0.0, 1e15 + 0.3, 4503599627370497.5, 2.0**52 + 1, float("inf")]
    values += [rng.randint(0, 10**7) / rng.choice([2, 4, 8, 16, 20, 40, 100, 1000]) for _ in range(200_000)] + [rng.uniform(-1e6, 1e6) for _ in range(200_000)] + [math.ldexp(rng.getrandbits(53), rng.randint(-60, -5)) for _ in range(200_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 6):
        for r in df.select("x", text.rounded("x", digits).alias("y")).toPandas().itertuples():
            assert r.y == (r.x if math.isinf(r.x) else round(r.x, digits)) or abs(r.x) * 10**digits >= 2**51, r
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(text.rounded("x", 1).alias("y")).collect()
    assert odd[0].y is None and math.isnan(odd[1].y)


def test_token_counts_equal_a_plain_merge_loop(spark):
    import random

    from specweave.functions import tokens

    rng = random.Random(4)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 900:
        a, b = rng.choice(list(ranks)), rng.choice([x for x in ranks if x < b"\x80"])
        if all(32 <= c < 127 for c in a + b) and len(a + b) < 8:
            ranks.setdefault(a + b, len(ranks))

    def plain(word):
        parts = [bytes([c]) for c in word]
        while True:
            best = None
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best[0]):
                    best = rank, i
            if best is None:
                return 1 if word in ranks else len(parts)
            parts = [*parts[: best[1]], parts[best[1]] + parts[best[1] + 1], *parts[best[1] + 2 :]]

    import regex

    texts = [(i, "".join(rng.choice("abcdefgh '.,1é\n ") for _ in range(rng.randint(0, 200)))) for i in range(150)] + [(900, None), (901, "It's 12345 tests\r\n\n  x")]
    want = {i: sum(plain(w.encode()) for w in regex.findall(tokens.WORDS, t or "")) for i, t in texts}
    table = spark.createDataFrame([(bytearray(k), v) for k, v in ranks.items()], "token binary, rank long")
    got = tokens.token_counts(spark.createDataFrame(texts, "id long, text string"), "id", "text", table)
    assert {r.id: r.tokens for r in got.collect()} == want

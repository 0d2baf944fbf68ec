"""Keys and values of YAML texts by a fold over their lines, as column expressions.

Covers what configuration is written in: block mappings and sequences, plain and quoted scalars, flow
collections (kept as text), literal and folded blocks, comments, one document a text. Lines that belong to a
block, a flow collection or a quoted scalar begun above are told first; the others become tokens (a dash, a
key with or without a value, a scalar), and a stack of open levels by indentation gives each its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions.text import let

FACTS = "array<struct<path:string,value:string>>"
_LEVEL = "struct<indent:int,kind:string,key:string,n:int,open:boolean>"
#: Body of a line up to a comment; quoted strings hide #.
_BODY = r"""^((?:"(?:[^"\\]|\\.)*+"|'[^']*+'|[^"'#]++|(?<=[^\s])#|["'])*+).*$"""
_PAIR = r"""^("[^"]*"|'[^']*'|[^\s\[\]{},#&*!|>%@`"'-][^#]*?|-[^\s#][^#]*?|<<) *:(?: +(.*))?$"""
_QUOTED = r"""(?:"(?:[^"\\]|\\.)*+"|'(?:[^']|'')*+')"""


def _body(line: Column) -> Column:
    return F.rtrim(F.when(line.rlike(r"^\s*#"), "").when(F.contains(line, F.lit("#")), F.regexp_replace(line, _BODY, "$1")).otherwise(line))


def _lines(text: Column) -> Column:
    """(no, indent, body, raw, lead, hangs, depth, quote) of each line: lead is where its content begins after dashes; what it leaves open."""
    raw = F.split(F.regexp_replace(F.regexp_replace(text, "^\uFEFF", ""), "\r\n?", "\n"), "\n")

    def one(line: Column, no: Column) -> Column:
        def described(body: Column) -> Column:
            indent = F.length(F.regexp_extract(line, "^ *", 0))
            lead = F.length(F.regexp_extract(body, r"^ *(?:- +)*", 0))
            # brackets count only where a flow collection begins the value
            value = F.regexp_replace(F.substring(body, lead + 1, F.length(body)), r"^(?:[^\s\[\]{},#&*!|>%@`\"'-][^#]*?|\"[^\"]*\"|'[^']*') *: +", "")
            count = lambda c: F.when(c.rlike(r"[\[\]{}]"), F.length(F.regexp_replace(c, r"[\]}]", "")) - F.length(F.regexp_replace(c, r"[\[{]", ""))).otherwise(0)
            bare = lambda c: F.when(c.rlike("[\"']"), F.regexp_replace(c, _QUOTED, "")).otherwise(c)

            def valued(v: Column) -> Column:
                depth = F.when(v.rlike(r"^[\[{]"), let(bare(v), count)).when(v.rlike(r"^[\]},%@`]"), -1).otherwise(0)  # no scalar begins with these
                quote = F.when(v.rlike("^[\"']") & ~v.rlike("^" + _QUOTED), F.substring(v, F.lit(1), F.lit(1))).otherwise("")
                return F.struct(
                    no.alias("no"), indent.alias("indent"), body.alias("body"), line.alias("raw"), lead.alias("lead"), body.rlike(r"(?:^|[:\-]) *(?:[&!]\S+ +)*[|>][+\-0-9]*$").alias("hangs"),
                    depth.alias("depth"), quote.alias("quote"), let(bare(body), count).alias("brackets"),
                )

            return let(value, valued)

        return let(_body(line), described)

    return F.transform(raw, one)


def _continued(lines: Column) -> Column:
    """(kinds, depth, quote): of each line whether it goes on with what is above (1 a block's line, 2 a flow collection or quoted scalar), and what is open at the end."""
    state = "struct<kinds:array<int>,held:int,depth:int,quote:string>"
    start = F.struct(F.array().cast("array<int>").alias("kinds"), F.lit(-1).alias("held"), F.lit(0).alias("depth"), F.lit("").alias("quote"))

    def step(s: Column, x: Column) -> Column:
        within = (s["held"] >= 0) & ((F.trim(x["raw"]) == "") | (x["indent"] > s["held"]))
        flow, quoted = s["depth"] > 0, s["quote"] != ""
        closes = F.when(s["quote"] == '"', x["raw"].rlike(r'(?:^|[^\\])"')).otherwise(F.contains(x["raw"], F.lit("'")))
        made = lambda kind, held, depth, quote: F.struct(F.array_append(s["kinds"], F.lit(kind)).alias("kinds"), held.alias("held"), depth.alias("depth"), quote.alias("quote"))
        none, no_quote = F.lit(-1), F.lit("")
        return (
            F.when(flow, made(2, none, F.greatest(s["depth"] + x["brackets"], F.lit(0)), no_quote))
            .when(quoted, made(2, none, F.lit(0), F.when(closes, "").otherwise(s["quote"])))
            .when(within, made(1, s["held"], F.lit(0), no_quote))
            .otherwise(made(0, F.when(x["hangs"], x["lead"] - F.when(x["body"].rlike(r"- *(?:[&!]\S+ +)*[|>][+\-0-9]*$") & (x["lead"] > x["indent"]), 1).otherwise(0)).otherwise(-1), F.greatest(x["depth"], F.lit(0)), x["quote"]))
        ).cast(state)

    return F.aggregate(lines, start.cast(state), step)


def _tokens(line: Column, more: Column) -> Column:
    """A line as tokens (indent, kind, key, value): a dash for each item that begins on it, then its content. ``more`` is the text that goes on below."""
    return let(F.regexp_extract(line["body"], r"^( *(?:- +)*(?:-$)?)", 1), lambda lead: _led(line, lead, more))


def _led(line: Column, lead: Column, more: Column) -> Column:
    """The tokens of a line that begins with ``lead``."""
    dash = lambda k: F.struct((k - 1).cast("int").alias("indent"), F.lit("dash").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    dashes = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(lead), F.lit(1))), lambda k: F.substring(lead, k, F.lit(1)) == "-"), dash)

    def content(c: Column) -> Column:
        def split(x: Column) -> Column:
            value = F.when(x["pair"], F.regexp_extract(c, _PAIR, 2)).otherwise(c)
            text = let(more, lambda m: F.when(m != "", F.concat_ws("\n", value, m)).otherwise(value))
            text = F.regexp_replace(text, r"^(?:[&!][^\s,\[\]{}]*(?: +|$))+", "")  # anchors and tags
            key = F.when(x["pair"], let(F.regexp_extract(c, _PAIR, 1), _unquoted))
            token = lambda v: F.struct(F.length(lead).cast("int").alias("indent"), F.when(x["pair"], "pair").otherwise("scalar").alias("kind"), key.alias("key"), F.when(v != "", _unquoted(v)).alias("value"))
            return F.array(let(text, token))

        return F.when(c == "", F.array().cast("array<struct<indent:int,kind:string,key:string,value:string>>")).otherwise(let(F.struct(c.rlike(_PAIR).alias("pair")), split))

    return F.concat(dashes, let(F.substring(line["body"], F.length(lead) + 1, F.length(line["body"])), content))


def _unquoted(text: Column) -> Column:
    double = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('\\"'), F.lit('"'))
    single = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("''"), F.lit("'"))
    return F.when(text.rlike(r'(?s)^".*"$'), double).when(text.rlike(r"(?s)^'.*'$"), single).otherwise(text)


def _fold(tokens: Column) -> Column:
    """(stack, facts, wrong) of all tokens: facts by path, wrong once a line does not fit the levels above it."""
    kind = f"struct<stack:array<{_LEVEL}>,facts:{FACTS},wrong:boolean>"
    start = F.struct(F.array().cast(f"array<{_LEVEL}>").alias("stack"), F.array().cast(FACTS).alias("facts"), F.lit(False).alias("wrong")).cast(kind)
    level = lambda t, what, key, n, is_open: F.struct(t["indent"].alias("indent"), F.lit(what).alias("kind"), key.cast("string").alias("key"), n.cast("int").alias("n"), is_open.alias("open"))

    def step(s: Column, t: Column) -> Column:
        def at(x: Column) -> Column:
            own, top = x["own"], x["top"]
            below = F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
            closed = F.when(F.size(own) > 0, F.array_append(below, F.struct(top["indent"].alias("indent"), top["kind"].alias("kind"), top["key"].alias("key"), top["n"].alias("n"), F.lit(False).alias("open")).cast(_LEVEL))).otherwise(own)
            first, nested = top.isNull(), top["open"] & (t["indent"] > top["indent"])
            same = lambda what: (top["kind"] == what) & (top["indent"] == t["indent"])
            path = lambda stack: F.array_join(F.transform(stack, lambda e: F.when(e["kind"] == "seq", e["n"].cast("string")).otherwise(e["key"])), "/")
            made = lambda stack, facts, wrong=s["wrong"]: F.struct(stack.alias("stack"), facts.alias("facts"), wrong.alias("wrong")).cast(kind)
            fact = lambda stack: F.array_append(s["facts"], F.struct(path(stack).alias("path"), t["value"].alias("value")))
            pushed = lambda stack, new, keep: let(F.array_append(stack, new.cast(_LEVEL)), lambda st: made(st, fact(st) if keep else s["facts"]))
            item = level(t, "seq", F.lit(None), F.when(same("seq"), top["n"] + 1).otherwise(0), F.lit(True))
            pair = level(t, "map", t["key"], F.lit(0), t["value"].isNull())
            dashes = F.when(same("seq"), pushed(below, item, False)).when(first | nested | (top["open"] & same("map")), pushed(closed, item, False)).otherwise(made(own, s["facts"], F.lit(True)))
            pairs = F.when(same("map"), pushed(below, pair, True)).when(first | nested, pushed(closed, pair, True)).otherwise(made(own, s["facts"], F.lit(True)))
            going_on = ~top["open"] & (t["indent"] > top["indent"])  # a plain scalar over several lines
            scalars = F.when(first & (F.size(s["facts"]) == 0), made(own, fact(own))).when(nested, made(closed, fact(own))).when(going_on, made(own, s["facts"])).otherwise(made(own, s["facts"], F.lit(True)))
            return F.when(t["kind"] == "dash", dashes).when(t["kind"] == "pair", pairs).otherwise(scalars)

        reached = F.filter(s["stack"], lambda e: e["indent"] <= t["indent"])
        last = F.try_element_at(reached, F.lit(-1))
        # a sequence may stand as far left as the key that holds it; a key there ends it
        own = F.when((t["kind"] != "dash") & (last["kind"] == "seq") & (last["indent"] == t["indent"]), F.slice(reached, 1, F.greatest(F.size(reached) - 1, F.lit(0)))).otherwise(reached)
        return let(let(own, lambda o: F.struct(o.alias("own"), F.try_element_at(o, F.lit(-1)).alias("top"))), at)

    return F.aggregate(tokens, start, step)


def parsed(text: Column) -> Column:
    """(wrong, facts): whether a text is no YAML of one document, and (path, value) of each key and item in order.

    Paths join keys and places of items by /. A key that holds a mapping, a sequence or nothing has a null value; values are
    texts, flow collections and blocks as they are written, without the indentation of blocks. An empty text has no facts and is not wrong.
    """

    def of(x: Column) -> Column:
        lines, kinds, end = x["lines"], x["state"]["kinds"], x["state"]
        kept = F.filter(lines, lambda l, i: (F.get(kinds, i) == 0) & (F.trim(l["body"]) != "") & ~l["body"].rlike(r"^(?:---|\.\.\.|%\S.*)$"))  # noqa: E741
        follows = lambda l: F.filter(lines, lambda m, j: (m["no"] > l["no"]) & (F.get(kinds, j) > 0))  # noqa: E731, E741

        def tokens(l: Column) -> Column:  # noqa: E741
            # the lines right below that go on with this one: as many as stand before the next line that does not
            next_own = F.array_min(F.transform(F.filter(lines, lambda m, j: (m["no"] > l["no"]) & (F.get(kinds, j) == 0)), lambda m: m["no"]))
            below = F.filter(follows(l), lambda m: next_own.isNull() | (m["no"] < next_own))
            more = F.regexp_replace(F.array_join(F.transform(below, lambda m: F.trim(m["raw"])), "\n"), "\n+$", "")
            return _tokens(l, F.when(l["hangs"] | (l["depth"] > 0) | (l["quote"] != ""), more).otherwise(""))

        def judged(f: Column) -> Column:
            marks = F.filter(lines, lambda l, i: (F.get(kinds, i) == 0) & l["body"].rlike("^---(?: .*)?$"))  # noqa: E741
            second = F.exists(marks, lambda m: F.exists(kept, lambda l: l["no"] < m["no"]))  # noqa: E741
            tab = F.exists(kept, lambda l: l["raw"].rlike(r"^ *\t"))  # noqa: E741
            bad = F.exists(kept, lambda l: l["depth"] < 0)  # noqa: E741
            return F.struct((f["wrong"] | second | tab | bad | (end["depth"] > 0) | (end["quote"] != "")).alias("wrong"), f["facts"].alias("facts"))

        return let(_fold(F.flatten(F.transform(kept, tokens))), judged)

    return let(let(_lines(text), lambda ls: F.struct(ls.alias("lines"), _continued(ls).alias("state"))), of)


def spread(files: DataFrame) -> DataFrame:
    """Files dealt to all cores: a table of short rows is read by a task or two, however long each row takes."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism)


def yaml_facts(files: DataFrame) -> DataFrame:
    """(path, key, value) of YAML files (path, text); nothing of those that are null or do not parse."""
    facts = let(parsed(F.col("text")), lambda y: F.when(~y["wrong"], y["facts"]))
    rows = spread(files.select("path", "text")).select("path", F.inline_outer(facts)).toDF("path", "key", "value")  # outer: a plain one is preceded by a filter that parses again
    return rows.filter("key is not null")

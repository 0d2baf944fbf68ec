"""URL rules whose block decisions reach every alias of a page.

Urls that lead to one another by a redirect or a canonical link are one page. Rules
decide urls; a block also reaches the other members of its connected component, and
an url that an allow rule names keeps its allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .components import components

#: (verdict, host, path prefix). A driver-side setting, compiled into one expression.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """host (A-Z lowered), path and query (with its ?) of an url; empty without ://, or if null."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, r"^(?s).*?://" + pattern, 1), F.lit(""))
    return ascii_lower(part(r"([^/?#]*)")), part(r"[^/?#]*([^?#]*)"), part(r"[^/?#]*[^?#]*(\?[^#]*)")


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; allow wins a tie."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))
    rule = verdict = None
    for what, h, p in longest_first:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def alias_key(host: Column, path: Column, query: Column) -> Column:
    """What two spellings of one address share: no scheme, no fragment, an empty path is /."""
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


#: What a tag consists of: attributes, of which quoted values may hold >, and the > that ends it. No pattern repeats a group, so long tags take no stack.
PARTS = r"""(?is)[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)|>"""
#: What is no markup: comments, and the text of elements that hold none.
HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(script|style|textarea|title|template|noscript|xmp)\b[^>]*>.*?(?:</\1\s*>|$)"


def _tags(html: Column, name: str) -> Column:
    """The attributes of every tag of a name, as an array of maps from lower-case name to value without quotes; the first of a name counts."""
    pieces = F.filter(F.split(html, "<"), lambda p: p.rlike(rf"^(?i:{name})[\s/]"))

    def attributes(piece: Column) -> Column:
        parts = F.regexp_extract_all(piece, F.lit(PARTS), F.lit(0))
        own = F.slice(parts, 1, F.greatest(F.array_position(parts, ">").cast("int") - 1, F.lit(0)))
        pairs = F.transform(own, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("n"), F.regexp_replace(x, r"""(?s)^[^=]*=\s*(?:"(.*)"|'(.*)'|(.*))$""", "$1$2$3").alias("v")))
        names = F.transform(pairs, lambda x: x["n"])
        first = F.filter(pairs, lambda x, i: F.array_position(names, x["n"]) == i + 1)
        return F.map_from_entries(first)

    return F.transform(pieces, attributes)


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) for each canonical link of a page and each redirect by meta refresh.

    Comments and the text of scripts, styles and their like hold no tags. A link counts if canonical is
    one of the words of its rel, whatever their case; quotes or none, every tag, attributes in any order.
    """
    pages = pages.filter(F.col("html").rlike("(?i)canonical|refresh"))  # no other page has a link
    html = F.regexp_replace(F.col("html"), HIDDEN, " ")
    canonical = F.filter(_tags(html, "link"), lambda m: F.array_contains(F.split(F.lower(F.coalesce(m["rel"], F.lit(""))), r"\s+"), "canonical"))
    refresh = F.filter(_tags(html, "meta"), lambda m: F.lower(F.trim(F.coalesce(m["http-equiv"], F.lit("")))) == "refresh")
    to = F.transform(refresh, lambda m: F.regexp_extract(F.coalesce(m["content"], F.lit("")), r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*[\"']?([^\"'\s]+)", 1))
    links = pages.select(F.col("url").alias("from_url"), F.explode(F.concat(F.transform(canonical, lambda m: F.coalesce(m["href"], F.lit(""))), to)).alias("to_url"))
    links = links.filter("from_url is not null and trim(to_url) != ''").distinct()
    return links.select("from_url", F.trim(F.regexp_replace("to_url", "&amp;", "&")).alias("to_url"))


def absolute(base: Column, target: Column) -> Column:
    """``target`` as found on a page at ``base``; null where it names no other document."""
    site, folder = F.regexp_extract(base, r"^(?s).*?://[^/?#]*", 0), F.regexp_extract(base, r"^(?s).*?://[^/?#]*(/(?:[^?#]*/)?)", 1)
    return (
        F.when(F.contains(target, F.lit("://")), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and decided_by of every row of ``pages`` (page_id, url, html).

    verdict is the rule's where one fits (decided_by rule), else block if any url that
    redirects or canonical links connect with this one falls under a block rule
    (decided_by alias), else allow (decided_by default). redirects may add a table of
    (from_url, to_url). Rows are judged by themselves, so repeated rows and page_ids are
    all returned. A null url, or one without ://, has no host, fits no rule and is
    allowed; a null html has no links; other columns of ``pages`` are not looked at.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url").filter("from_url is not null and to_url is not null"))
    links = links.select("from_url", absolute(F.col("from_url"), F.col("to_url")).alias("to_url")).filter("to_url is not null").distinct()
    ends = [alias_key(*url_parts(F.col(c))) for c in ("from_url", "to_url")]
    edges = links.select(ends[0].alias("a"), ends[1].alias("b")).filter("a is not null and b is not null and a != b")
    parts = components(edges)
    node_host = F.regexp_extract("node", r"^[^/?#]*", 0)
    node_path = F.regexp_extract(F.substring(F.col("node"), F.length(node_host) + 1, F.length("node")), r"^[^?#]*", 0)
    judged = parts.withColumn("node_verdict", match_rule(node_host, node_path, rules)[1])
    bad = judged.filter("node_verdict = 'block'").select("component").distinct()
    reached = parts.join(bad, "component", "left_semi").select(F.col("node").alias("alias"))
    host, path, query = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), alias_key(host, path, query).alias("key"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    rows = rows.join(reached, F.when(F.col("rule").isNull(), F.col("key")) == F.col("alias"), "left")
    spread = F.when(F.col("alias").isNotNull(), "block").otherwise("allow")
    by = F.when(F.col("ruled").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", spread).alias("verdict"), by.alias("decided_by"))

"""The queries over the corpus operators, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import repair
from .common import table
from .decontamination import find_leaks
from .fill_middle import fill_report
from .language_id import identify
from .merkle import merkle_report
from .mixing import mix_report
from .nearest import nearest
from .pii import find_pii
from .quality import judge
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .url_filter import filter_urls
from .warc import warc_report


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_report(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_report(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_nearest": op6_nearest,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_mix": op9_mix,
    "op10_url_filter": op10_url_filter,
    "op11_merkle": op11_merkle,
    "op12_fill_middle": op12_fill_middle,
    "op13_warc": op13_warc,
}

_OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM src),
weighed AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[place % 3 + 1] AS weight, ([-0.5, 0.0, 0.5]::DOUBLE[])[place % 3 + 1] AS ramp,
         source_size * 2.0::DOUBLE AS most
  FROM placed),
filling AS (
  SELECT *, most / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
         coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
         sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed),
lev AS (SELECT first(level ORDER BY ratio, place) AS level
        FROM (SELECT ratio, place, (budget - filled) / rest AS level FROM filling) WHERE ratio > level),
targets AS (
  SELECT source, source_size, ramp, least(most, coalesce((SELECT level FROM lev) * weight, most)) AS target FROM filling),
laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.ramp, CAST(round(t.target) AS BIGINT) AS wanted,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY
           CAST('0x' || substr(s.k, 1, 4) AS INT) % 1024, s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, greatest(0, least(size, wanted - start)) AS one, greatest(0, least(size, wanted - start - source_size)) AS two FROM laid)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
       CASE WHEN one > 0 THEN CASE WHEN ramp = 0 THEN start / target
            ELSE (sqrt((1 - ramp) * (1 - ramp) + ramp * (start / target) * 4.0) - (1 - ramp)) / (ramp * 2.0) + 0.0 END END AS first_position
FROM took
"""

_OP10 = r"""
WITH RECURSIVE
marked AS (
  SELECT url, unnest(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?(-->|\z)', ' ', 'g'),
           '(?is)<(?:script\b.*?</script|style\b.*?</style|textarea\b.*?</textarea|title\b.*?</title|template\b.*?</template|noscript\b.*?</noscript|xmp\b.*?</xmp)\s*>', ' ', 'g'), '<')) AS piece
  FROM pages WHERE url IS NOT NULL),
parsed AS (
  SELECT url, lower(substr(piece, 1, 4)) AS tag, list_transform(regexp_extract_all(substr(piece, 5), '[^\s"''>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'),
           lambda x: {'n': lower(trim(split_part(x, '=', 1))), 'v': trim(trim(substr(x, instr(x, '=') + 1)), '"''')}) AS atts
  FROM marked WHERE lower(substr(piece, 1, 4)) IN ('link', 'meta') AND substr(piece, 5, 1) IN (' ', chr(9), chr(10), chr(13), '/')),
named AS (SELECT url, tag, map_from_entries(list_transform(list_distinct(list_transform(atts, lambda x: x.n)), lambda n: row(n, list_filter(atts, lambda x: x.n = n)[1].v))) AS m FROM parsed),
links AS (
  SELECT url AS f, m['href'] AS t FROM named WHERE tag = 'link' AND list_contains(regexp_split_to_array(lower(m['rel']), '\s+'), 'canonical')
  UNION SELECT url, regexp_extract(m['content'], '(?i)url\s*=\s*["'']?([^"''\s]+)', 1) FROM named WHERE tag = 'meta' AND lower(trim(m['http-equiv'])) = 'refresh'),
targets AS (
  SELECT f, CASE WHEN t LIKE '%://%' THEN t WHEN t LIKE '//%' THEN 'http:' || t
                 WHEN t LIKE '/%' THEN regexp_extract(f, '(?s)^.*?://[^/?#]*', 0) || t
                 WHEN t LIKE '#%' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                 ELSE regexp_extract(f, '(?s)^.*?://[^/?#]*', 0)
                      || coalesce(nullif(regexp_extract(f, '(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || t END AS t
  FROM (SELECT f, trim(replace(t, '&amp;', '&')) AS t FROM links WHERE trim(t) <> '')),
urls AS (SELECT f AS u FROM targets UNION SELECT t FROM targets WHERE t IS NOT NULL UNION SELECT url FROM pages WHERE url IS NOT NULL),
parts AS (
  SELECT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(u, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query
  FROM urls),
rules(what, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                             ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ruled AS (
  SELECT u, host, path, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node,
         (SELECT first(h || p ORDER BY length(h || p) DESC, what) FROM rules
          WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p)) AS rule,
         (SELECT first(what ORDER BY length(h || p) DESC, what) FROM rules
          WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p)) AS verdict
  FROM parts),
edges AS (
  SELECT a.node AS a, b.node AS b FROM targets JOIN ruled a ON a.u = f JOIN ruled b ON b.u = t WHERE a.node <> b.node
  UNION SELECT b.node, a.node FROM targets JOIN ruled a ON a.u = f JOIN ruled b ON b.u = t WHERE a.node <> b.node),
reach(node) AS (
  SELECT DISTINCT node FROM ruled WHERE verdict = 'block' AND node IN (SELECT a FROM edges)
  UNION SELECT e.b FROM reach r JOIN edges e ON e.a = r.node)
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule,
       coalesce(r.verdict, CASE WHEN r.node IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN r.rule IS NOT NULL THEN 'rule' WHEN r.node IN (SELECT node FROM reach) THEN 'alias' ELSE 'default' END AS decided_by
FROM pages p LEFT JOIN ruled r ON p.url = r.u
"""

_OP11 = r"""
WITH RECURSIVE made AS (
  SELECT doc_id, lang, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS f, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda u, v: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END)), 4294967295) AS crc
  FROM documents),
fields AS (
  SELECT *, array_to_string(list_transform(f, lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), '') AS head, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM made),
leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low)::VARCHAR || ':' || low, '-')) END AS forged, lang
  FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM placed UNION ALL
  SELECT tree, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, level, place // 8, n),
subroots AS (SELECT tree, digest, level AS h, count(*) OVER () AS trees FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS place, trees AS n, digest FROM subroots UNION ALL
  SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, place // 8, n),
steps AS (
  SELECT p.doc_id, p.leaf, x.level AS step, string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place < p.place // (8 ** x.level)::BIGINT) AS l, string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place > p.place // (8 ** x.level)::BIGINT) AS r
  FROM placed p JOIN nodes x ON x.tree = p.tree AND x.n > 1 AND x.place // 8 = (p.place // (8 ** x.level)::BIGINT) // 8 GROUP BY ALL
  UNION ALL
  SELECT p.doc_id, p.leaf, 100 + x.level, string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place < p.tree // (8 ** x.level)::BIGINT), string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place > p.tree // (8 ** x.level)::BIGINT)
  FROM placed p JOIN tops x ON x.n > 1 AND x.place // 8 = (p.tree // (8 ** x.level)::BIGINT) // 8 GROUP BY ALL),
ways AS (SELECT doc_id, leaf, list(struct_pack(l := coalesce(l, ''), r := coalesce(r, '')) ORDER BY step) AS w FROM steps GROUP BY ALL),
walk AS (
  SELECT p.doc_id, p.leaf, tree, coalesce(w, []) AS w, 1 AS k, coalesce(forged, p.leaf) AS acc FROM placed p LEFT JOIN ways USING (doc_id, leaf) UNION ALL
  SELECT doc_id, leaf, tree, w, k + 1, sha256(w[k].l || acc || w[k].r) FROM walk WHERE k <= len(w))
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(array_to_string(list_transform(w, lambda x: x.l || x.r), '')) AS proof_sha256, acc AS folded_root, acc = t.digest AS verified
FROM walk JOIN subroots s USING (tree) CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t WHERE k > len(w)
"""

_OP12 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(tokens) + 1) AS u1, CAST('0x' || h[9:16] AS BIGINT) % (len(tokens) + 1) AS u2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(tokens[1:least(u1, u2)], '') AS p, array_to_string(tokens[least(u1, u2) + 1:greatest(u1, u2)], '') AS m,
         array_to_string(tokens[greatest(u1, u2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM parts
"""

_OP13 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id, row_number() OVER (PARTITION BY html ORDER BY page_id) AS k FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN first_id END AS refers_to, TRUE AS intact
FROM f
"""

ORACLE_SQL: dict[str, str] = {"op11_merkle": _OP11, "op13_warc": _OP13, "op12_fill_middle": _OP12, "op9_mix": _OP9, "op10_url_filter": _OP10}

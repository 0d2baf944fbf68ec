"""Token counts by byte-pair merges in the order of a rank table that the caller gives."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a rank table that may go to every task.
MOST_RANKS = 1_000_000
#: Words: letters with the mark or space before them, up to three figures, signs, white space. A caller with another table gives its own.
WORDS = r"""(?i:'(?:s|t|re|ve|m|ll|d))|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""


def merged(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens a word has: of neighbouring parts those that make the token of the lowest rank are joined, the first of equal ones, while any do."""
    if word in ranks:
        return 1
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts)


def token_counts(texts: DataFrame, key: str, column: str, ranks: DataFrame, words: str = WORDS) -> DataFrame:
    """(key, tokens): the tokens of each row of ``texts``; ranks (token binary, rank), one row a token.

    Texts are split into words by Spark; each different word is merged once and joined back, so no Python sees a text.
    Rows that repeat a key are added up; a null text has no tokens.
    """
    table = ranks.select("token", "rank").limit(MOST_RANKS + 1).toArrow()
    if table.num_rows > MOST_RANKS:
        raise ValueError(f"a rank table has {MOST_RANKS} entries at most")
    known = dict(zip(table.column("token").to_pylist(), table.column("rank").to_pylist(), strict=True))
    shared = texts.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("long")
    def size(word: pd.Series) -> pd.Series:
        count = lru_cache(1 << 16)(lambda w: merged(w.encode("utf-8", "surrogatepass"), shared.value))
        return word.map(count)

    split = texts.select(key, F.explode_outer(F.regexp_extract_all(F.col(column), F.lit(words), F.lit(0))).alias("_w"))
    by_row = split.groupBy(key, "_w").agg(F.count("*").alias("_n"))
    sizes = by_row.select("_w").filter("_w is not null").distinct().withColumn("_t", size("_w"))
    counted = by_row.join(sizes, "_w", "left")
    return counted.groupBy(key).agg(F.sum(F.coalesce(F.col("_n") * F.col("_t"), F.lit(0))).alias("tokens"))

"""Writing artifacts, runs, versions and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.functions.text import mermaid_text

from .publish import append_version, latest


def write_artifact(df: DataFrame, path: str) -> None:
    """A table as JSON lines, in place of what was there; the commit protocol makes it all or nothing."""
    df.write.mode("overwrite").json(path)


def write_snapshot(tables: dict[str, DataFrame], root: str, snapshot: str) -> None:
    """Tables of one immutable snapshot, a folder each; a snapshot that exists is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{snapshot}/{name}")


def submit_version(versions: DataFrame, content: DataFrame, by: list[str], path: str) -> DataFrame:
    """Append ``content`` with the next version of its key. One writer at a time, as with any file table."""
    new = append_version(versions, by, content)
    new.write.mode("append").parquet(path)
    return new


def upsert(drafts: DataFrame, new: DataFrame, by: list[str], order: str) -> DataFrame:
    return latest(drafts.unionByName(new), by, order)


def lineage_graph(truth: DataFrame) -> DataFrame:
    """(line): a Mermaid graph of sources (source, target, action): each node once, merged sources dotted, lines in order."""
    nodes = truth.select(F.col("source").alias("n")).unionByName(truth.select(F.col("target").alias("n"))).distinct()
    label = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(F.col(c).cast("binary"), 256), 1, 12))
    boxes = nodes.select(F.lit(1).alias("o"), F.concat(F.lit("  "), label("n"), F.lit('["'), mermaid_text("n"), F.lit('"]')).alias("line"))
    arrow = F.when(F.col("action") == "Retained", " --> ").otherwise(" -. merged .-> ")
    edges = truth.select(F.lit(2).alias("o"), F.concat(F.lit("  "), label("source"), arrow, label("target")).alias("line")).distinct()
    head = truth.sparkSession.createDataFrame([(0, "graph LR")], "o int, line string")
    return head.unionByName(boxes).unionByName(edges).orderBy("o", "line").select("line")


def workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Each sheet as one CSV with a header; there is no spreadsheet writer here."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def append_log(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def delete_run(spark, root: str, run_id: str, expected: list[str]) -> bool:
    """Remove a saved run if its folder holds exactly the expected files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{run_id}")
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder) or sorted(s.getPath().getName() for s in fs.listStatus(folder)) != sorted(expected):
        return False
    return fs.delete(folder, True)

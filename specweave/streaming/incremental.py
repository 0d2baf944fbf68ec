"""Incremental scans: new documents as they arrive. An extension; batch is the reference behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.sources import openapi


def arriving(spark: SparkSession, root: str, pattern: str = "*.json", each: int = 100) -> DataFrame:
    """(document, text) of files as they appear below ``root``, ``each`` a batch at most."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", each).option("pathGlobFilter", pattern).schema("value string").load(root)
    return raw.select(F.input_file_name().alias("document"), F.col("value").alias("text"))


def follow(documents: DataFrame, out: str, checkpoint: str):
    """Facts of arriving documents appended to ``out``; stops when there is nothing new."""
    return openapi.scan(documents).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

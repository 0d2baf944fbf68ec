"""Scanning source trees, archives and saved runs as tables."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType

from specweave.functions.text import redacted
from specweave.operators.ranking import first_files

# What a scan reads and what it leaves out.
SUFFIXES = (".cs", ".cshtml", ".razor", ".csproj", ".json", ".yaml", ".yml", ".config")
FOLDERS = (".git", ".vs", ".venv", ".tmp", ".rag", ".pytest_cache", ".ruff_cache", "__pycache__", "bin", "obj", "node_modules", "packages")
GENERATED = (".g.cs", ".generated.cs", ".designer.cs")
SECRETS = ("secrets.json",)
#: Bounds of an archive: bytes, entries, bytes when expanded.
ARCHIVE_BYTES, ARCHIVE_ENTRIES, ARCHIVE_EXPANDED = 100 << 20, 20_000, 500 << 20


def wanted(path: Column) -> Column:
    """Whether a path below the root is read: its suffix is known, no folder of it is left out, it isn't generated or a secret."""
    p, name = F.lower(path), F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = lambda names: p.rlike("(" + "|".join(s.replace(".", r"\.") for s in names) + ")$")
    return suffix(SUFFIXES) & ~suffix(GENERATED) & ~name.isin(*SECRETS) & ~F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, FOLDERS)))


def decoded(content: str) -> Column:
    """Bytes as the text they are in UTF-8, without a byte order mark; null if they are none."""
    return F.regexp_replace(F.try_validate_utf8(F.col(content).cast("string")), "^\uFEFF", "")


@F.pandas_udf(BooleanType())
def _linked(path: pd.Series, root: pd.Series) -> pd.Series:
    """Whether a local path is a link or lies below one, seen from its root."""
    plain = lambda p: "/" + unquote(p.removeprefix("file:")).lstrip("/")

    def below(p: str, r: str) -> bool:
        top = os.path.normpath(plain(r))
        return os.path.realpath(plain(p)) != os.path.join(os.path.realpath(top), os.path.relpath(os.path.normpath(plain(p)), top))

    return pd.Series([below(p, r) for p, r in zip(path, root, strict=True)], dtype=bool)


def scan(spark: SparkSession, root: str, **caps) -> tuple[DataFrame, DataFrame]:
    """(files, gaps) below ``root``: path, sha256 of the raw bytes, text with secrets redacted; and what was not read, with its reason.

    Files over the caps and undecodable ones are gaps, not errors; links are not followed. Contents are read only of files that pass.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted(base) + "/", "")
    # what lies behind a link is left out, as far as a file system has links
    own = raw.filter(~_linked(F.col("path"), F.lit(root))) if root.split(":")[0] == "file" or "://" not in root else raw
    found = own.select(path.alias("path"), "length", "content").filter(wanted(F.col("path")))
    judged = first_files(found.select("path", "length"), **caps)
    kept = found.select("path", "content").join(judged.filter("reason is null").select("path"), "path")
    read = kept.select("path", F.sha2("content", 256).alias("sha256"), decoded("content").alias("text"))
    files = read.filter("text is not null").select("path", "sha256", redacted("text").alias("text"))
    gaps = judged.filter("reason is not null").select("path", "reason").unionByName(read.filter("text is null").select("path", F.lit("not UTF-8").alias("reason")))
    return files, gaps


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


class ZipSource(DataSource):
    """Members of ZIP archives as rows: archive, member, length, content. Option path; one partition an archive.

    An archive beyond the bounds, encrypted or with a member outside its root is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return "archive string, member string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from ((partition.value, *row) for row in zip_members(f.read()))


def zip_members(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(member, length, content) of an archive that keeps to the bounds; ValueError if it doesn't."""
    if len(data) > ARCHIVE_BYTES:
        raise ValueError("archive too large")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if len(infos) > ARCHIVE_ENTRIES or sum(i.file_size for i in infos) > ARCHIVE_EXPANDED:
            raise ValueError("archive has too many entries or expands too far")
        for i in infos:
            name = i.filename.replace("\\", "/")
            if name.startswith("/") or ".." in name.split("/") or name[1:2] == ":":
                raise ValueError(f"unsafe member {i.filename}")
            if i.flag_bits & 1:
                raise ValueError("encrypted member")
            if not i.is_dir():
                yield name, i.file_size, z.read(i)


def read_archives(archives: DataFrame) -> DataFrame:
    """(archive, member, length, content, error) of archives (path, content), as binaryFile reads them from any store."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, *r, None) for r in zip_members(content)]
                except (ValueError, zipfile.BadZipFile) as e:
                    rows = [(path, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "member", "length", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, length long, content binary, error string")


def inventory(members: DataFrame) -> DataFrame:
    """One row an archive: its solutions, projects, controllers, function projects and API descriptions, in order."""
    m, folder = F.col("member"), F.regexp_replace("member", "[^/]*$", "")
    hosts = members.filter(F.col("member").rlike(r"(^|/)host\.json$")).select("archive", folder.alias("_f")).distinct().withColumn("_host", F.lit(True))
    rows = members.filter("member is not null").withColumn("_f", folder).join(hosts, ["archive", "_f"], "left")
    pick = lambda test: F.sort_array(F.collect_list(F.when(test, m)))
    project = m.endswith(".csproj")
    return rows.groupBy("archive").agg(
        pick(m.endswith(".sln")).alias("solutions"), pick(project).alias("projects"), pick(m.rlike(r"Controller\.cs$")).alias("controllers"),
        pick(project & F.coalesce("_host", F.lit(False))).alias("function_projects"), pick(m.rlike(r"(?i)(openapi|swagger)[^/]*\.(json|ya?ml)$")).alias("openapi"),
    )


def saved_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Saved JSON records below ``root`` with the run they belong to; unreadable ones are left out."""
    raw = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("wholetext", True).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    run = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return raw.select("*", run.alias("run_id")).filter("_corrupt is null").drop("_corrupt")


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Extraction results of the code analyser, read under their fixed schema."""
    place = "struct<path:string,startLine:int,endLine:int>"
    schema = (
        "version string, sources array<struct<path:string,sha256:string>>, operations array<struct<name:string,method:string,route:string,requestType:string,"
        f"parameters:array<struct<name:string,type:string,location:string,required:boolean>>,responses:array<struct<statusCode:int,type:string>>,location:{place}>>, "
        "types array<struct<name:string,fullName:string,kind:string,baseType:string,properties:array<struct<name:string,type:string,nullable:boolean,collection:boolean,"
        f"elementType:string,attributes:array<struct<name:string,arguments:array<string>>>,location:{place}>>,enumValues:array<string>,location:{place}>>, diagnostics array<struct<severity:string,code:string,message:string>>"
    )
    return spark.read.schema(schema).option("multiLine", True).json(path)

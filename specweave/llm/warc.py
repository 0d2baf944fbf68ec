"""A deterministic, sharded writer of WARC 1.1 archives as a Spark data source, and its reader.

Records are sorted by id over shards whose bounds follow from the data alone. Within a
shard a file is closed once its compressed size reaches ``file_bytes``. Tasks write files
of temporary names; the driver renames those of the tasks that succeeded and then puts
the manifest in place, which alone says what belongs to the archive. Files of failed,
repeated or lost attempts are never named by it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from specweave.plans.lineage import checkpoint_folder

from .common import small_batches

#: Payloads shorter than this are always written out.
REVISIT_BYTES = 100
#: Bytes of payload in a shard, most shards, and rows whose ids are looked at to bound them. Bounds are all that the driver holds: 33 bytes a shard.
SHARD_BYTES = 16 << 20
MOST_SHARDS = 16_384
BOUND_ROWS = 1 << 17
#: Ways over which the rows of one payload are spread.
SALTS = 16
#: Compressed bytes at which a file is closed.
FILE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "manifest.json"
STANDARD = "http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records -----------------------------------------------------------------------------------


def record_bytes(kind: str, record_id: str, block: bytes, headers: list[tuple[str, str]], date: str = DATE) -> bytes:
    """A record with its lengths and block digest made anew."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers)]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(row: dict, shard: int, place: int, date: str = DATE) -> bytes:
    """The record of a page (page_id, url, html, digest, first_id, revisits), the place-th of its shard. Its HTTP header gives the full payload's length, revisits have no more."""
    payload, page = row["html"], "" if row["page_id"] is None else str(row["page_id"])
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{row['digest']}")]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~")))
    record_id = f"urn:page:{page}:{shard}:{place}"
    if row["revisits"]:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{'' if row['first_id'] is None else row['first_id']}>")]
        return record_bytes("revisit", record_id, head, headers, date)
    return record_bytes("response", record_id, head + payload, headers, date)


def parse_records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of bytes; a record that is cut short or ends otherwise is an error."""
    held = bytearray()

    def more(n: int) -> bool:
        while len(held) < n:
            if not (piece := next(data, b"")):
                return False
            held.extend(piece)
        return True

    while more(1):
        at = -1
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more(len(held) + 1):
                raise ValueError("a record's header is cut short")
        first, *lines = held[:at].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record: {first[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        n = int(headers["Content-Length"])
        if not more(at + 8 + n):
            raise ValueError("a record is cut short")
        block = bytes(held[at + 4 : at + 4 + n])
        if held[at + 4 + n : at + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        del held[: at + 8 + n]
        yield headers, block


def unzipped(source, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file of gzip members, as many as there are."""
    z = zlib.decompressobj(31)
    while piece := source.read(step):
        while piece:
            if out := z.decompress(piece, step):
                yield out
            if z.eof:
                piece, z = z.unused_data, zlib.decompressobj(31)
            else:
                piece = z.unconsumed_tail
    if out := z.flush():
        yield out


# --- files -------------------------------------------------------------------------------------


def file_system(path: str):
    """(file system, path in it) of a folder that driver and executors share: a local path or an URI that Arrow opens (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _put(path: str, name: str, data: bytes) -> None:
    """A small file, whole or not at all."""
    system, folder = file_system(path)
    with system.open_output_stream(f"{folder}/.{name}.tmp") as out:
        out.write(data)
    system.move(f"{folder}/.{name}.tmp", f"{folder}/{name}")


def _get(path: str, name: str) -> bytes:
    system, folder = file_system(path)
    with system.open_input_stream(f"{folder}/{name}") as source:
        return source.read()


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


@dataclass
class ArchiveFile(InputPartition):
    name: str

    def __init__(self, name: str):
        self.name = name


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows (shard, page_id, url, html, digest, first_id, revisits), whole shards in order within a task."""

    def __init__(self, path: str, file_bytes: int, date: str):
        from pyarrow import fs

        self.path, self.file_bytes, self.date, self.write_id = path, file_bytes, date, uuid.uuid4().hex
        system, folder = file_system(path)
        if system.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} has archives; they are written once")
        system.create_dir(f"{folder}/.{self.write_id}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.path)
        done, out, shard, place, attempt = Written(), None, None, 0, uuid.uuid4().hex[:12]

        def close():
            if out is not None:
                out.close()

        for batch in iterator:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    close()
                    out, shard, place, roll = None, row["shard"], 0, 0
                if out is None or about["bytes"] >= self.file_bytes:
                    close()
                    name = f"part-{shard:06d}-{roll:04d}.warc.gz"
                    about = {"name": name, "temporary": f".{self.write_id}/{attempt}-{name}", "records": 0, "bytes": 0}
                    out, roll = system.open_output_stream(f"{folder}/{about['temporary']}", compression=None), roll + 1
                    done.files.append(about)
                    info = f"software: specweave\r\nformat: WARC File Format 1.1\r\nconformsTo: {STANDARD}\r\n".encode()
                    about["bytes"] += out.write(_zipped(record_bytes("warcinfo", f"urn:file:{name}", info, [("Content-Type", "application/warc-fields"), ("WARC-Filename", name)], self.date)))
                about["bytes"] += out.write(_zipped(page_record(row, shard, place, self.date)))
                about["records"] += 1
                place += 1
        close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        if len({f["name"] for f in files}) != len(files):
            raise ValueError("a shard was written by two tasks")
        for f in files:
            system.move(f"{folder}/{f.pop('temporary')}", f"{folder}/{f['name']}")
        _put(self.path, MANIFEST, json.dumps({"version": 1, "files": files}, indent=1).encode())
        system.delete_dir(f"{folder}/.{self.write_id}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        system.delete_dir(f"{folder}/.{self.write_id}")


def _zipped(record: bytes) -> bytes:
    """One gzip member without a time, so equal records are equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


SCHEMA = "file string, record_type string, record_id string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary, intact boolean"


class ArchiveReader(DataSourceReader):
    """A partition for each file of the manifest, read as a stream."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ArchiveFile]:
        return [ArchiveFile(f["name"]) for f in json.loads(_get(self.path, MANIFEST))["files"]] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        if not partition.name:
            return
        number = lambda text: int(text) if text else None
        system, folder = file_system(self.path)
        with system.open_input_stream(f"{folder}/{partition.name}", compression=None) as source:
            for h, block in parse_records(unzipped(source)):
                if h["WARC-Type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                n = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"] == "revisit"
                intact = h["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}" and (revisit or (len(payload) == n and hashlib.sha256(payload).hexdigest() == digest))
                refers = number(h["WARC-Refers-To"].strip("<>").split(":")[2]) if revisit else None
                page = number(h["WARC-Record-ID"].strip("<>").split(":")[2])
                yield partition.name, h["WARC-Type"], h["WARC-Record-ID"].strip("<>"), page, h.get("WARC-Target-URI"), digest, n, refers, None if revisit else payload, intact


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); df.write.format("warc").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)), self.options.get("date", DATE))


# --- jobs --------------------------------------------------------------------------------------


def sort_key(page_id: Column, digest: Column) -> Column:
    """Text that sorts as (page_id with null first, digest)."""
    number = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), number), F.lit("0" * 17)), F.substring(digest, 1, 16))


def shard_bounds(sizes: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[str]:
    """The least key of each shard but the first, from (key, bytes).

    Keys that a hash picks stand for the rest, so bounds depend on the rows alone and not on
    how they are partitioned.
    """
    n, total = sizes.agg(F.count("*"), F.sum("bytes")).first()
    shards = min(MOST_SHARDS, -(-(total or 0) // shard_bytes))
    if shards < 2:
        return []
    picked = sizes.filter(F.pmod(F.xxhash64("key"), F.lit(-(-n // BOUND_ROWS))) == 0)
    rows = picked.groupBy("key").agg(F.sum("bytes").alias("bytes")).toPandas().sort_values("key")
    ends = rows["bytes"].cumsum().to_numpy()
    cuts = np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards) if len(ends) else []
    return sorted({rows["key"].iloc[i] for i in cuts})


def plan_records(pages: DataFrame, shard_bytes: int = SHARD_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(shard, page_id, url, html as bytes, digest, first_id, revisits) of every row of ``pages``, each shard in one task and in order.

    first_id is the least page_id of the rows with the same payload, for payloads of at least
    revisit_bytes that occur more than once. Which payloads these are is found on ids and
    digests alone; what was found is sorted in among the pages themselves, right before the
    rows it concerns, so html is shuffled once and by range only. Rows are ordered by page_id
    (null first), digest, url. Payloads that very many rows share meet their first_id over SALTS ways.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    rows = rows.withColumn("key", sort_key(F.col("page_id"), F.col("digest")))
    ids = rows.select("page_id", "digest", "key", F.octet_length("html").alias("bytes"))
    bounds = np.array(shard_bounds(ids.select("key", "bytes"), shard_bytes), "U33")

    @F.pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy("U33"), side="right"))

    # the least id with null before all, as a pair; equal payloads are counted before they are shuffled
    ids = ids.filter(F.col("bytes") >= revisit_bytes)
    least = F.min(F.struct(F.col("page_id").isNotNull(), "page_id")).alias("least")
    shared = ids.groupBy("digest").agg(least, F.count("*").alias("n")).filter("n > 1")
    shared = shared.select(F.col("digest").alias("d"), F.col("least.page_id").alias("first_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marks = ids.join(shared, (F.col("digest") == F.col("d")) & (F.pmod(F.xxhash64("key"), F.lit(SALTS)) == F.col("salt")))
    marks = marks.select("page_id", "digest", "key", "first_id").distinct()
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = rows.select("page_id", "digest", "key", F.lit(1).alias("kind"), "url", "html", none("long", "first_id"), F.lit(False).alias("mark"))
    marks = marks.select("page_id", "digest", "key", F.lit(0).alias("kind"), none("string", "url"), none("binary", "html"), "first_id", F.lit(True).alias("mark"))
    both = rows.unionByName(marks).withColumn("shard", shard("key")).repartition("shard")
    before = Window.partitionBy("shard", "key", "digest").orderBy("kind", "url").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("marked", F.max("mark").over(before)).withColumn("least_id", F.first("first_id").over(before)).withColumn("place", F.count("*").over(before))
    # a marked row revisits unless it is the first row of the least id; place counts the mark itself
    revisits = F.col("marked") & ~(F.col("page_id").eqNullSafe(F.col("least_id")) & (F.col("place") == 2))
    both = both.filter("kind = 1").sortWithinPartitions("shard", "key", "digest", "url")
    return both.select("shard", "page_id", "url", "html", "digest", F.col("least_id").alias("first_id"), revisits.alias("revisits"))


def write_archives(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> None:
    """Write every row of ``pages`` (page_id, url, html) as a record of the archives in the folder ``path``.

    The payload is the html in UTF-8, empty if null; rows with equal payloads revisit the
    first of them (plan_records). Equal rows have records of their own, a null page_id is
    written as an empty one, white space and controls of urls are percent-encoded, a null
    url is left out, other columns aren't looked at. The same rows give the same files, byte for byte. The folder needs
    to be shared; a folder that has archives is an error, and without rows there is a manifest of no files.
    """
    spark = pages.sparkSession
    small_batches(spark)
    spark.dataSource.register(WarcSource)
    rows = plan_records(pages, shard_bytes)
    rows.write.format("warc").option("file_bytes", str(file_bytes)).option("date", date).mode("append").save(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every response and revisit of the archives in ``path``; intact says that lengths and digests hold."""
    small_batches(spark)
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def warc_report(pages: DataFrame, **how) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row of ``pages``, read back from archives written to shared storage."""
    path = f"{checkpoint_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **how)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")

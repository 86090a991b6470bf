"""WARC archives as a Python data source, written and read by Spark tasks.

``df.write.format("warc")`` writes one file (or several, at ``maxBytes``) per task: to a
staging folder first, moved into place when the job commits, so that a repeated or lost
task leaves nothing behind. ``spark.read.format("warc")`` plans one partition for each
file, parses the headers of a record first and seeks past the payload if the pushed-down
predicates on record type and headers reject it, or if option ``payload`` is false.

Written columns: page, uri, digest, refers_to (strings), payload_bytes (long), payload
(binary; null: a revisit record). Read columns: SCHEMA. A header whose value is null isn't
written; control characters and outer spaces in a value are percent-encoded.

Archives of other writers are read too, gzip members included: header names in any case,
records without some headers (null columns), payloads without an HTTP head (the whole
block), any record type; their values are taken as they stand.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StringType

from .shared import bounded, scratch, table, written

SCHEMA = "file string, place bigint, record_type string, page string, uri string, digest string, refers_to string, payload_bytes bigint, payload binary"
MAX_BYTES = 1 << 28
#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
READ = 1 << 20

# Fixed names of the format, and of this library's own fields.
TYPE, URI, DIGEST, PAGE, REFERS, SIZE = "WARC-Type", "WARC-Target-URI", "WARC-Payload-Digest", "X-Page-Id", "X-Refers-To-Page", "X-Payload-Length"
HEADERS = {"record_type": TYPE, "uri": URI, "digest": DIGEST, "page": PAGE, "refers_to": REFERS}
#: Names as they are written; they are read in any case.
NAMES = {x.lower(): x for x in (*HEADERS.values(), SIZE, "Content-Length")}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def record_id(page: str | None, digest: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def encode_record(page: str | None, uri: str | None, digest: str, refers_to: str | None, size: int, payload: bytes | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    fields = [
        (TYPE, "revisit" if payload is None else "response"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", DATE),
        (URI, uri),
        (DIGEST, f"sha1:{digest}"),
        (PAGE, page),
        (SIZE, str(size)),
        *([(REFERS, refers_to), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", PROFILE)] if payload is None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    safe = lambda v: re.sub(r"[\x00-\x1f\x7f%]|^ +| +$", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), v)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {safe(v)}\r\n" for k, v in fields if v is not None)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_records(stream, want, payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(place, headers, payload) of the records that ``want`` takes, by their headers."""
    f = io.BufferedReader(stream, READ)
    while True:
        place = f.tell()
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        head: dict[str, str] = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode(errors="replace").partition(":")
            head[NAMES.get(name.strip().lower(), name)] = value.strip(" \t\r\n")
        if SIZE in head:  # a record of this writer, which escapes its values
            head = {k: re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), v) for k, v in head.items()}
        size = int(head.get("Content-Length", 0))
        if not want(head):
            f.seek(size, 1)
            continue
        body = None
        if payload and head.get(TYPE) == "response":
            block = f.read(size)
            cut = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -4
            body = block[cut + 4 :] if cut != -1 else b""
        else:
            f.seek(size, 1)
        yield place, head, body


class _Raw(io.RawIOBase):
    """A pyarrow file as a raw stream."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def readinto(self, b):
        data = self.file.read(len(b))
        b[: len(data)] = data
        return len(data)

    def seek(self, offset, whence=0):
        return self.file.seek(offset, whence)

    def tell(self):
        return self.file.tell()


@dataclass
class ArchiveFile(InputPartition):
    path: str


@dataclass
class Staged(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.equal: list[tuple[str, set | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in HEADERS and isinstance(f, EqualTo):
                self.equal.append((name, {f.value}))
            elif name in HEADERS and isinstance(f, In):
                self.equal.append((name, set(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.equal.append((name, None))
            else:
                yield f

    def partitions(self):
        fs, path = _store(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        return [ArchiveFile(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith((".warc", ".warc.gz"))] or [ArchiveFile("")]

    def read(self, partition):
        if not partition.path:
            return
        tests = [(HEADERS[name], {f"sha1:{v}" for v in values} if name == "digest" and values is not None else values) for name, values in self.equal]
        want = lambda head: all(name in head and (values is None or head[name] in values) for name, values in tests)
        fs, _ = _store(self.path)
        names = ["file", "place", "record_type", "page", "uri", "digest", "refers_to", "payload_bytes", "payload"]
        types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        with fs.open_input_file(partition.path) as f:
            raw = gzip.GzipFile(fileobj=_Raw(f)) if partition.path.endswith(".gz") else _Raw(f)
            for place, h, body in read_records(raw, want, self.payload):
                rows.append((partition.path, place, h.get(TYPE), h.get(PAGE), h.get(URI), h[DIGEST].removeprefix("sha1:") if DIGEST in h else None, h.get(REFERS), int(h[SIZE]) if SIZE in h else None, body))
                held += len(body or b"") + 256
                if held > READ * 4:
                    yield batch()
                    rows, held = [], 0
            if rows:
                yield batch()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes, self.staging = path.rstrip("/"), max_bytes, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, base = _store(self.path)
        fs.create_dir(f"{base}/{self.staging}", recursive=True)
        names, out = [], None
        for batch in iterator:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page", "uri", "digest", "refers_to", "payload_bytes", "payload")]
            for row in zip(*cols, strict=True):
                if out is None or out.tell() > self.max_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc")
                    out = fs.open_output_stream(f"{base}/{self.staging}/{names[-1]}")
                out.write(encode_record(*row))
        if out is not None:
            out.close()
        return Staged(names)

    def commit(self, messages):
        fs, base = _store(self.path)
        for m in messages:
            for name in m.paths if m else ():
                fs.move(f"{base}/{self.staging}/{name}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, base = _store(self.path)
        if fs.get_file_info(f"{base}/{self.staging}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.staging}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("maxBytes", MAX_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


@F.arrow_udf(StringType())
def base32(hexes: pa.Array) -> pa.Array:
    return pa.array([None if h is None else base64.b32encode(bytes.fromhex(h)).decode() for h in hexes.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def payload_digest(payloads: pa.Array) -> pa.Array:
    return pa.array([None if p is None else base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads.to_pylist()], pa.string())


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Archive records of pages; of equal payloads the one of the largest id is the response.

    A page with a null id revisits if its payload has a response; rows that share the
    largest id are all responses.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("uri"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumn("size", F.octet_length("body").cast("long")).withColumn("sha", F.sha1("body"))
    heads = rows.filter(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("id").alias("head"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha").alias("_sha"), "head")
    heads = written(heads, "heads")
    rows = rows.join(bounded(heads), F.col("sha") == F.col("_sha"), "left")
    again = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    return rows.select(
        F.col("id").cast("string").alias("page"),
        "uri",
        base32("sha").alias("digest"),
        F.when(again, F.col("head").cast("string")).alias("refers_to"),
        F.col("size").alias("payload_bytes"),
        F.when(~again, F.col("body")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str, **kw) -> None:
    register(pages.sparkSession)
    records(pages, **kw).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    path = scratch(spark, "warc")
    write_archives(pages, path)
    # One read for each type: the predicate on the type is pushed down, and no payload is read for revisits. Of responses,
    # length and digest are taken from the payload that was read back.
    rows = read_archives(spark, path).where("record_type = 'response'").unionByName(read_archives(spark, path, payload=False).where("record_type = 'revisit'"))
    return rows.select(
        F.col("page").cast(kind).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(payload_digest("payload"), "digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM m
"""

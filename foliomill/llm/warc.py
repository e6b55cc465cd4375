"""WARC 1.1 archives: a writer of response and revisit records and a sequential reader.

Each record is its own gzip member. The reader decompresses incrementally, frames records by their
Content-Length and checks the payload digest of every response; a block that doesn't match raises.
Every record has an id of its own; that of a response which others revisit is made from its page_id and digest, so that
they can refer to it. page_ids are in fields of their own. ``unresolved`` finds revisits without their response.
Tasks write files of about ``ROLL_BYTES`` under unique names into the shared folder and report them;
the manifest of reported files is itself a written table, so that a retried task's leftovers aren't read.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, that with the smallest page_id is a
response and the others revisit it. The first page of each payload is pre-aggregated and written before
it is joined, so that AQE can split a payload that many pages share.

Defined cases: null html is an empty payload; a null url becomes ``urn:page``; rows with a null page_id
are responses; rows with equal page_id and payload: one is the response, the others revisit it; an empty
table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

MIN_REVISIT = 100
ROLL_BYTES = 32 << 20
LEVEL = 6
READ_BYTES = 1 << 20
MOST_TASKS = 100_000
DATE = "2020-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive that isn't framed as announced or whose payload doesn't have its digest."""


def record_id(page_id: int, digest: str) -> str:
    """The id of the one response of that page and payload that others revisit."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, shared: bool = False) -> bytes:
    """One gzip member. A revisit has the HTTP head of its payload but no body; shared: other records refer to this one."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest) if shared else f'<{uuid.uuid4().urn}>'}",
        f"Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:page"),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(read) -> Iterator[bytes]:
    """The decompressed members of a stream, one at a time; read(n) returns at most n bytes."""
    data = b""
    while data or (data := read(READ_BYTES)):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := read(READ_BYTES)):
                raise WarcError("the last member is cut short")
            out.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(out)


def _head(block: bytes) -> tuple[str, dict[str, str], bytes]:
    head, gap, rest = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("a head has no end")
    first, *lines = head.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def read_records(read) -> Iterator[dict]:
    """Records of an archive in order."""
    for member in members(read):
        version, fields, rest = _head(member)
        length = int(fields["content-length"])
        if not version.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
            raise WarcError("a record isn't framed by its Content-Length")
        _, http, payload = _head(rest[:length])
        digest, page = fields["warc-payload-digest"].removeprefix("sha256:"), fields["page-id"]
        revisit = fields["warc-type"] == "revisit"
        if not revisit and (len(payload) != int(http["content-length"]) or hashlib.sha256(payload).hexdigest() != digest):
            raise WarcError(f"the payload of page {page} doesn't have its digest")
        if revisit and fields["warc-refers-to"] != record_id(int(fields["refers-to-page-id"]), digest):
            raise WarcError(f"page {page} refers to another payload than its own")
        yield {
            "record_id": fields["warc-record-id"],
            "page_id": int(page) if page else None,
            "payload_bytes": int(http["content-length"]),
            "payload_digest": digest,
            "record_type": fields["warc-type"],
            "refers_to": int(fields["refers-to-page-id"]) if revisit else None,
            "url": fields["warc-target-uri"],
            "payload": None if revisit else payload,
        }


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write(folder: str):
    def run(batches):
        made, out, size, name = [], None, 0, ""
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, path = _store(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path)
                data = encode_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], row["revisit"], row["shared"])
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
                    made.append((name, n, size))
        if out is not None:
            out.close()
            made.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["path", "records", "bytes"])

    return run


def _read(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        for uri in b.column(0).to_pylist():
            store, path = _store(uri)
            with store.open_input_stream(path) as f:
                rows: list[tuple] = []
                for r in read_records(f.read):
                    rows.append(tuple(r[k] for k in names))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_archives(spark: SparkSession, pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write every page as a record; return the manifest (path, records, bytes)."""
    ws = Workspace(spark, "warc")
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    keys = rows.filter(f"size >= {min_revisit} and page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    shared = ws.write(keys, "shared")
    # A repeated row of the first page revisits it too, so one row of each first page must be singled out.
    repeated = ws.write(rows.filter("page_id is not null").groupBy("page_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").join(shared.select("digest", F.col("first").alias("page_id")), ["digest", "page_id"], "left_semi").select("digest", "page_id"), "repeated")
    joined = rows.join(shared.drop("n"), "digest", "left")
    if repeated.isEmpty():
        revisit = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))
        records = joined.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    else:
        twice = joined.join(repeated.withColumn("twice", F.lit(True)), ["digest", "page_id"], "left")
        number = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        plain = twice.filter("twice is null").withColumn("number", F.lit(1))
        records = plain.unionByName(twice.filter("twice").withColumn("number", number))
        revisit = F.col("page_id").isNotNull() & ((F.col("page_id") != F.col("first")) | (F.col("number") > 1))
        records = records.withColumn("revisit", F.coalesce(F.col("first").isNotNull() & revisit, F.lit(False)))
    shown = F.col("first").isNotNull() & ~F.col("revisit") & F.col("page_id").isNotNull()
    records = records.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit", shown.alias("shared"))
    return ws.write(records.mapInArrow(_write(f"{ws.path}/archives"), "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives of a manifest, without their payloads: a task for each file, ``MOST_TASKS`` at most."""
    files = manifest.count()
    return manifest.select("path").repartition(max(1, min(files, MOST_TASKS)), "path").mapInArrow(_read, RECORD)


def unresolved(records: DataFrame) -> DataFrame:
    """Revisits whose response isn't among the records, or has another payload."""
    there = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return records.filter("record_type = 'revisit'").join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")))

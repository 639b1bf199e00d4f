"""WARC archives and their chunked record table.

Writing: a task streams its records into one archive under the shared folder, in pieces of CHUNK bytes, and returns
what it wrote; a file counts only if the returned rows name it, so files of failed or repeated attempts are never read.
Reading: archives are streamed piece by piece into rows (record_id, chunk_no, chunk, size so far, digest so far, last),
so neither side allocates a whole record; a record's last chunk carries its full size and SHA-1.

Archives are WARC/1.1, each record a gzip member of its own.  A response holds an HTTP header and the payload, a revisit the HTTP header alone; both
name the payload's SHA-1 (hex).  Files are reached through pyarrow.fs, local, HDFS, S3 or GCS alike.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.common import new_path, stage, table

CHUNK = 1 << 16
LEAST = 1000
#: Of compression.
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Types of decided records.
RECORD = "record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"
WRITTEN = "path string, record_type string, records long, bytes long"
CHUNKS = "path string, record_id long, record_type string, refers_to long, chunk_no int, chunk binary, bytes_so_far long, digest_so_far string, last boolean, declared_bytes long, declared_digest string"


def decide(pages: DataFrame, record_id: str, payload: str, url: str, least: int = LEAST) -> DataFrame:
    """Rows of RECORD: among equal payloads of at least `least` bytes the one with the greatest id is the response and
    the others revisit it.  Rows that repeat an id and a payload are each a record, all of one type.

    Only ids and digests are dealt by digest; payloads move once, by id.  A digest that a third of all rows share is
    pre-aggregated and its join is split by Spark, as both its sides are plain shuffles."""
    rows = pages.select(F.col(record_id).cast("long").alias("record_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    keys = stage(rows.select("record_id", "payload_bytes", "payload_digest"), "digests")
    shared = keys.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("record_id").alias("target"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = keys.filter(F.col("payload_bytes") >= least).join(shared, "payload_digest").filter(~F.col("record_id").eqNullSafe(F.col("target"))).groupBy("record_id", "payload_digest").agg(F.max("target").alias("refers_to"))
    on = rows["record_id"].eqNullSafe(revisits["record_id"]) & (rows["payload_digest"] == revisits["payload_digest"])
    return rows.join(revisits, on, "left").select(rows["record_id"], "url", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to", "payload_bytes", rows["payload_digest"], "payload")


def _urn(record_id: int | None) -> str:
    return "<urn:ctxloom:none>" if record_id is None else f"<urn:ctxloom:{record_id}>"


def _ident(urn: str) -> int | None:
    found = urn[len("<urn:ctxloom:") : -1]
    return None if found == "none" else int(found)


def head(record_id, url, record_type, refers_to, size, digest) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in (url or "about:blank"))
    fields = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if record_type == "revisit":
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    length = len(http) + (size if record_type == "response" else 0)
    return "\r\n".join([*fields, f"Content-Length: {length}", "", ""]).encode() + http


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes RECORD rows below folder, an archive per task; (path, record_type, records, bytes) per archive and type."""

    def run(batches):
        disk, root = fs.FileSystem.from_uri(folder)
        disk.create_dir(root, recursive=True)
        context = TaskContext.get()
        path = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        counts: dict[str, list[int]] = {}
        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                *fields, payload = (c[i] for c in batch.columns)
                ident, url, kind, refers, size, digest = (f.as_py() for f in fields)
                out = out or disk.open_output_stream(path, buffer_size=1 << 20)
                member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(member.compress(head(ident, url, kind, refers, size, digest)))
                if kind == "response":
                    body = memoryview(payload.as_buffer()) if size else b""
                    for at in range(0, size, CHUNK):
                        out.write(member.compress(body[at : at + CHUNK]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                counted = counts.setdefault(kind, [0, 0])
                counted[0] += 1
                counted[1] += size
        if out is not None:
            out.close()
        if counts:
            yield pa.RecordBatch.from_pydict({"path": [path] * len(counts), "record_type": list(counts), "records": pa.array([n for n, _ in counts.values()], pa.int64()), "bytes": pa.array([b for _, b in counts.values()], pa.int64())})

    return stage(records.mapInArrow(run, WRITTEN), "manifest")


class _Stream:
    """Lines and pieces of a stream, in CHUNK bytes of memory."""

    def __init__(self, source):
        self.source, self.held = source, b""

    def line(self) -> bytes:
        while (at := self.held.find(b"\r\n")) < 0:
            more = self.source.read(CHUNK)
            if not more:
                found, self.held = self.held, b""
                return found
            self.held += more
        found, self.held = self.held[:at], self.held[at + 2 :]
        return found

    def header(self) -> dict[str, str]:
        out = {}
        while line := self.line():
            name, _, value = line.decode("utf-8").partition(": ")
            out[name.lower()] = value
        return out

    def pieces(self, size: int):
        while size:
            if not self.held:
                self.held = self.source.read(min(CHUNK, max(size, 4)))
                if not self.held:
                    raise EOFError("an archive ends within a record")
            part, self.held = self.held[: min(size, CHUNK)], self.held[min(size, CHUNK) :]
            size -= len(part)
            yield part


def _whole_chunks(pieces):
    held = b""
    for part in pieces:
        held += part
        while len(held) > CHUNK:
            yield held[:CHUNK], False
            held = held[CHUNK:]
    yield held, True


def chunks_of(source):
    """(record_id, type, refers_to, chunk_no, chunk, bytes so far, digest so far, last, declared size and digest)."""
    stream = _Stream(source)
    while True:
        line = stream.line()
        if not line:
            if not stream.held and not (more := source.read(1)):
                return
            elif not stream.held:
                stream.held = more
            continue
        fields = stream.header()
        kind, ident = fields["warc-type"], _ident(fields["warc-record-id"])
        refers = _ident(fields["warc-refers-to"]) if kind == "revisit" else None
        declared = fields["warc-payload-digest"].removeprefix("sha1:")
        stream.line()
        http = stream.header()
        size = int(http["content-length"])
        digest, total = hashlib.sha1(), 0
        body = stream.pieces(size) if kind == "response" else iter(())
        for number, (chunk, last) in enumerate(_whole_chunks(body)):
            digest.update(chunk)
            total += len(chunk)
            if last and kind == "response" and (total != size or digest.hexdigest() != declared):
                raise ValueError(f"record {ident}: {total} bytes of SHA-1 {digest.hexdigest()}, where its header has {size} of {declared}")
            yield ident, kind, refers, number, chunk, total, digest.hexdigest(), last, size, declared


def read(spark: SparkSession, manifest: DataFrame, folder: str, batch: int = 64, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives that manifest names.  Without payloads chunk is null, and the digests and
    sizes stay.  A payload of another size or digest than its header names is an error.  Archives are dealt by ranges of
    their paths, which adaptive execution doesn't join: about one a task while there are as many tasks."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = manifest.select("path").distinct().repartitionByRange(n, "path")

    def run(batches):
        disk, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]

        def rows(held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

        for given in batches:
            for path in given.column(0).to_pylist():
                held = []
                with disk.open_input_stream(path, buffer_size=CHUNK) as source:
                    for row in chunks_of(gzip.GzipFile(fileobj=source)):
                        held.append((path, *row) if payloads else (path, *row[:4], None, *row[5:]))
                        if len(held) >= batch:
                            yield rows(held)
                            held = []
                if held:
                    yield rows(held)

    return paths.mapInArrow(run, CHUNKS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, written and read back.  A response's size and digest are those of the bytes read; a
    revisit's those of its header, which name the response's payload.  A null page_id is kept; a null payload is empty;
    rows that repeat a page_id are a record each; a long payload is streamed.  No pages: no rows."""
    pages = table(spark, sf_dir, "pages")
    folder = new_path(spark, "warc")
    manifest = write(decide(pages, "page_id", "html", "url"), folder)
    found = read(spark, manifest, folder, batch=512, payloads=False).filter("last")
    size = F.when(F.col("record_type") == "response", F.col("bytes_so_far")).otherwise(F.col("declared_bytes"))
    digest = F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("declared_digest"))
    return found.select(F.col("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")

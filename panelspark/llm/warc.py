"""WARC archives of page payloads, and their chunked record table.

Writer: every task streams its rows into `.warc.gz` files on shared storage, each record a gzip member of its own.
A payload longer than a segment becomes a first record and `continuation` records.  Equal payloads are stored once: the
row with the smallest id is the response, the others are revisit records that refer to it.

Reader: a file is decompressed as a stream and comes out as rows (record, chunk number, data) with the bytes and the
SHA-256 so far, so a record is never whole in memory and its digest needs no second pass and no shuffle.
"""
from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm.common import Scratch, Store, chunks

SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 64 << 10
FILE_BYTES = 64 << 20
LEAST_SHARED_BYTES = 100
CHUNKS = "page_id long, record_type string, refers_to long, chunk_no long, data binary, bytes_so_far long, sha256_so_far string, is_last boolean"
#: Fixed value of the standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, least_bytes: int = LEAST_SHARED_BYTES) -> DataFrame:
    """page_id, url, html with payload_bytes, payload_digest and refers_to (null: the payload is stored)."""
    payload = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", "html").withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", F.sha2(payload.cast("binary"), 256))
    slim = known.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest")
    shared = slim.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = slim.join(shared, "payload_digest").where(F.col("page_id") != F.col("refers_to")).select("page_id", "payload_digest", "refers_to").distinct()
    return known.join(revisits, ["page_id", "payload_digest"], "left")


def _uri(page_id: int | None, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{segment}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def records_of(row: dict, segment_bytes: int):
    """Gzip members of one page."""
    page, url = row["page_id"], (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Target-URI", url), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Page-Id", "" if page is None else page), ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}")]
    if row["refers_to"] is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _uri(page)), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _uri(row["refers_to"])),
                       ("WARC-Refers-To-Page-Id", row["refers_to"]), ("WARC-Payload-Length", row["payload_bytes"])], b"")
        return
    payload = memoryview((row["html"] or "").encode("utf-8", "surrogatepass"))
    n = max(1, -(-len(payload) // segment_bytes))
    for k in range(n):
        block = payload[k * segment_bytes:(k + 1) * segment_bytes]
        fields = [("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", _uri(page, k + 1)), *common, ("Content-Type", "text/html; charset=utf-8")]
        if n > 1:
            fields += [("WARC-Segment-Number", k + 1)]
            fields += [("WARC-Segment-Origin-ID", _uri(page))] if k else []
            fields += [("WARC-Segment-Total-Length", len(payload))] if k == n - 1 else []
        yield _record(fields, bytes(block))


def write_archives(records: DataFrame, root: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives below `root`; the returned plan lists the files and writes when it runs, so stage it."""
    def run(batches):
        store, out, name, size, n = Store(root), None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_pylist([{"name": name, "n_records": n, "n_bytes": size}])

        for b in chunks(batches, "html"):
            for row in b.to_pylist():
                if out is None:
                    name, size, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.create(name)
                    size += out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")],
                                              b"format: WARC File Format 1.1\r\n")) or 0
                for member in records_of(row, segment_bytes):
                    out.write(member)
                    size += len(member)
                n += 1
                if size >= file_bytes:  # between pages, so the segments of a page share a file
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return records.select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "name string, n_records long, n_bytes long")


def _head(f) -> dict[str, str] | None:
    line = f.readline()
    while line == b"\r\n":
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record where one should begin: {line[:40]!r}")
    fields = {}
    while (line := f.readline()) not in (b"\r\n", b""):
        k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
        fields[k] = v
    return fields


def chunk_rows(stream, chunk_bytes: int, with_data: bool):
    """Rows of CHUNKS from a decompressed archive, in file order."""
    number = lambda h, k: int(h[k]) if h.get(k) else None
    head, f = None, io.BufferedReader(stream, 1 << 18)
    head = _head(f)
    while head is not None:
        kind, left = head["WARC-Type"], int(head["Content-Length"])
        page, refers = number(head, "WARC-Page-Id"), number(head, "WARC-Refers-To-Page-Id")
        if kind == "revisit":
            f.read(left)
            yield page, kind, refers, 0, None, int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), True
            head = _head(f)
        elif kind != "response":
            while left:
                left -= len(f.read(min(left, chunk_bytes)))
            head = _head(f)
        else:
            digest, size, no = hashlib.sha256(), 0, 0
            whole = head.get("WARC-Segment-Number") is None
            while True:
                data = f.read(min(left, chunk_bytes))
                if left and not data:
                    raise ValueError(f"page {page}: archive ends inside a record")
                left -= len(data)
                size += len(data)
                digest.update(data)
                ended = not left
                if ended:
                    nxt = _head(f)
                    if not whole and nxt is not None and nxt["WARC-Type"] == "continuation":
                        head, left, ended = nxt, int(nxt["Content-Length"]), False
                yield page, "response", None, no, data if with_data else None, size, digest.hexdigest(), ended
                no += 1
                if ended:
                    if (want := head.get("WARC-Payload-Digest")) != f"sha256:{digest.hexdigest()}":
                        raise ValueError(f"page {page}: payload digest differs from {want}")
                    head = nxt
                    break


def read_chunks(spark: SparkSession, files: DataFrame, root: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of all files; without data only its sizes and digests."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()),
                        ("sha256_so_far", pa.string()), ("is_last", pa.bool_())])

    def run(batches):
        store = Store(root)
        for b in batches:
            for name in b.column("name").to_pylist():
                rows, held = [], 0
                with store.open(name) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for r in chunk_rows(f, chunk_bytes, with_data):
                        rows.append(r)
                        held += len(r[4] or b"") + 100
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # a number given outright is kept: adaptive execution would join files of names into one task by their few bytes
    return files.select("name").repartition(max(1, files.count())).mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload.  Rows that share both page_id and payload are all responses if that id is the smallest
    with the payload, else all revisits; a null page_id is written and read as null, and never the target of a revisit.
    Null urls become empty.  An empty table writes no file.  Further columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    root = scratch.folder("warc")
    files = scratch.stage(write_archives(plan_records(pages), root, segment_bytes, file_bytes), "files")
    last = read_chunks(spark, files, root, chunk_bytes, with_data=False).where("is_last")
    return last.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha256_so_far").alias("payload_digest"), "record_type", "refers_to")

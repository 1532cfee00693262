"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped by the reader.

Each part has `<part>.ids` (little-endian unsigned integers, 16 bits where the vocabulary allows), `<part>.offsets`
(n+1 local offsets, int64) and `<part>.docs` (document ids, int64; the smallest int64 stands for null).  Parts are
ranges of the document id; the place of a part's first token in the whole corpus is a prefix sum over the parts.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelspark.llm.common import Scratch, Store, chunks
from panelspark.llm.tokens import encoder

NULL_ID = np.iinfo(np.int64).min
PARTS = "part long, name string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int, vocabulary: int, spaced: bool = False) -> DataFrame:
    """Write the files below `root` and return the parts as a plan; the plan must be staged, since it writes when it runs.

    A task writes under a name of its own attempt; only names in the staged parts count.  Null text is empty.  Rows are in
    ascending order of doc_id, null first, ties by text; repeated rows are written each.
    """
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches):
        part, store, enc = TaskContext.get().partitionId(), Store(root), encoder(tokenizer, spaced)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        sizes, ids, any_row = [], [], False
        out = None
        for b in chunks(batches, "text"):
            out = out or store.create(f"{name}.ids")
            flat, ends = enc.encode(b.column("text"))
            n = np.diff(ends) + 1
            block = np.full(len(flat) + len(n), end_id, dtype)
            block[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n - 1)] = flat
            out.write(block.tobytes())
            sizes.append(n)
            ids.append(b.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
            any_row = True
        if any_row:
            out.close()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
            for suffix, data in (("offsets", offsets), ("docs", np.concatenate(ids).astype("<i8"))):
                with store.create(f"{name}.{suffix}") as f:
                    f.write(data.tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": len(offsets) - 1, "n_tokens": int(offsets[-1])}])

    return docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, PARTS)


def read_tokens(spark: SparkSession, parts: DataFrame, root: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches):
        store = Store(root)
        for b in batches:
            for r in b.to_pylist():
                tokens, offsets, docs = store.array(f"{r['name']}.ids", dtype), store.array(f"{r['name']}.offsets", "<i8"), store.array(f"{r['name']}.docs", "<i8")
                for lo in range(0, len(docs), 4096):
                    at = np.asarray(offsets[lo:lo + 4097])
                    crc = [zlib.crc32(np.asarray(tokens[s:e]).astype("<u4").tobytes()) for s, e in zip(at[:-1], at[1:])]
                    d = np.asarray(docs[lo:lo + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(d, mask=d == NULL_ID), pa.array(at[:-1] + r["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])
    # a number given outright is kept: adaptive execution would join the parts into one task by their few bytes
    return (parts.select("name", "part", base.alias("base")).repartition(max(1, parts.count()))
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Write all documents and read them back.  An empty table writes no file and gives no rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    root = scratch.folder("tokens")
    parts = scratch.stage(write_tokens(docs, root, tokenizer, end_id, vocabulary), "parts")
    return read_tokens(spark, parts, root, vocabulary)

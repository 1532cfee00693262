"""Vector best-fit packing of tokenised documents into sequences.

A piece's demand is a vector (tokens, documents, attention cost = tokens squared) that depends on its length alone, so
the corpus is a histogram of at most `capacity` lengths.  The bins are planned on that histogram: lengths in descending
order, each into the class of equal open bins that is left with the smallest weighted residual norm and where every
constraint holds.  Then every piece finds its place from its rank among the pieces of its length; no task sees a group.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm.common import Scratch, chunks
from panelspark.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
SLOTS = np.dtype([("length", "i8"), ("first", "i8"), ("last", "i8"), ("bin", "i8"), ("per_bin", "i8"), ("offset", "i8")])


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence and the weights of their residuals in the norm that chooses a bin.

    Without caps of their own, documents and attention cost are bounded by the token capacity and never bind.
    """
    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def capacity(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens ** 2


def cut(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: only the first may be shorter than `size`."""
    first = n % size or min(n, size)
    yield 0, first
    for s in range(first, n, size):
        yield s, size


def plan_bins(histogram: dict[int, int], limits: Limits) -> tuple[np.ndarray, int]:
    """Slots (length, ranks first..last-1, first bin, pieces per bin, offset in the bin) and the number of bins.

    The state is the classes of open bins with equal residuals, each a list of runs of bin numbers.  A length touches a
    class as a whole but for one bin, so there are a few classes for each length.  A piece that breaks a constraint by
    itself raises ValueError.
    """
    caps = np.array(limits.capacity())
    weight = np.array(limits.weights) / caps ** 2
    classes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    slots, n_bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array((length, 1, length * length))
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds {tuple(caps)}")
        open_keys = np.array(list(classes), dtype=np.int64).reshape(-1, 3)
        fits = (open_keys >= need).all(1)
        residual = open_keys[fits] - need
        order = np.argsort((residual ** 2) @ weight, kind="stable")
        for key in map(tuple, open_keys[fits][order]):
            if not left:
                break
            key = tuple(int(x) for x in key)
            times = int(min(k // d for k, d in zip(key, need) if d))
            runs = classes.pop(key)
            for at, (bin_, count) in enumerate(runs):
                full = min(count, left // times)
                part = left - full * times if full < count else 0
                for n, per, b in ((full, times, bin_), (1, part, bin_ + full)):
                    if n and per:
                        slots.append((length, rank, rank + n * per, b, per, limits.tokens - key[0]))
                        rank, left = rank + n * per, left - n * per
                        classes.setdefault(tuple(int(k - per * d) for k, d in zip(key, need)), []).append((b, n))
                used = full + (part > 0)
                if used < count:
                    classes.setdefault(key, []).append((bin_ + used, count - used))
                if not left:
                    if runs[at + 1:]:
                        classes.setdefault(key, []).extend(runs[at + 1:])
                    break
        if left:
            times = int(min(c // d for c, d in zip(caps, need) if d))
            for n, per in ((left // times, times), (1, left % times)):
                if n and per:
                    slots.append((length, rank, rank + n * per, n_bins, per, 0))
                    classes.setdefault(tuple(int(c - per * d) for c, d in zip(caps, need)), []).append((n_bins, n))
                    rank, n_bins = rank + n * per, n_bins + n
    out = np.array(slots, SLOTS)
    return out[np.lexsort((out["first"], out["length"]))], n_bins


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces with their rank among the pieces of equal length of the same task."""
    def run(batches):
        seen, task, enc = np.zeros(size + 1, np.int64), TaskContext.get().partitionId(), encoder(tokenizer, True)
        end = np.array([end_id], "<u4").tobytes()
        for b in chunks(batches, "text"):
            rows = []
            flat, ends = enc.encode(b.column("text"))
            flat = memoryview(flat.astype("<u4", copy=False)).cast("B")
            for doc, lo, hi in zip(b.column("doc_id").to_pylist(), (4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist()):
                ids = bytes(flat[lo:hi]) + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, size)):
                    rows.append((doc, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]), task, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Null text is empty and still has its end id.  Repeated rows are packed each, also with a null or equal doc_id.
    Ties are broken by the rank in the staged table.  An empty table gives no rows; columns besides doc_id and text are
    ignored.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.stage(tokenised_pieces(docs, tokenizer, end_id, limits.tokens), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan_bins(histogram, limits)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("length", "task", before.alias("before")), ["length", "task"])
    starts = np.searchsorted(slots["length"], np.arange(limits.tokens + 2))

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                here, lo, hi = length == n, starts[n], starts[n + 1]
                at[here] = lo + np.searchsorted(slots["first"][lo:hi], rank[here], "right") - 1
            s = slots[at]
            turn = rank - s["first"]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s["bin"] + turn // s["per_bin"]), pa.array(s["offset"] + turn % s["per_bin"] * length)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return (ranked.withColumn("rank", F.col("before") + F.col("nth")).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
            .mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))

"""Line deduplication by a sharded minimal perfect hash.

Lines are counted as 128-bit hashes of their keys.  The keys found in enough documents get a minimal perfect hash in
shards of bounded size; it indexes arrays of fingerprints, counts and last documents, which documents probe by line.  Shards
are memory maps where the storage is mounted: a probe touches some pages, which the workers of a machine share, and a worker
opens each shard once.  Elsewhere a worker holds whole shards up to CACHE_BYTES.
Rarer keys have no entry: a 64-bit fingerprint tells them from the entry their slot holds.
"""
from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Scratch, Store, chunks, mix

SHARD_KEYS = 200_000
CACHE_BYTES = 64 << 20
OPEN_SHARDS = 1 << 14
_BLANK = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class PerfectHash:
    """Cascade of bit arrays: a level keeps the keys that are alone in their place, the others go on to the next level.

    slot() is the number of set bits before a key's place, so n keys fill 0..n-1.  A foreign key gets any slot or -1.
    """

    def __init__(self, levels: list[np.ndarray], sizes: list[int], before: list[np.ndarray]):
        self.levels, self.sizes, self.before = levels, sizes, before

    @staticmethod
    def build(keys: np.ndarray, load: float = 0.5) -> PerfectHash:
        levels, sizes, before, total, left = [], [], [], 0, np.unique(keys)
        while len(left):
            size = max(64, int(len(left) / load) + 63 & ~63)
            at = mix(left, len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            bits = np.bitwise_count(levels[-1]).astype(np.uint32)
            before.append((np.cumsum(bits) - bits + total).astype("<u4"))
            total += int(alone.sum())
            left = left[~alone[at.astype(np.int64)]]
        return PerfectHash(levels, sizes, before)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (words, size) in enumerate(zip(self.levels, self.sizes)):
            at = mix(keys[todo], k) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[todo[here]] = self.before[k][word[here]] + np.bitwise_count(below)
            todo = todo[~here]
        return out


def _shard_bytes(keys: np.ndarray, marks: np.ndarray, counts: np.ndarray, last: np.ndarray) -> bytes:
    """head (levels, keys), level sizes, level words, marks and last documents in slot order, bits before each word, counts."""
    mph = PerfectHash.build(keys)
    slot = mph.slot(keys)
    arrays = []
    for values, dtype in ((marks, "<u8"), (last, "<i8"), (counts, "<u4")):
        a = np.empty(len(slot), dtype)
        a[slot] = np.minimum(values, 0xFFFFFFFF) if dtype == "<u4" else values
        arrays.append(a)
    return b"".join(x.tobytes() for x in (np.array([len(mph.sizes), len(slot)], "<i8"), np.array(mph.sizes, "<i8"), *mph.levels, *arrays[:2], *mph.before, arrays[2]))


def _read_shard(data: np.ndarray):
    """The arrays of a shard as views of its bytes."""
    at = 0

    def take(n: int, dtype: str) -> np.ndarray:
        nonlocal at
        at += n * np.dtype(dtype).itemsize
        return data[at - n * np.dtype(dtype).itemsize:at].view(dtype)

    n_levels, n = map(int, take(2, "<i8"))
    sizes = take(n_levels, "<i8").tolist()
    levels = [take(s // 64, "<u8") for s in sizes]
    marks, last = take(n, "<u8"), take(n, "<i8")
    before = [take(s // 64, "<u4") for s in sizes]
    return PerfectHash(levels, sizes, before), marks, take(n, "<u4"), last


_opened: OrderedDict[tuple[str, int], tuple[int, tuple | None]] = OrderedDict()


def _shard(root: str, k: int):
    """A shard, None for one without keys; those not used for longest go first."""
    name = root, k
    if name not in _opened:
        try:
            data = Store(root).array(f"shard-{k:06d}", "u1")
            _opened[name] = 0 if isinstance(data, np.memmap) else len(data), _read_shard(data)
        except FileNotFoundError:
            _opened[name] = 0, None
        while len(_opened) > 1 and (len(_opened) > OPEN_SHARDS or sum(held for held, _ in _opened.values()) > CACHE_BYTES):
            _opened.popitem(last=False)
    _opened.move_to_end(name)
    return _opened[name][1]


def line_keys(text: str, least_chars: int) -> list[tuple[int, int, int]]:
    """(line number, hash, fingerprint) of the lines whose key has `least_chars` code points."""
    out = []
    for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if len(line) < least_chars:
            continue
        key = line.strip(_BLANK).translate(_LOWER)
        if len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "surrogatepass")) >= least_chars):
            h = xxhash.xxh3_128_intdigest(key)
            out.append((k, h >> 64, h & 0xFFFFFFFFFFFFFFFF))
    return out


def drop_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """The rows of `docs` with columns text (lines that stay), n_lines and n_dropped set.

    A key in at least `least_docs` rows loses its lines except in the row with the largest doc_id that has it.  Every row
    counts as a document, so repeated rows count each, and rows that share the largest doc_id all keep their lines; a null
    doc_id counts below all others.  Null and empty texts have one empty line; a null text comes back empty.  Other columns
    pass through; own columns named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.drop("n_lines", "n_dropped")

    def count(batches):
        for b in chunks(batches, "text"):
            high, low, doc = [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = {(h, m) for _, h, m in line_keys(t, least_chars)} if t else ()
                high += [h for h, _ in own]
                low += [m for _, m in own]
                doc += [d] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint64).view(np.int64)), pa.array(doc, pa.int64())], names=["key", "mark", "doc_id"])

    frequent = scratch.stage(docs.select("doc_id", "text").mapInArrow(count, "key long, mark long, doc_id long").groupBy("key", "mark")
                             .agg(F.count("*").alias("n"), F.max(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("last")).where(F.col("n") >= least_docs), "lines")
    n_shards = max(1, -(-frequent.count() // SHARD_KEYS))
    root = scratch.folder("shards")

    def build(shard):
        k = shard.column("shard")[0].as_py()
        key, mark, n, last = (shard.column(c).to_numpy() for c in ("key", "mark", "n", "last"))
        Store(root).put(f"shard-{k:06d}", _shard_bytes(key.view(np.uint64), mark.view(np.uint64), n, last))
        return shard.select(["shard"]).slice(0, 1)

    frequent.withColumn("shard", F.pmod("key", F.lit(n_shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int").write.format("noop").mode("overwrite").save()

    def probe(batches):
        for b in chunks(batches, "text"):
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").fill_null(-(1 << 63)).to_pylist()
            keys = [line_keys(t, least_chars) if t else [] for t in texts]
            flat = np.array([(i, k, h, m) for i, own in enumerate(keys) for k, h, m in own], dtype=object).reshape(-1, 4)
            row, key, mark = flat[:, 0].astype(np.int64), flat[:, 2].astype(np.uint64), flat[:, 3].astype(np.uint64)
            gone = np.zeros(len(flat), bool)
            shard = np.mod(key.view(np.int64), n_shards)
            doc = np.array(ids, np.int64)[row]
            for s in np.unique(shard):
                if (table := _shard(root, int(s))) is None:
                    continue
                mph, marks, counts, last = table
                own = np.flatnonzero(shard == s)
                slot = mph.slot(key[own])
                hit = slot >= 0
                hit[hit] = (marks[slot[hit]] == mark[own][hit]) & (counts[slot[hit]] >= least_docs) & (last[slot[hit]] != doc[own][hit])
                gone[own[hit]] = True
            drop: dict[int, set[int]] = {}
            for i, k in flat[gone][:, :2]:
                drop.setdefault(i, set()).add(k)
            kept = []
            for i, t in enumerate(texts):
                kept.append(t or "" if i not in drop else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i]))
            cols = {c: b.column(c) for c in b.schema.names}
            cols["text"] = pa.array(kept, pa.string())
            cols["n_lines"] = pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64())
            cols["n_dropped"] = pa.array([len(drop.get(i, ())) for i in range(len(texts))], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_lines long, n_dropped long"
    return docs.mapInArrow(probe, schema)

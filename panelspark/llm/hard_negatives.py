"""Hard negatives for anchors by exact integer scores from float32 matrix products.

Components become integers floor(scale * x), and a score is the exact inner product of two rows.  Float32 products are exact only below 2**24,
so both matrices are taken modulo small primes: residues lie within +-p/2, products of SLICE components at most stay below
2**24, and every prime gives the score modulo p from one float32 product.  Chinese remaindering (mixed radix) puts the
signed score together again.  The number of primes follows from the largest norm in the data (no score exceeds the product
of two norms), so it is two for unit vectors and at most six; scores of 2**56 and more raise, since 100 x score must fit 64
bits.

Anchors are the query set.  They are written as files of about ANCHORS rows to the shared folder; a task takes its rows
in blocks, streams the anchor files by them and keeps, for every anchor, only the few rows that can be in the result.  So
neither side is broadcast or joined, no pair of rows is emitted but candidates, and a common label or vector is like any
other.  One pass finds the positives, a second one the negatives inside each positive's window.  Both end with a ranking
over (anchor) or (anchor, positive), of a few rows from each block.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part.  A null vec_id is no
anchor and comes last among ties.  Rows that carry the anchor's vec_id are not other rows.  Repeated rows count each, as
anchors too.  Vectors of unequal length score over their common components.  Other columns are ignored.  Without anchors or
rows the result is empty.
"""
from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm.common import Scratch, Store, give_back

ANCHORS, TILE = 512, 2048
NONE = np.iinfo(np.int64).min
#: Components of one row block that a task holds.
BLOCK_COMPONENTS = 2 << 20
SLICE = 64
MOST_BITS = 56


def primes_below(limit: int) -> list[int]:
    return [p for p in range(limit, 2, -1) if all(p % q for q in range(2, int(p ** 0.5) + 1))]


#: Largest first; SLICE * (p / 2) ** 2 stays below 2 ** 24.
PRIMES = primes_below(1023)[:6]


def primes_for(bound: int) -> list[int]:
    """As many primes as tell all scores of at most `bound` in size apart."""
    if bound >= 1 << MOST_BITS:
        raise ValueError(f"scores of 2**{MOST_BITS} or more are not supported; scale the vectors")
    k, product = 0, 1
    while product <= 2 * bound:
        product *= PRIMES[k]
        k += 1
    return PRIMES[:max(k, 1)]


class Residues:
    """A matrix of whole numbers modulo each prime, centred, as float32."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.parts = []
        for p in primes:
            r = np.mod(matrix, p)
            self.parts.append(np.where(r > p // 2, r - p, r).astype(np.float32))

    def rows(self, lo: int, hi: int) -> list[np.ndarray]:
        return [m[lo:hi] for m in self.parts]


def product(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact left x right^T as int64, over the components that both have."""
    d = min(left[0].shape[1], right[0].shape[1])
    digits: list[np.ndarray] = []
    for a, b, p in zip(left, right, primes):
        total = np.zeros((len(a), len(b)), np.int64)
        for lo in range(0, d, SLICE):
            total += (a[:, lo:min(lo + SLICE, d)] @ b[:, lo:min(lo + SLICE, d)].T).astype(np.int64)
        # Mixed radix: what the digits so far stand for, modulo p, leaves the next digit.
        value, weight = np.zeros_like(total), 1
        for digit, q in zip(digits, primes):
            value += digit * weight % p
            weight = weight * q % p
        digits.append((total - value) * pow(weight, -1, p) % p)
    out, weight = np.zeros_like(digits[0]), 1
    for digit, p in zip(digits, primes):
        out += digit * weight
        weight *= p
    return np.where(out > weight // 2, out - weight, out)


def whole(vector: Column) -> Column:
    """Neither the vector nor a component is null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def _matrices(batch: pa.RecordBatch, scale: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(id, id is null, label, matrix of floor(scale * x)) for each length of vector, rows by id, null ids last."""
    v = batch.column("embedding")
    size = np.diff(np.asarray(v.offsets)).astype(np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    ids, gone = batch.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
    label, out = batch.column("label").to_numpy(zero_copy_only=False), []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        at = at[np.lexsort((ids[at], gone[at]))]
        out.append((ids[at], gone[at], label[at], np.floor(flat[start[at][:, None] + np.arange(d)].astype(np.float64) * scale).astype(np.int64)))
    return out


def _blocks(batches):
    """Record batches joined to about BLOCK_COMPONENTS components."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += len(b.column("embedding").flatten()) + b.num_rows
        if n >= BLOCK_COMPONENTS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def write_anchors(anchors: DataFrame, root: str, scale: int) -> DataFrame:
    """One file for each value of `block`, its rows numbered in order of (length, id); (block, n) of each.

    Stage the result: it writes when it runs.  A repeated attempt writes the same file again.
    """
    def run(table: pa.Table) -> pa.Table:
        block, arrays, n = table.column("block")[0].as_py(), {}, 0
        rows = table.drop_columns(["block", "uid"]).take(pc.sort_indices(table, [("uid", "ascending")])).combine_chunks().to_batches()[0]
        for k, (ids, _, label, m) in enumerate(_matrices(rows, scale)):
            arrays |= {f"ids{k}": ids, f"label{k}": label, f"m{k}": m}
            n += len(ids)
        Store(root).put(f"anchors-{block}", _pack(**arrays))
        return pa.table({"block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int64())})
    return anchors.select("block", "uid", "vec_id", "label", "embedding").groupBy("block").applyInArrow(run, "block long, n long")


def write_windows(positives: DataFrame, root: str, keep: int) -> DataFrame:
    """The positives' scores of a block of anchors as one file; stage the result."""
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        anchor, slot, score = (table.column(c).to_numpy() for c in ("anchor", "slot", "score"))
        scores = np.full((int(anchor.max()) + 1, keep), NONE)
        scores[anchor, slot] = score
        Store(root).put(f"windows-{block}", _pack(scores=scores))
        return pa.table({"block": pa.array([block], pa.int64())})
    return positives.select("block", "anchor", "slot", "score").groupBy("block").applyInArrow(run, "block long")


def _best(score: np.ndarray, allowed: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `keep` largest allowed scores of each row, the left-most of equal ones."""
    width = score.shape[1]
    key = np.where(allowed, score * width + np.arange(width - 1, -1, -1), NONE)
    if keep < width:
        at = np.argpartition(key, width - keep, axis=1)[:, width - keep:]
        key = np.take_along_axis(key, at, 1)
    else:
        at = np.broadcast_to(np.arange(width), key.shape)
    row, k = np.nonzero(key != NONE)
    return row, at[row, k]


def _thin(found: list[tuple], keep: int) -> list[np.ndarray]:
    """Columns (anchor, anchor id, slot, id, id is null, score), `keep` best rows of each anchor and slot."""
    cols = [np.concatenate([f[k] for f in found]) for k in range(6)]
    anchor, _, slot, ids, gone, score = cols
    by = np.lexsort((ids, gone, -score, slot, anchor))
    group = np.flatnonzero(np.append(True, (np.diff(anchor[by]) != 0) | (np.diff(slot[by]) != 0))) if len(by) else np.empty(0, np.int64)
    place = np.arange(len(by)) - np.repeat(group, np.diff(np.append(group, len(by))))
    return [c[by[place < keep]] for c in cols]


def _scan(rows: DataFrame, root: str, blocks: int, scale: int, primes: list[int], tile: int, keep: int, windows: tuple[int, int] | None) -> DataFrame:
    """Candidates from every block of rows.

    Without windows: the best `keep` rows of the anchor's label, slot 0.  With them: for every positive (slot) the best
    `keep` rows of other labels whose score is within windows[0] / windows[1] of the positive's and not above it.
    """
    def met(anchor, part, wanted):
        """Candidates of one block of rows for the anchors of one length."""
        first, ids, label, left = anchor
        for vec_id, gone, own, right in part:
            for lo in range(0, len(vec_id), tile):
                v, g, o = vec_id[lo:lo + tile], gone[lo:lo + tile], own[lo:lo + tile]
                score, same = product(left.parts, right.rows(lo, lo + tile), primes), label[:, None] == o[None, :]
                if wanted is None:
                    allowed = [same & ((ids[:, None] != v[None, :]) | g[None, :])]
                else:
                    allowed = [~same & (score <= w[:, None]) & (score * windows[1] >= (np.maximum(w, -(1 << MOST_BITS)) * windows[0])[:, None]) & (w != NONE)[:, None] for w in wanted.T]
                for slot, ok in enumerate(allowed):
                    row, col = _best(score, ok, keep)
                    yield first + row, ids[row], np.full(len(row), slot), v[col], g[col], score[row, col]

    def run(batches):
        store = Store(root)
        for block in _blocks(batches):
            part = [(i, g, l, Residues(m, primes)) for i, g, l, m in _matrices(block, scale)]
            for number in range(blocks):
                data = store.get(f"anchors-{number}")
                limits = store.get(f"windows-{number}") if windows and data else None
                if data is None or (windows and limits is None):
                    continue  # no anchors, or none with a positive
                a, found, first = np.load(io.BytesIO(data)), [], 0
                scores = np.load(io.BytesIO(limits))["scores"] if windows else None
                for k in range(len(a.files) // 3):
                    ids, label = a[f"ids{k}"], a[f"label{k}"]
                    mine = None
                    if windows:
                        mine = np.full((len(ids), keep), NONE)
                        have = scores[first:first + len(ids)]
                        mine[:len(have)] = have
                    found.extend(met((first, ids, label, Residues(a[f"m{k}"], primes)), part, mine))
                    first += len(ids)
                anchor, anchor_id, slot, ids, gone, score = _thin(found, keep)
                if len(anchor):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(anchor), number), pa.int64()), pa.array(anchor, pa.int32()), pa.array(anchor_id, pa.int64()), pa.array(slot, pa.int32()),
                                                      pa.array(ids, pa.int64(), mask=gone), pa.array(score, pa.int64())], names=["block", "anchor", "anchor_id", "slot", "vec_id", "score"])
        give_back()
    return rows.mapInArrow(run, "block long, anchor int, anchor_id long, slot int, vec_id long, score long")


def _ranked(candidates: DataFrame, by: list[str], keep: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def mine(vectors: DataFrame, is_anchor: Column, scale: int = 256, keep: int = 5, window: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, embedding).

    An anchor's positives are its best `keep` other rows of its label; for each, the best `keep` rows of other labels with
    window[0] * positive_score <= window[1] * negative_score <= window[1] * positive_score.  `vectors` is read four times.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.where(F.col("label").isNotNull() & whole(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.pow(F.floor(x.cast("double") * float(scale)).cast("double"), F.lit(2.0)))
    anchors = rows.where(is_anchor & F.col("vec_id").isNotNull())
    size = rows.agg(F.max(square).alias("square"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    bound, blocks = int((size["square"] or 0) * 1.0001) + 1, -(-size["anchors"] // ANCHORS)
    primes, tile = primes_for(bound), max(1, min(TILE, (1 << 62) // (bound + 1)))
    root = scratch.folder("anchors")
    # The number in the staged rows deals them out evenly, repeated rows too.
    held = scratch.stage(anchors.withColumn("uid", F.monotonically_increasing_id()), "anchors")
    scratch.stage(write_anchors(held.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(max(1, blocks)))), root, scale), "blocks")
    near = scratch.stage(_ranked(_scan(rows, root, blocks, scale, primes, tile, keep, None), ["block", "anchor"], keep)
                         .select("block", "anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), "score"), "positives")
    scratch.stage(write_windows(near, root, keep), "windows")
    far = _ranked(_scan(rows, root, blocks, scale, primes, tile, keep, window), ["block", "anchor", "slot"], keep)
    return (far.withColumnRenamed("score", "negative_score").join(near.withColumnRenamed("score", "positive_score"), ["block", "anchor", "slot"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", "negative_score"))

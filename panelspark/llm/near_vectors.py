"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned three times by random signs and a fast Hadamard transform; the axis nearest to the result, with its
sign, is one hash, and some hashes together are a bucket of a table.  A vector stays in its own bucket of each table and
is looked up in the next-nearest ones too (multiprobe).  In a bucket all cosines are computed in double precision, in
cells of bounded size; a pair that meets in several buckets counts in the first one, which both vectors' hashes tell, so
no pair leaves its cell: rows come out as a vector's number of links and its component within the cell.
"""
from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Scratch, in_blocks
from panelspark.llm.components import connected_components

BLOCK = 1024
AXES_TRIED = 3


@dataclass(frozen=True)
class Hashing:
    """Tables, hashes in a bucket and buckets looked up in each table."""
    tables: int = 10
    hashes: int = 2
    probes: int = 4
    seed: int = 11

    @staticmethod
    def for_rows(n: int, dimension: int, in_bucket: int = 32) -> Hashing:
        """Enough hashes for about `in_bucket` unrelated vectors in a bucket; more tables as a bucket asks for more."""
        axes = 2 * (1 << max(0, dimension - 1).bit_length())
        k = max(1, int(np.ceil(np.log(max(2, n / in_bucket)) / np.log(axes))))
        return Hashing(tables={1: 6, 2: 10, 3: 20}.get(k, 40), hashes=k)


def hadamard(x: np.ndarray) -> np.ndarray:
    n, size = x.shape
    h = 1
    while h < size:
        y = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
        h *= 2
    return x / np.sqrt(size)


def buckets(x: np.ndarray, how: Hashing) -> np.ndarray:
    """Bucket codes of unit vectors: [row, table, probe]; probe 0 is the vector's own bucket."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    base = np.zeros((n, size))
    base[:, :d] = x
    rng = np.random.default_rng([how.seed, size])
    tried = min(AXES_TRIED, size)
    combos = np.array(list(product(range(tried), repeat=how.hashes)))
    out = np.empty((n, how.tables, how.probes), np.int64)
    for t in range(how.tables):
        cost, code = np.zeros((n, len(combos))), np.full((n, len(combos)), t, np.int64)
        for k in range(how.hashes):
            y = base
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :tried]
            value = np.take_along_axis(y, near, 1)
            axis = 2 * near + (value < 0)
            loss = np.abs(value[:, :1]) - np.abs(value)
            cost += loss[:, combos[:, k]] ** 2
            code = code * (2 * size) + axis[:, combos[:, k]]
        best = np.argsort(cost, axis=1, kind="stable")[:, :how.probes]
        found = np.take_along_axis(code, best, 1)
        out[:, t] = np.pad(found, ((0, 0), (0, how.probes - found.shape[1])), mode="edge")
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_meeting(codes_x: np.ndarray, codes_y: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """For pairs of rows: is this bucket the first, by table and code, where they meet?  They meet in the own bucket of one
    that the other looks up."""
    ok = np.ones(len(codes_x), bool)
    for t in range(table + 1):
        own = np.flatnonzero(ok)
        if not len(own):
            break
        x, y = codes_x[own, t], codes_y[own, t]
        in_y = (x == y[:, :1]).any(1)  # own bucket of y, looked up by x
        in_x = (y == x[:, :1]).any(1)
        if t < table:
            ok[own] = ~(in_x | in_y)
        else:
            ok[own] = ~((in_y & (y[:, 0] < bucket)) | (in_x & (x[:, 0] < bucket)))
    return ok


def _cell(ids, weight, own, block, x, codes, table, bucket, least, left, right):
    """Links of one cell: weighted number for each row, and the least id that each row reaches."""
    n = np.zeros(len(ids), np.int64)
    link = np.zeros((len(ids), len(ids)), bool)
    sides = [(np.flatnonzero(block == left), np.flatnonzero(block == right))]
    if left != right:
        sides.append((sides[0][1], sides[0][0]))
    for a, b in sides:
        a = a[own[a]]
        if not len(a) or not len(b):
            continue
        near = x[a] @ x[b].T >= least
        i, j = np.nonzero(near)
        link[a[i], b[j]] = True
    np.fill_diagonal(link, False)
    link |= link.T
    i, j = np.nonzero(np.triu(link))
    for lo in range(0, len(i), 1 << 19):
        p, q = i[lo:lo + (1 << 19)], j[lo:lo + (1 << 19)]
        first = _first_meeting(codes[p], codes[q], table, bucket)
        np.add.at(n, p[first], weight[q[first]])
        np.add.at(n, q[first], weight[p[first]])
    reach = ids.copy()
    todo = link.any(1)
    for s in np.argsort(ids):
        if todo[s]:
            front, todo[s] = np.array([s]), False
            while len(front):
                nxt = link[front].any(0) & todo
                todo &= ~nxt
                front = np.flatnonzero(nxt)
                reach[front] = ids[s]
    return n, reach


def link_vectors(vectors: DataFrame, least: float = 0.9, how: Hashing | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: 0 links, their own
    component.  Vectors of different lengths never link.  Equal vectors are hashed once and count as links of each other,
    also rows with the same id; a row with a null id links with nothing.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = rows.where(fine)
    groups = scratch.stage(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.size("embedding")), "groups")
    top = groups.agg(F.count("*"), F.max("dim")).first()
    how = how or Hashing.for_rows(top[0], top[1] or 1)

    def place(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                code = buckets(_vectors(own.column("embedding")), how)
                n, t, p = code.shape
                row = np.repeat(np.arange(n), t * p)
                flat, probe, table = code.reshape(-1), np.tile(np.arange(p), n * t), np.tile(np.repeat(np.arange(t), p), n)
                again = np.zeros(len(flat), bool)
                again[1:] = (probe[1:] > 0) & (flat[1:] == flat[:-1])
                row, flat, probe, table = row[~again], flat[~again], probe[~again], table[~again]
                for lo in range(0, len(row), 8192):
                    s = slice(lo, lo + 8192)
                    yield pa.RecordBatch.from_arrays([own.column("rep").take(pa.array(row[s])), own.column("weight").take(pa.array(row[s])), pa.array(np.full(len(row[s]), d, np.int64)), pa.array(table[s]), pa.array(flat[s]),
                                                      pa.array(probe[s] == 0), own.column("embedding").take(pa.array(row[s]))], names=["rep", "weight", "dim", "hash_table", "bucket", "own", "embedding"])

    placed = groups.select("rep", "weight", F.col("dim").cast("long").alias("dim"), "embedding").mapInArrow(place, "rep long, weight long, dim long, hash_table long, bucket long, own boolean, embedding array<double>")
    placed = placed.withColumn("embedding", F.col("embedding").cast("array<float>")) if dict(vectors.dtypes)["embedding"] == "array<float>" else placed
    cells = in_blocks(scratch.stage(placed, "placed"), ["dim", "hash_table", "bucket"], "rep", block)
    keys = ["dim", "hash_table", "bucket", "left_block", "right_block"]
    cells = cells.repartition(*keys).sortWithinPartitions(*keys)

    def close(rep, weight, own, blk, x, key):
        """Links of one cell, None where there are none."""
        if len(rep) < 2 or not own.any():
            return None
        if len(rep) <= 256:  # most cells hold no link at all
            s = x @ x[own].T
            s[np.flatnonzero(own), np.arange(s.shape[1])] = -1
            near = s.max(1) >= least
            near[np.flatnonzero(own)[s.max(0) >= least]] = True
            if not near.any():
                return None
            rep, weight, own, blk, x = rep[near], weight[near], own[near], blk[near], x[near]
        n, reach = _cell(rep, weight, own, blk, x, buckets(x, how), int(key[1]), int(key[2]), least, int(key[3]), int(key[4]))
        some = (n > 0) | (reach != rep)
        return rep[some], n[some], reach[some]

    def join(batches):
        rest = None
        for b in chain(batches, [None]):
            if b is not None:
                rest = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            if rest is None or not rest.num_rows:
                continue
            k = np.stack([rest.column(c).to_numpy() for c in keys])
            cuts = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [rest.num_rows]])
            whole = len(cuts) - (1 if b is None else 2)  # the last cell may go on in the next batch
            out = []
            for dim in np.unique(k[0, :cuts[whole]]):
                cells_of = np.flatnonzero(k[0, cuts[:whole]] == dim)
                lo, hi = cuts[cells_of[0]], cuts[cells_of[-1] + 1]
                part = rest.slice(lo, hi - lo)
                x = _vectors(part.column("embedding"))
                rep, weight, blk = (part.column(c).to_numpy() for c in ("rep", "weight", "block"))
                own = part.column("own").to_numpy(zero_copy_only=False)
                for c in cells_of:
                    s = slice(cuts[c] - lo, cuts[c + 1] - lo)
                    if cuts[c + 1] - cuts[c] > 1 and (got := close(rep[s], weight[s], own[s], blk[s], x[s], k[:, cuts[c]])) is not None:
                        out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["rep", "n", "reach"])
            rest = rest.slice(cuts[whole])

    found = scratch.stage(cells.mapInArrow(join, "rep long, n long, reach long"), "found")
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("reach").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    reps = groups.select("embedding", "rep", "weight").join(links, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    reps = reps.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = valid.join(reps, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

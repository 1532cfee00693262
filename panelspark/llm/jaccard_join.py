"""Exact self-join of documents by Jaccard similarity of word shingles, as a metric-space join.

Jaccard distance is a metric, but texts with no shingle in common are all at distance 1, so pivots among documents alone
say nothing about most pairs.  The regions are therefore built in two levels:

1. Pivots are single shingles.  With all shingles in one global order, a set belongs to the regions of its first
   `n - ceil(t n) + 1` shingles (its own cell and the window around it): two sets within the radius meet in at least one.
   The order puts shingles of many documents last, as a count sketch of the whole corpus tells.
2. In each region the document with the least id is a pivot.  Its distance to all others of the region is computed
   exactly; those within the radius are linked.  What is left are pairs of a region that no link connects so far: by the
   triangle inequality their distances to the pivot differ by the radius at most, and the distances of their class counts
   (shingle counts in 256 hash classes, which move by no more than the symmetric difference) bound the overlap.  Pairs
   inside these windows are computed exactly, large regions in cells of bounded size: first the nearest of each set, then,
   where these have not connected a region, all.

Regions of shingles of very many documents are salted; a second pivot level connects the salts' pivots.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import Scratch, chunks, gram_hashes, hash_filter, in_blocks, is_blank, lower_ascii, member, mix, span_hashes, text_buffer, word_spans
from panelspark.llm.components import connected_components

WORDS, PERCENT = 5, 80
CELLS = 1 << 20
PART = 1 << 14
CLASSES = 256
SALT_ABOVE = 12  # log2 of a shingle's estimated documents in one salt
BLOCK = 1024
NEAREST = 3
NO_ID = -(1 << 63)


def shingle_sets(column: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of n words; of all its words if there are fewer."""
    data, offs = text_buffer(column)
    data = lower_ascii(data)
    starts, ends, doc = word_spans(is_blank(data), offs)
    words = span_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    at = np.searchsorted(doc, np.arange(len(offs)))
    grams = gram_hashes(words, n)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        out.append(np.unique(grams[i:j - n + 1]) if j - i >= n else gram_hashes(words[i:j], j - i) if j > i else np.empty(0, np.uint64))
    return out


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, independent of order."""
    with np.errstate(over="ignore"):
        return tuple(int(np.uint64(mix(s, salt).sum(dtype=np.uint64)).astype(np.int64)) for salt in (21, 22))


def pack_classes(s: np.ndarray, classes: int) -> bytes:
    """Number of shingles in each hash class modulo 16, two in a byte."""
    n = np.bincount((s & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 15
    return (n[:classes // 2] | n[classes // 2:] << 4).astype(np.uint8).tobytes()


def fine_classes(n: int) -> int:
    """A power of two that grows with the set, so that counts stay small: unrelated large sets are told apart too."""
    return max(CLASSES, 1 << (n // 2).bit_length())


def unpack_classes(column: pa.Array) -> np.ndarray:
    """One row for each value; all values must have one length."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.concatenate([packed & 15, packed >> 4], axis=1)


def fold_classes(x: np.ndarray, classes: int) -> np.ndarray:
    """The counts of fewer classes: those that the shorter hash does not tell apart add up."""
    while x.shape[1] > classes:
        half = x.shape[1] // 2
        x = (x[:, :half] + x[:, half:]) & 15
    return x


def classes_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over the classes of the distance on a circle of 16: never more than the symmetric difference of the sets."""
    d = (x - y) & 15
    return np.minimum(d, 16 - d).sum(1, dtype=np.int64)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64) & (CELLS - 1)


def count_sketch(docs: DataFrame) -> np.ndarray:
    """log2 of how far each cell's number of documents is above the usual cell's, 0 where it is not clearly above.

    Every task adds up a table of fixed size and hands it on compressed, in parts that are summed apart.
    """
    import zlib

    def count(batches):
        total = np.zeros(CELLS, np.int32)
        for b in chunks(batches, "text"):
            sets = shingle_sets(b.column("text"))
            total += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS).astype(np.int32)
        if total.any():
            for k in range(CELLS // PART):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(total[k * PART:(k + 1) * PART].tobytes(), 1)])], names=["part", "counts"])

    def add(table):
        total = np.zeros(PART, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), np.int32)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()])})

    out = np.zeros(CELLS, np.int64)
    for r in docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():  # 64 rows of fixed size
        out[r["part"] * PART:(r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.int64)
    usual = np.median(out)
    above = out - usual
    return np.where(above > 4 * np.sqrt(usual) + 8, np.log2(np.maximum(above, 1)), 0).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def describe(docs: DataFrame, level: np.ndarray, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, classes, fine, prefix, salt): set size and hash, shingles by hash class, the prefix in the global order and
    a salt for each of its shingles."""
    cast = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        lvl = cast.value
        for b in chunks(batches, "text"):
            rows = []
            for s in shingle_sets(b.column("text")):
                h1, h2 = _set_hash(s)
                of = lvl[_cell(s)]
                first = np.lexsort((s, of))[:prefix_length(len(s), percent)]
                turns = np.left_shift(1, np.maximum(of[first].astype(np.int64) - SALT_ABOVE, 0))
                classes, fine = pack_classes(s, CLASSES), pack_classes(s, fine_classes(len(s)))
                rows.append((len(s), h1, h2, classes, fine, s[first].view(np.int64), ((h1 & 0x7FFFFFFF) % turns).astype(np.int32)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["doc_id", "n", "h1", "h2", "classes", "fine", "prefix", "salt"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, classes binary, fine binary, prefix array<long>, salt array<int>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, members) of the sets in `wanted` (rid, doc_id, h1, h2), from the documents that stand for them.

    A filter of fixed size on the id keeps nearly all other documents from being looked at; what it lets through in error,
    and rows that share an id, fall out in the join on the set's hash.
    """
    key = F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)))
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(wanted.select(key.alias("key")), "key"))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(member(bits.value, b.column("key").to_numpy().view(np.uint64))))
            for c in chunks([b], "text"):
                rows = [(*_set_hash(s), s.view(np.int64)) for s in shingle_sets(c.column("text")) if len(s)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["h1", "h2", "members"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(key.alias("key"), "text")
    found = ids.mapInArrow(run, "h1 long, h2 long, members array<long>")
    return wanted.select("rid", "h1", "h2").join(found, ["h1", "h2"]).select("rid", "members").dropDuplicates(["rid"])


def near_by_classes(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the fine class counts do not tell apart."""
    a, b = classes.select(F.col("rid").alias("a"), F.col("fine").alias("ca"), F.col("n").alias("na")), classes.select(F.col("rid").alias("b"), F.col("fine").alias("cb"), F.col("n").alias("nb"))

    def run(batches):
        for t in batches:
            kx, ky = (2 * pc.binary_length(t.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ca", "cb"))
            n = t.column("na").to_numpy() + t.column("nb").to_numpy()
            near = np.zeros(t.num_rows, bool)
            for k, m in set(zip(kx.tolist(), ky.tolist())):
                own = np.flatnonzero((kx == k) & (ky == m))
                for lo in range(0, len(own), max(1, (8 << 20) // max(k, m))):
                    at = own[lo:lo + max(1, (8 << 20) // max(k, m))]
                    x, y = (fold_classes(unpack_classes(t.column(c).take(pa.array(at))), min(k, m)) for c in ("ca", "cb"))
                    near[at] = classes_apart(x, y) * (100 + percent) <= (100 - percent) * n[at]
            yield t.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(b, "b").join(a, "a").mapInArrow(run, "a long, b long")


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the size of union and intersection."""
    a = sets.select(F.col("rid").alias("a"), F.col("members").alias("_ma"))
    b = sets.select(F.col("rid").alias("b"), F.col("members").alias("_mb"))
    both = F.size(F.array_intersect("_ma", "_mb")).cast("long")
    return pairs.join(b, "b").join(a, "a").select("a", "b", both.alias("both"), (F.size("_ma") + F.size("_mb")).cast("long").alias("total")).withColumn("either", F.col("total") - F.col("both")).drop("total")


def _linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * F.col("either")


def window_pairs(cells: DataFrame, percent: int, nearest: int | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows (region, rid, n, pos, comp, far, classes, block ...) of a cell that are in different
    components and inside all windows; with `nearest`, only so many for each row, those with the closest class counts.

    `pos` is the region's place in the set's global order.  In the first region that two sets share, only what comes after it
    can be common too; pairs within the radius pass there, and most of their later regions do not repeat them.
    """
    keys = ["region", "left_block", "right_block"]
    slack = (100 - percent) / 100
    cells = cells.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            get = lambda c: t.column(c).to_numpy()
            rid, n, comp, far, block, rest = get("rid"), get("n"), get("comp"), get("far"), get("block"), get("n") - get("pos")
            vec = unpack_classes(t.column("classes"))
            order = np.argsort(n, kind="stable")
            rid, n, comp, far, block, rest, vec = rid[order], n[order], comp[order], far[order], block[order], rest[order], vec[order]
            upto = np.searchsorted(n * percent, n * 100, "right")  # the larger set has 100 / percent of the smaller at most
            out_a, out_b = [], []
            for i in range(len(rid)):
                j = np.arange(i + 1, upto[i])
                j = j[(comp[j] != comp[i]) & (np.minimum(rest[j], rest[i]) * (100 + percent) >= percent * (n[j] + n[i]))]
                if key[1] != key[2]:
                    j = j[block[j] != block[i]]
                j = j[~(np.abs(far[j] - far[i]) > slack + 1e-9)]  # no distance known: stays
                if len(j):
                    apart = classes_apart(vec[j], vec[i])
                    inside = apart * (100 + percent) <= (100 - percent) * (n[j] + n[i])
                    j = j[inside]
                    if nearest is not None and len(j) > nearest:
                        j = j[np.argsort(apart[inside], kind="stable")[:nearest]]
                out_a.append(np.full(len(j), rid[i]))
                out_b.append(rid[j])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            return np.minimum(a, b), np.maximum(a, b)

        def batch(pair):
            return pa.RecordBatch.from_arrays([pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in keys])
            cuts = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [b.num_rows]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                now = tuple(k[:, lo])
                if key is not None and now != key:
                    yield batch(close())
                    held.clear()
                key = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield batch(close())

    return cells.mapInArrow(run, "a long, b long").distinct()


def link_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of (doc_id, text).

    Two texts link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the least doc_id
    that links reach, also through texts with equal sets.  Null, empty and blank texts have an empty set, link with nothing
    and are their own component.  Rows with equal doc_id are rows of their own with that id; a null doc_id takes part but is
    never a component's id, unless all its members have none.  Further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    level = count_sketch(docs)
    described = scratch.stage(describe(docs, level, percent).withColumn("rid", F.monotonically_increasing_id()), "described")
    ids = scratch.stage(described.select("doc_id", "rid", "n", "h1", "h2"), "ids")
    once = described.where("n > 0").groupBy("h1", "h2").agg(F.min_by(F.struct("rid", "doc_id", "n", "classes", "fine", "prefix", "salt"), "rid").alias("p")).select("h1", "h2", "p.*")
    reps = scratch.stage(once, "reps")
    scratch.drop(described)
    tokens = reps.select("rid", "n", F.posexplode(F.arrays_zip("prefix", "salt")).alias("pos", "p")).select(F.col("p.prefix").alias("region"), F.col("p.salt").alias("salt"), "rid", "n", "pos")
    tokens = tokens.repartition("region", "salt").sortWithinPartitions("region", "salt", "rid")
    classes = reps.select("rid", "n", "classes", "fine")

    def shared(batches):
        """Rows of regions with several sets, with the region's pivot; of single ones only where other salts exist."""
        carry = None
        names = ["region", "salt", "rid", "n", "pos"]

        def emit(block):
            region, salt = block["region"], block["salt"]
            new = np.concatenate([[True], (region[1:] != region[:-1]) | (salt[1:] != salt[:-1])])
            group = np.cumsum(new) - 1
            size = np.bincount(group)[group]
            first = np.flatnonzero(new)[group]
            keep = (size > 1) | salted(region)
            cols = [block[c][keep] for c in names] + [block["rid"][first][keep], block["n"][first][keep]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*names, "pivot", "pivot_n"])

        for b in batches:
            if not b.num_rows:
                continue
            block = {c: b.column(c).to_numpy() for c in names}
            if carry is not None:
                block = {c: np.concatenate([carry[c], block[c]]) for c in names}
            last = np.flatnonzero((block["region"] != block["region"][-1]) | (block["salt"] != block["salt"][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield emit({c: v[:cut] for c, v in block.items()})
            carry = {c: v[cut:] for c, v in block.items()}
        if carry is not None and len(carry["rid"]):
            yield emit(carry)

    cast = spark.sparkContext.broadcast(level)

    def salted(region: np.ndarray) -> np.ndarray:
        return cast.value[_cell(region.view(np.uint64))] > SALT_ABOVE

    regions = scratch.stage(tokens.mapInArrow(shared, "region long, salt int, rid long, n long, pos int, pivot long, pivot_n long"), "regions")

    own = regions.where("rid <> pivot").select("rid", "n", "pivot", "pivot_n")
    tops = regions.where("rid = pivot").groupBy("region").agg(F.min(F.struct("rid", "n")).alias("t"), F.count("*").alias("salts")).where("salts > 1")
    across = regions.where("rid = pivot").join(tops, "region").where(F.col("rid") != F.col("t.rid")).select("rid", "n", F.col("t.rid").alias("pivot"), F.col("t.n").alias("pivot_n"))
    stars = own.unionByName(across).where(100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")).select(F.col("rid").alias("b"), F.col("pivot").alias("a")).distinct()
    stars = scratch.stage(near_by_classes(stars, classes, percent), "stars")

    def members(pairs, known=None):
        need = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
        need = need if known is None else need.join(known, "rid", "left_anti")
        return scratch.stage(sets_of(docs, scratch.stage(need.join(reps.select("rid", "doc_id", "h1", "h2"), "rid"), "wanted")), "sets")

    sets = members(stars)
    measured = scratch.stage(measure(stars, sets), "measured")
    direct = measured.where(_linked(percent)).select("a", "b")
    first = scratch.stage(connected_components(direct, scratch), "first")

    far = measured.select(F.col("a").alias("pivot"), F.col("b").alias("rid"), (1 - F.col("both") / F.col("either")).alias("far"))

    def left_pairs(first, done, nearest):
        """Pairs of regions with several components that neither windows nor earlier measuring decide."""
        comp = regions.select("region", "rid", "n", "pos", "pivot").join(first.select(F.col("id").alias("rid"), "component"), "rid", "left").withColumn("comp", F.coalesce("component", "rid")).drop("component")
        mixed = comp.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi AND m > 2").select("region")
        left = scratch.stage(comp.join(mixed, "region").join(far, ["pivot", "rid"], "left").join(classes.select("rid", "classes"), "rid"), "left")
        # distances to different pivots do not compare, so a region with several (salted) has none
        one = left.groupBy("region").agg((F.min("pivot") == F.max("pivot")).alias("one"))
        known = F.when(F.col("one"), F.when(F.col("rid") == F.col("pivot"), 0.0).otherwise(F.coalesce("far", F.lit(float("nan"))))).otherwise(float("nan"))
        cells = in_blocks(left.join(one, "region").select("region", "rid", "n", "pos", "comp", known.alias("far"), "classes"), ["region"], "rid", BLOCK)
        # written first: the optimizer would look up a pair among those done once for each region that holds it
        found = scratch.stage(window_pairs(cells, percent, nearest), "found")
        pairs = scratch.stage(near_by_classes(found.join(done, ["a", "b"], "left_anti"), classes, percent), "pairs")
        scratch.drop(found)
        scratch.drop(left)
        return pairs

    # the nearest pairs first: in a group of near copies they connect nearly all that the pivot did not, and connected
    # components need no more pairs; the second round then takes every pair that is left
    done, links = stars, direct
    for nearest in (NEAREST, None):
        pairs = left_pairs(first, done, nearest)
        sets = sets.unionByName(members(pairs, sets))
        links = links.unionByName(scratch.stage(measure(pairs, sets).where(_linked(percent)).select("a", "b"), "links"))
        done = done.unionByName(pairs)
        first = scratch.stage(connected_components(links, scratch), "first")
    roots = first

    node = ids.where("n > 0").groupBy("h1", "h2").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least_doc"))
    node = node.join(roots.select(F.col("id").alias("rid"), "component"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    best = node.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    node = node.join(best, "component").select("h1", "h2", "component_id")
    linked = ids.where("n > 0").join(node, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return scratch.last(linked.unionByName(ids.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))

"""Benchmark decontamination: rare seeds of two words with a gap, then Smith-Waterman alignment of words.

Words are lower-cased runs of letters and digits, as 64-bit hashes.  A seed is two words of an item that stand side by side
or have one word between them; it may be met in a document at either distance.  An alignment of m matches and e edits that
scores p = 2m - e has at least p/2 - 1 neighbouring matches with one edit between them at most, and each begins at a place
of its own in the item and in the document.  So of an item's places the commonest in the documents may be dropped, fewer
than that number, and the rest must still be met: the seeds kept are the rare ones, and no alignment above the threshold is
lost, whatever is substituted, put in or left out.

The items, in parts of bounded size, are index files on shared storage.  A first pass over the documents counts the seeds, a
second looks them up and aligns every stretch that meets enough places of an item, so neither documents nor seeds are shuffled.
"""
from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Scratch, Store, chunks, hash_filter, member, mix, span_hashes, text_buffer, word_spans

LEAST_SCORE = 0.45
#: Points of three words in a row: a short item needs as many, or all of its own.
LEAST_POINTS = 6
#: Words of the items in one index file; a larger benchmark takes a pass over the documents for each file.
PART_WORDS = 1 << 19
#: Meetings of documents and items worked on at once.
HITS = 1 << 21
MATCH, MISMATCH, GAP = 2, -1, -1
_GAP = np.ones(256, bool)
_GAP[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = False
_GAP[128:] = False


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the n+1 places where texts begin."""
    data, offs = text_buffer(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, doc = word_spans(_GAP[data], offs)
    return span_hashes(data, starts, ends), np.searchsorted(doc, np.arange(len(offs)))


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of the items with words; items with the same id are one text each and all count, a null id is an id."""
    def run(batches):
        for b in chunks(batches, "text"):
            w, at = word_hashes(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([w[i:j].view(np.int64) for i, j in zip(at[:-1], at[1:])], pa.list_(pa.int64()))], names=["item_id", "words"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, words array<long>").where(F.size("words") > 0)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9FB21C651E98DF25) + second * np.uint64(0xC2B2AE3D27D4EB4F), 2)


def text_keys(words: np.ndarray, text: np.ndarray, singles: bool) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of texts and the places of their first words, by place; `singles` adds each word as the seed of an item of one."""
    keys, places = [], []
    for gap in (1, 2):
        at = np.flatnonzero(text[:-gap] == text[gap:])
        keys.append(pair_keys(words[at], words[at + gap]))
        places.append(at)
    if singles:
        keys.append(mix(words, 1))
        places.append(np.arange(len(words)))
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return np.concatenate(keys)[order], place[order]


def item_seeds(texts: DataFrame) -> DataFrame:
    """(row, place, seed) of the distinct texts of the items."""
    def run(batches):
        for b in batches:
            out = [(np.empty(0, np.int64),) * 3]
            for row, words in zip(b.column("row").to_pylist(), b.column("words")):
                w = words.values.to_numpy().view(np.uint64)
                key, place = text_keys(w, np.zeros(len(w), np.int8), len(w) == 1)
                out.append((np.full(len(key), row), place, key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["row", "place", "seed"])

    return texts.select("row", "words").mapInArrow(run, "row long, place long, seed long")


def seed_counts(docs: DataFrame, bitmap: np.ndarray, singles: bool) -> DataFrame:
    """(seed, n): how often the documents have each; seeds of no item may be among them."""
    def run(batches):
        for b in chunks(batches, "text"):
            w, at = word_hashes(b.column("text"))
            key, _ = text_keys(w, np.repeat(np.arange(len(at) - 1), np.diff(at)), singles)
            seed, n = np.unique(key[member(bitmap, key)], return_counts=True)
            if len(seed):
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n)], names=["seed", "n"])

    return docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def points_needed(n: np.ndarray, least_score: float) -> np.ndarray:
    """Alignment points from which a passage is a leak of an item of n words."""
    return np.ceil(np.maximum(MATCH * n * least_score, np.minimum(MATCH * n, LEAST_POINTS)) - 1e-9).astype(np.int64)


def write_index(texts: DataFrame, seeds: DataFrame, counts: DataFrame, least_score: float, parts: int, root: str) -> list[int]:
    """One file for each part of the items: their words, what they need, and their rare seeds.

    A leak meets (points - 1) // 2 places of the item at least.  Three quarters of so many, the commonest, are dropped, and
    the other quarter is needed.
    """
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part")
    counted = seeds.join(counts, "seed", "left").select(part, "row", "place", "seed", F.coalesce("n", F.lit(0)).alias("n"))

    def write(items: pa.Table, seeds: pa.Table) -> pa.Table:
        items = items.sort_by("row")
        words, rows = items.column("words").combine_chunks(), items.column("row").to_numpy()
        size = np.diff(words.offsets.to_numpy())
        at = np.concatenate([[0], np.cumsum(size)])
        points = points_needed(size, least_score)
        met = np.maximum(1, (points - 1) // 2)
        dropped = met * 3 // 4
        item = np.searchsorted(rows, seeds.column("row").to_numpy())
        place = at[item] + seeds.column("place").to_numpy()
        cost = np.zeros(at[-1], np.int64)
        np.add.at(cost, place, seeds.column("n").to_numpy())
        begins = np.unique(place)  # the last place of an item of more than one word begins no seed
        own = np.searchsorted(at, begins, "right") - 1
        order = np.lexsort((begins, -cost[begins], own))
        nth = np.arange(len(begins)) - np.searchsorted(own, own)
        kept = np.zeros(at[-1], bool)
        kept[begins[order]] = nth >= dropped[own]
        seed, item = seeds.column("seed").to_numpy().view(np.uint64)[kept[place]], item[kept[place]]
        keys, key = np.unique(seed, return_inverse=True)
        out = io.BytesIO()
        np.savez(out, keys=keys, met=np.unique(key * len(rows) + item), words=words.flatten().to_numpy(), at=at, points=points, span=3 * size - points, need=met - dropped, row=rows)
        which = items.column("part")[0].as_py()
        Store(root).put(f"part-{which}", out.getvalue())
        return pa.table({"part": pa.array([which], pa.int32())})

    done = texts.select(part, "row", "words").groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(write, "part int").collect()
    return sorted(r["part"] for r in done)


_read: dict[str, dict[str, np.ndarray]] = {}


def read_index(root: str, part: int) -> dict[str, np.ndarray]:
    """The arrays of one part; a worker keeps one part."""
    name = f"{root}/part-{part}"
    if name not in _read:
        _read.clear()
        with np.load(io.BytesIO(Store(root).get(f"part-{part}"))) as f:
            _read[name] = {k: f[k] for k in f.files}
    return _read[name]


def stretches(ix: dict[str, np.ndarray], nth: np.ndarray, place: np.ndarray, text: np.ndarray, at: np.ndarray, words: tuple[int, int], items: tuple[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """(item, from, to, seeds met): stretches of texts that meet enough places of an item within its longest alignment.

    `nth` are the seeds met at `place`, ascending.  Too many meetings at once are halved, by words with an overlap of the
    longest alignment as long as that helps, then by items; a stretch may come twice.
    """
    n_items, reach = len(ix["row"]), int(ix["span"].max())
    lo, hi = (np.searchsorted(ix["met"], nth * n_items + i) for i in items)
    if (hi - lo).sum() > HITS and (words[1] - words[0] > 4 * reach or items[1] - items[0] > 1):
        if words[1] - words[0] > 4 * reach:
            mid = sum(words) // 2
            halves = [((words[0], mid + reach), items), ((mid, words[1]), items)]
        else:
            mid = sum(items) // 2
            halves = [(words, (items[0], mid)), (words, (mid, items[1]))]
        for w, i in halves:
            own = slice(*np.searchsorted(place, w))
            yield from stretches(ix, nth[own], place[own], text, at, w, i)
        return
    n = hi - lo
    met = ix["met"][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())] % n_items
    code = np.unique(met * len(text) + np.repeat(place, n))
    item, p = np.divmod(code, len(text))
    last = np.arange(len(code)) + ix["need"][item] - 1
    full = last < len(code)
    last = np.minimum(last, len(code) - 1)
    q = np.flatnonzero(full & (item[last] == item) & (text[p[last]] == text[p]) & (p[last] - p < ix["span"][item]))
    if not len(q):
        return
    i, d, span = item[q], text[p[q]], ix["span"][item[q]]
    start, end = np.maximum(at[d], p[last[q]] - span + 1), np.minimum(at[d + 1], p[q] + span)
    first = np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (start[1:] > end[:-1])])
    i, start, end = i[first], start[first], end[np.concatenate([np.flatnonzero(first)[1:], [len(q)]]) - 1]
    yield i, start, end, np.searchsorted(code, i * len(text) + end) - np.searchsorted(code, i * len(text) + start)


def leaks_of_part(docs: DataFrame, bitmap: np.ndarray, singles: bool, root: str, part: int) -> DataFrame:
    """(doc_id, row, score, end_word, n_seeds) of the alignments with the items of one part."""
    def run(batches):
        for b in chunks(batches, "text"):
            w, at = word_hashes(b.column("text"))
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            key, place = text_keys(w, text, singles)
            some = member(bitmap, key)
            key, place = key[some], place[some]
            ix = read_index(root, part)
            nth = np.minimum(np.searchsorted(ix["keys"], key), len(ix["keys"]) - 1)
            own = ix["keys"][nth] == key
            for item, start, end, seeds in stretches(ix, nth[own], place[own], text, at, (0, len(w)), (0, len(ix["row"]))):
                query, target = [ix["words"][ix["at"][i]:ix["at"][i + 1]] for i in item], [w[s:e].view(np.int64) for s, e in zip(start, end)]
                able = [k for k in range(len(item)) if most_points(np.isin(target[k], query[k])) >= ix["points"][item[k]]]
                able.sort(key=lambda k: len(target[k]))
                lo = 0
                while lo < len(able):  # stretches of like length together, about 130,000 words at most
                    hi = lo + 1
                    while hi < len(able) and (hi - lo) * len(target[able[hi]]) < 1 << 17:
                        hi += 1
                    k = np.array(able[lo:hi])
                    score, last = align([query[x] for x in k], [target[x] for x in k])
                    good = np.rint(score * MATCH * np.diff(ix["at"])[item[k]]) >= ix["points"][item[k]]
                    k, score, last = k[good], score[good], last[good]
                    if len(k):
                        d = text[start[k]]
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array(ix["row"][item[k]]), pa.array(score), pa.array(last + start[k] - at[d]), pa.array(seeds[k])],
                                                         names=["doc_id", "row", "score", "end_word", "n_seeds"])
                    lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, row long, score double, end_word long, n_seeds long")


def most_points(known: np.ndarray) -> int:
    """The most that an alignment inside these words can score, by which of them the item has: the best run of words."""
    sums = np.zeros(len(known) + 1, np.int64)
    np.cumsum(np.where(known, MATCH, max(MISMATCH, GAP)), out=sums[1:])
    return int((sums - np.minimum.accumulate(sums)).max())


def align(queries: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair over the score of the whole query, and where it ends in the target.

    All pairs advance row by row together.  Within a row the gap from the left is a running maximum.
    """
    n, wide, long = len(queries), max(map(len, targets)), max(map(len, queries))
    t = np.zeros((n, wide), np.int64)
    inside = np.zeros((n, wide), bool)
    q = np.zeros((n, long), np.int64)
    for i, (a, b) in enumerate(zip(queries, targets)):
        q[i, :len(a)], t[i, :len(b)], inside[i, :len(b)] = a, b, True
    size = np.array([len(a) for a in queries])
    slope = -GAP * np.arange(wide, dtype=np.int32)
    row = np.zeros((n, wide), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for k in range(long):
        live = (k < size)[:, None] & inside
        diagonal = np.zeros_like(row)
        diagonal[:, 1:] = row[:, :-1]
        new = np.maximum(np.maximum(diagonal + np.where(t == q[:, k:k + 1], MATCH, MISMATCH), row + GAP), 0)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        row = np.where(live, new, 0).astype(np.int32)
        top = row.max(1)
        better = top > best
        best[better], end[better] = top[better], row[better].argmax(1)
    return best / (MATCH * np.maximum(size, 1)), end + 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id, score, end_word, n_seeds): documents with a passage that aligns with a test item.

    One row per pair of ids with its best alignment; the score is 1 for the whole item word by word, and n_seeds are the places
    of the stretch that meet rare seeds.  An item needs `least_score`, and the points of three words in a row or all of its
    words.  Null and empty texts and items have no words and match nothing; rows with equal ids, null ids too, are scored each
    and give one row with the best; equal items are aligned once.  Ties take the earlier end.  Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    items = scratch.stage(item_words(benchmark), "items")
    texts = scratch.stage(items.select("words").distinct().withColumn("row", F.monotonically_increasing_id()), "texts")
    total, shortest = texts.agg(F.sum(F.size("words")), F.min(F.size("words"))).first()
    if total is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long, n_seeds long")
    seeds = scratch.stage(item_seeds(texts), "seeds")
    bitmap = hash_filter(seeds, "seed", min(1 << 27, max(1 << 23, 1 << (32 * total).bit_length())))  # 16 MB at most
    counts, root = scratch.stage(seed_counts(docs, bitmap, shortest == 1), "counts"), scratch.folder("index")
    parts = write_index(texts, seeds, counts, least_score, -(-total // part_words), root)
    found = [leaks_of_part(docs, bitmap, shortest == 1, root, p) for p in parts]
    while len(found) > 1:  # a flat tree of unions
        found = [a.unionByName(*b) if b else a for a, *b in (found[i:i + 2] for i in range(0, len(found), 2))]
    best = F.max(F.struct("score", (-F.col("end_word")).alias("e"), "n_seeds")).alias("b")
    names = items.join(texts, "words").select("row", "item_id").distinct()
    return found[0].join(names, "row").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", (-F.col("b.e")).alias("end_word"), "b.n_seeds")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a leak; rows with a null doc_id stay only if no row with a null doc_id leaks."""
    leaks = Scratch(docs.sparkSession).stage(find_leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_leak"]), "left_anti")

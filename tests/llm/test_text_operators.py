"""Scores, line dedup, near duplicates, decontamination and packing against brute force, and the awkward inputs."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, jaccard_join, line_dedup, packing, quality, queries, token_files, toxicity

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (4, "one two"), (5, LONG), (6, LONG), (None, "no id here at all"), (7, "it's\r\nX <|endoftext|>  y \u00a0z é"), (8, "\n\n\n")]
SCHEMA = "doc_id long, text string"
#: Columns of operators' own tables, to clash with.
EXTRA = ("n", "key", "score", "rid", "h1", "component", "region", "start", "label", "fold", "p", "words", "n_lines", "weight", "left_block")


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    return df.withColumns({c: F.lit("own") for c in EXTRA})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit("own") for c in EXTRA})


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def sentences(seed, n, words=60, vocabulary=4000):
    r = random.Random(seed)
    return [" ".join(f"t{r.randrange(vocabulary)}" for _ in range(words)) for _ in range(n)]


# ---- scores

@pytest.mark.parametrize("query, column, least", [("op1_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.95)])
def test_scores_hold_out_of_sample(spark, sf, query, column, least):
    rows = queries.QUERIES[query](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("doc_id", "score", "predicted", column).collect()
    assert len(rows) > 80 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([r["predicted"] == r[column] for r in rows]) >= least


def test_scores_of_awkward_rows(spark, edges, empty):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, 1, 0), (6, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for module, want in ((quality, lambda d, l: quality.fit(d, l)[0]), (toxicity, toxicity.fit)):
        for d, l in ((edges, labels), (edges, labels.limit(0)), (empty, labels)):
            out = module.score(edges, want(d, l)).collect()
            assert len(out) == len(EDGES) and all(0 <= r["score"] <= 1 for r in out) and out[0]["key"] == "own"
            assert module.score(empty, want(d, l)).count() == 0


def test_prior_is_the_share_of_positives():
    rng = np.random.default_rng(0)
    positives, mixed = rng.normal(3, 1, 4000), np.concatenate([rng.normal(3, 1, 3000), rng.normal(-3, 1, 7000)])
    assert abs(quality.best_bin_prior(positives, mixed) - 0.3) < 0.03


def test_non_negative_risk_turns_round():
    outer = quality.non_negative_risk(0.9)
    low, high = np.full(4, -5.0), np.full(4, 5.0)
    up_p, up_u = outer(high, low)  # the bracket is negative: raise it again
    assert (up_p > 0).all() and (up_u < 0).all()


# ---- misspellings

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(3)
    terms = {"".join(r.choice("abcd") for _ in range(r.randint(3, 10))): "word" for _ in range(30)}
    trie, pieces = toxicity.Trie(terms), toxicity.Pieces(terms)
    for _ in range(3000):
        token = "".join(r.choice("abcd") for _ in range(r.randint(1, 12)))
        want = min(((d, t) for t in terms if (d := edit_distance(t, token)) <= toxicity.allowed_edits(t, "word")), default=None)
        got = trie.search(token, 2)
        assert (None if got is None else (got[2], got[0])) == want
        if want and want[0]:
            assert pieces.may_match(token)


def swap_distance(a, b):
    """Edits where two neighbours in the wrong order are one."""
    d = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2:i] == b[j - 2:j][::-1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("kind", ["word", "stem"])
def test_swaps_and_stems_equal_brute_force(kind):
    r = random.Random(4)
    terms = {"".join(r.choice("abcdefg") for _ in range(r.randint(4, 8 if kind == "stem" else 11))): kind for _ in range(12)}
    trie, pieces, found = toxicity.Trie(terms), toxicity.Pieces(terms), 0
    for _ in range(2000):
        t = list(r.choice(list(terms)))
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(t) - 1)
            t[i:i + 2] = r.choice([t[i:i + 2][::-1], t[i:i + 1], [r.choice("abcdefg"), *t[i + 1:i + 2]], [*t[i:i + 2], r.choice("abcdefg")]])
        token = "".join(t) + (r.choice(["", "g", "abc"]) if kind == "stem" else "")
        ends = range(len(token) + 1) if kind == "stem" else [len(token)]
        want = min(((d, t) for t in terms if (d := min(swap_distance(t, token[:e]) for e in ends)) <= toxicity.allowed_edits(t, kind)), default=None)
        got = trie.search(token, 2, True)
        assert (None if got is None else (got[2], got[0])) == want
        if want and want[0]:
            found += 1
            assert pieces.may_match(token), token
    assert found > 300


def test_short_terms_stems_swaps_and_joined_words():
    m = toxicity.Matcher({"scum": "word", "idiot": "word", "stupid": "word", "moron": "word", "badstem": "stem"})
    for t, want in (("scuum", "scum"), ("scvm", "scum"), ("scumm", "scum"), ("scm", "scum"), ("idoit", "idiot"), ("stupdi", "stupid"), ("badtsem", "badstem"), ("badstm", "badstem"), ("bbadstemish", "badstem")):
        assert m.token(t) == (want, 1), t
    for t in ("idiot,moron", "idiot/moron", "Idiot--MORON!", "you/idiot_moron"):
        assert [h[1:] for h in m.hits(t)] == [("idiot", 0), ("moron", 0)], t
    assert [h[1:] for h in m.hits("idoit/m0ron")] == [("idiot", 1), ("moron", 1)]
    assert m.features("what an idiot,moron there")[4] == pytest.approx(np.log1p(2))
    assert toxicity.Matcher({"scum": "word"}, frozenset({"scam"})).token("scam/spam") is None


def test_spellings_and_quotation():
    m = toxicity.Matcher({"horrid": "word", "badstem": "stem"})
    for t, kind in (("horrid", 0), ("Horrid!!", 0), ("h0rrid", 1), ("horid", 1), ("horrrrid", 1), ("h.o.r.r.i.d", 1), ("badstemish", 0)):
        assert m.token(t)[1] == kind, t
    for t in ("florid", "horribly", "badly", "", "***"):
        assert m.token(t) is None
    abuse, quote = m.features("you are a horrid person"), m.features('she wrote "a horrid person" there')
    assert abuse[0] > 0 and abuse[2] == 0 and quote[0] == 0 and quote[2] > 0


# ---- line dedup

def brute_lines(rows, chars=40, docs=5):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    has = collections.defaultdict(list)
    for i, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            has[k].append(float("-inf") if d is None else d)
    gone = {k: max(v) for k, v in has.items() if len(k) >= chars and len(v) >= docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (key(x) in gone and gone[key(x)] != (float("-inf") if d is None else d))]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def test_line_dedup_equals_brute_force(spark, edges, empty):
    r = random.Random(5)
    pool = [f"Common Line number {i} that many documents have, é{'x' * i}" for i in range(8)] + ["short", "", "Ünïcode " + "ß" * 31, "Ünïcode " + "ß" * 32]
    rows = [(i // 2, "\n".join(r.choice(pool) + r.choice(["", " ", "\t\r"]) if r.random() < 0.7 else f"own line of document {i} and nobody else has it" for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(None, pool[0]), (99, None), *EDGES]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})
    out = line_dedup.drop_repeated_lines(df)
    assert set(df.columns) <= set(out.columns)
    got = [(x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in out.collect()]
    assert collections.Counter(got) == collections.Counter(brute_lines(rows)) and any(x[3] for x in got)
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    mph = line_dedup.PerfectHash.build(keys)
    assert sorted(mph.slot(keys)) == list(range(len(keys)))


# ---- near duplicates

def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def near_copies():
    """Groups around the threshold, a passage that many share, chains, equal texts."""
    r, rows = random.Random(11), []
    passage = " ".join(f"p{i}" for i in range(55))
    for base in sentences(1, 12, 80):
        words = base.split()
        for _ in range(r.randint(1, 14)):
            w = list(words)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
            rows.append(" ".join(w))
            if r.random() < 0.5:
                words = w  # the next copy is of this one: a chain
    rows += [f"{passage} {s}" for s in sentences(2, 60, 12)] + [s.upper() for s in rows[:20]] + rows[:15]
    r.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)] + EDGES


def test_many_shards_are_opened_once_each(spark, tmp_path, monkeypatch):
    """300 shards, some without keys; every later probe reads what is open.  Whole reads stay within the bytes allowed."""
    r = np.random.default_rng(3)
    keys, marks = r.integers(0, 1 << 63, 20_000).astype(np.uint64), r.integers(0, 1 << 63, 20_000).astype(np.uint64)
    store = line_dedup.Store(f"{tmp_path}/shards")
    for k in range(300):
        if k % 7:
            own = keys % np.uint64(300) == k
            store.put(f"shard-{k:06d}", line_dedup._shard_bytes(keys[own], marks[own], np.full(own.sum(), 9), np.arange(own.sum())))
    reads, array = [], line_dedup.Store.array
    monkeypatch.setattr(line_dedup.Store, "array", lambda self, name, dtype: reads.append(name) or array(self, name, dtype))
    for _ in range(5):
        for k in range(300):
            table = line_dedup._shard(store.root, k)
            own = keys % np.uint64(300) == k
            assert (table is None) == (k % 7 == 0)
            if table is not None:
                assert (table[1][table[0].slot(keys[own])] == marks[own]).all() and (table[2] == 9).all()
    assert len(reads) == 300
    monkeypatch.setattr(line_dedup.Store, "array", lambda self, name, dtype: np.array(array(self, name, dtype)))
    monkeypatch.setattr(line_dedup, "CACHE_BYTES", 20_000)
    line_dedup._opened.clear()
    for k in range(300):
        line_dedup._shard(store.root, k)
        assert sum(held for held, _ in line_dedup._opened.values()) <= 20_000


def test_line_dedup_over_more_than_a_hundred_shards(spark, monkeypatch):
    lines = [f"line number {i} that is surely longer than forty characters" for i in range(400)]
    r = random.Random(8)
    rows = [(i, "\n".join(r.sample(lines, 12) + [f"own {i}"])) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {x["doc_id"]: x["text"] for x in line_dedup.drop_repeated_lines(df).collect()}
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    got = {x["doc_id"]: x["text"] for x in line_dedup.drop_repeated_lines(df).collect()}
    assert got == want
    count, last = collections.Counter(x for _, t in rows for x in set(t.split("\n"))), {x: i for i, t in rows for x in t.split("\n")}
    assert got == {i: "\n".join(x for x in t.split("\n") if len(x) < 40 or count[x] < 5 or last[x] == i) for i, t in rows}



def test_components_equal_brute_force(spark, empty, monkeypatch):
    rows = near_copies()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})
    for salt, block in ((12, 1024), (0, 8)):  # also with every frequent region salted and cut into cells
        monkeypatch.setattr(jaccard_join, "SALT_ABOVE", salt)
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = collections.Counter(map(tuple, jaccard_join.link_documents(df).collect()))
        assert got == brute_components(rows)
    assert jaccard_join.link_documents(empty).count() == 0


# ---- decontamination

def test_leaks_are_found_and_clean_documents_stay(spark, edges, empty):
    r = random.Random(7)
    items = [(i, t) for i, t in enumerate(sentences(3, 20, 30))] + [(50, None), (51, ""), (52, "two words"), (3, "a second text with the same id as one above, long enough")]
    clean = sentences(4, 40, 200)
    rows, want = [(i, t) for i, t in enumerate(clean)], set()
    for k in range(20):
        w = items[k][1].split()
        for i in range(0, len(w), 9):  # edited: substituted, dropped and inserted words
            w[i] = r.choice(["", "zzz", w[i] + " qqq"])
        host = clean[k].split()
        rows.append((100 + k, " ".join(host[:90] + ["\n" + " ".join(w).upper() + "!"] + host[90:])))
        want.add((100 + k, k))
    df = spark.createDataFrame(rows + EDGES, SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("own"))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(df, bench).collect()}
    assert got == want
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 20
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_widely_quoted_half_of_an_item_is_a_leak_everywhere(spark):
    """Equal to an alignment of every document with every item: most documents hold the first half, few the whole."""
    r = random.Random(13)
    items = list(enumerate(sentences(5, 3, 40)))
    half, whole = items[0][1].split()[:20], items[0][1].split()
    host = [s.split() for s in sentences(6, 1300, 30)]
    part = [half] * 1200 + [whole] * 40 + [half[:9] + ["zz"] + half[10:] + whole[20:24]] * 10 + [half[:12]] * 10 + [items[1][1].split()[5:28]] * 10 + [half[:3]] * 10 + [[]] * 20
    rows = [(i, " ".join(h[:15] + p + h[15:])) for i, (h, p) in enumerate(zip(host, part))]
    r.shuffle(rows)
    pairs = [(d, i, t, q) for d, t in rows for i, q in items]
    score, _ = decontaminate.align([np.array([hash(x) for x in q.split()]) for *_, q in pairs], [np.array([hash(x) for x in t.split()]) for _, _, t, _ in pairs])
    want = {(d, i): s for (d, i, _, _), s in zip(pairs, score) if s >= decontaminate.LEAST_SCORE}
    got = decontaminate.find_leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in got} == want and len(want) > 1250


def brute_leaks(rows, items, least=decontaminate.LEAST_SCORE):
    """Best score of every document with every item, by alignment of all pairs."""
    pairs = [(d, i, t.split(), q.split()) for d, t in rows for i, q in items if t and q]
    score, _ = decontaminate.align([np.array([hash(x) for x in q]) for *_, q in pairs], [np.array([hash(x) for x in t]) for _, _, t, _ in pairs])
    want = {}
    for (d, i, _, q), s in zip(pairs, score):
        if s >= least and s * 2 * len(q) >= min(2 * len(q), decontaminate.LEAST_POINTS):
            want[d, i] = max(s, want.get((d, i), 0))
    return want


def found_leaks(spark, rows, items, **how):
    return {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.find_leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), **how).collect()}


def test_every_edit_period_is_found_as_by_alignment_of_all_pairs(spark):
    """Words replaced, put in, left out and swapped at every period from 2 on, items of 1 to 60 words, few words in all, so that
    many seeds are common; also with index parts of few words."""
    r = random.Random(31)
    lengths = [1, 2, 3, 4, 5, 6, 7, 8, 11, 15, 20, 30, 30, 30, 45, 60]
    items = [(i, " ".join(f"t{min(r.randrange(600), r.randrange(600))}" for _ in range(n))) for i, n in enumerate(lengths)] + [(90, "t1 " * 12), (91, "t1 t2 " * 9)]
    rows = []
    for i, q in items:
        for period in range(2, 10):
            for edit in range(4):
                w = q.split()
                for k in range(period - 1, len(w), period):
                    w[k] = (f"zz{k}", f"{w[k]} qq{k}", "", f"{w[k]} {w[k]}")[edit]
                host = [f"t{min(r.randrange(600), r.randrange(600))}" for _ in range(50)]
                rows.append((len(rows), " ".join(host[:25] + w + host[25:])))
    want = brute_leaks(rows, items)
    assert sum(s < 0.6 for s in want.values()) > 30
    assert found_leaks(spark, rows, items) == want
    assert found_leaks(spark, rows, items, part_words=64) == want


def test_small_pieces_give_the_same_stretches(monkeypatch):
    r = np.random.default_rng(5)
    n_items, words = 40, 4000
    ix = {"row": np.arange(n_items), "span": r.integers(5, 40, n_items), "need": r.integers(1, 4, n_items), "met": np.unique(r.integers(0, 30, 400) * n_items + r.integers(0, n_items, 400))}
    text = np.sort(r.integers(0, 6, words))
    at = np.searchsorted(text, np.arange(7))
    place = np.sort(r.choice(words, 900, replace=False))
    nth = r.integers(0, 30, 900)

    def covered():
        out = set()
        for item, start, end, _ in decontaminate.stretches(ix, nth, place, text, at, (0, words), (0, n_items)):
            out |= {(i, x) for i, s, e in zip(item, start, end) for x in range(s, e)}
        return out

    whole = covered()
    monkeypatch.setattr(decontaminate, "HITS", 20)
    assert covered() == whole and len(whole) > 1000


def test_items_with_a_common_beginning_have_no_hot_seed(spark):
    """2,000 items and all documents share a phrase: its seeds are dropped, and no kept seed belongs to many items."""
    phrase = "which of the following is most true of the"
    items = [(i, f"{phrase} {t}") for i, t in enumerate(sentences(41, 2000, 24, 50_000))]
    rows = [(i, f"{phrase} {t}") for i, t in enumerate(sentences(42, 300, 60, 50_000))] + [(1000 + k, items[k * 7][1]) for k in range(50)]
    assert found_leaks(spark, rows, items) == {(1000 + k, k * 7): 1.0 for k in range(50)}
    from panelspark.llm.common import Scratch, hash_filter
    scratch = Scratch(spark)
    texts = scratch.stage(decontaminate.item_words(spark.createDataFrame(items, "item_id long, text string")).select("words").withColumn("row", F.monotonically_increasing_id()))
    seeds = scratch.stage(decontaminate.item_seeds(texts))
    counts = decontaminate.seed_counts(spark.createDataFrame(rows, SCHEMA), hash_filter(seeds, "seed"), False)
    root = scratch.folder("index")
    for part in decontaminate.write_index(texts, seeds, counts, 0.45, 2, root):
        ix = decontaminate.read_index(root, part)
        assert np.bincount(ix["met"] // len(ix["row"])).max() < 20


def test_alignment_equals_plain_smith_waterman():
    r = random.Random(9)
    pairs = [([r.randrange(6) for _ in range(r.randint(1, 12))], [r.randrange(6) for _ in range(r.randint(1, 25))]) for _ in range(200)]
    got, _ = decontaminate.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    for (a, b), g in zip(pairs, got):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert g == h.max() / (2 * len(a))


# ---- tokens

def test_units_give_the_tokenizer_s_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from panelspark.llm.tokens import UnitEncoder
    r = random.Random(1)
    alphabet = list("aB1é ñß \n\t ,.!'*«\"- s Σİ\u0301") + ["'s", "  ", "\r\n", "don't", " \xa0", "<|endoftext|>", "日本", "٣"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)] + [t or "" for _, t in EDGES]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = queries.tokenizer(name)
        flat, ends = UnitEncoder(path, spaced).encode(pa.array(texts))
        for i, e in enumerate(Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)):
            assert flat[ends[i]:ends[i + 1]].tolist() == e.ids, texts[i]


def ids_of(name, text, end):
    from tokenizers import Tokenizer
    return np.array(Tokenizer.from_file(queries.tokenizer(name)).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files_round_trip(spark, edges, empty):
    got = token_files.round_trip(edges, queries.tokenizer("word_bpe_49k.json"), 1, 49408).orderBy("start").collect()
    at, want = 0, []
    for d, t in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of("word_bpe_49k.json", t, 1)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.round_trip(empty, queries.tokenizer("word_bpe_49k.json"), 1, 49408).count() == 0


def test_packing_keeps_every_piece_in_place(spark, edges, empty):
    got = packing.pack(edges, queries.tokenizer("byte_bpe_50k.json")).collect()
    want, total = collections.Counter(), 0
    for d, t in EDGES:
        ids = ids_of("byte_bpe_50k.json", t, 0)
        total += len(ids)
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[d, k, s, n, zlib.crc32(ids[s:s + n].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(empty, queries.tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(100), packing.Limits(100, documents=3), packing.Limits(100, attention=2600, weights=(0.5, 0.2, 0.3))])
def test_plan_holds_every_constraint(limits):
    r = random.Random(2)
    histogram = collections.Counter(r.choice([r.randint(1, 50), r.randint(1, 8), 7]) for _ in range(5000))
    slots, n_bins = packing.plan_bins(dict(histogram), limits)
    tokens, docs, attention, ranks = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for s in sorted(slots, key=lambda s: (-s["length"], s["first"])):
        for rank in range(s["first"], s["last"]):
            b, turn = int(s["bin"] + (rank - s["first"]) // s["per_bin"]), (rank - s["first"]) % s["per_bin"]
            assert s["offset"] + turn * s["length"] == tokens[b]
            tokens[b] += int(s["length"])
            docs[b] += 1
            attention[b] += int(s["length"]) ** 2
            ranks[int(s["length"]), rank] += 1
    caps = limits.capacity()
    assert set(ranks.values()) == {1} and len(ranks) == 5000 and len(tokens) == n_bins
    assert max(tokens.values()) <= caps[0] and max(docs.values()) <= caps[1] and max(attention.values()) <= caps[2]
    if caps[1] == 100 and caps[2] == 10_000:
        assert n_bins <= -(-sum(k * v for k, v in histogram.items()) // 100) + 1
    with pytest.raises(ValueError):
        packing.plan_bins({101: 1}, limits)


def test_kept_hash_matches_text(spark, sf, documents):
    rows = {r["doc_id"]: r["kept_sha256"] for r in queries.op9_line_dedup(spark, sf).collect()}
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t, *_ in brute_lines([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])}
    assert rows == want

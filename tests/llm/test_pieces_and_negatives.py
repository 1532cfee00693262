"""SentencePiece ids against the library; hard negatives against plain integer arithmetic."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import hard_negatives as H, queries, sentencepieces as P

MODEL = queries.tokenizer("piece_bpe_32k.model")
AWKWARD = ["", " ", "  ", "\n", " \n \t", "a", "é", "日本語のテキスト", "😀 😀😀", "▁", "a▁b ▁▁ c", "<s> </s> <unk> <0x41>", "tab\tnew\r\nline", "x" * 5000, " " * 1000, "ab" * 3000, " 　", "\x00\x01",
           "Hello, World! 123.45", "aaaaaaabbbbb" * 40, "i" * 33 + "ng", "  leading", "trailing  ", "a  b   c    d", "ſtraße ǅ", "é", "\U0010ffff", "word " * 20_000]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def library_row(lib, doc_id, text):
    ids = lib.encode(text or "", add_bos=True, add_eos=True)
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def random_texts(n, seed):
    r = random.Random(seed)
    letters = "aeinst rdlo\n  .,'-äé日😀\t▁0"
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, 120))) for _ in range(n)]


def test_ids_and_text_equal_the_library(spark, library):
    texts = AWKWARD + random_texts(1500, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = P.encode(docs, MODEL)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    for i, t in enumerate(texts):
        assert got[i] == library.encode(t, add_bos=True, add_eos=True), repr(t[:60])
    back = {r["doc_id"]: r["text"] for r in P.decode(ids, MODEL).collect()}
    assert all(back[i] == library.decode(got[i]) for i in got)


def test_any_ids_decode_like_the_library(spark, library):
    r = random.Random(2)
    lists = [[r.choice([r.randrange(32_000), r.randrange(3, 259), r.randrange(3)]) for _ in range(r.randrange(20))] for _ in range(400)] + [[], [1, 2]]
    rows = spark.createDataFrame(list(enumerate(lists)) + [(-1, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in P.decode(rows, MODEL).collect()}
    assert got.pop(-1) is None
    for i, ids in enumerate(lists):
        assert got[i] == library.decode(ids), ids


def test_search_equals_step_by_step_merging():
    enc, r = P.PieceEncoder(MODEL).search, random.Random(3)
    pieces = sorted(enc.model.ids)
    for _ in range(3000):
        unit = "".join(r.choice(pieces) for _ in range(r.randrange(1, 5)))
        assert enc.split(unit) == enc.merged(unit), unit


def test_search_steps_back_and_marks_failed_places():
    """A model in which the longest piece is wrong twice in a row."""
    class Toy:
        score = {p: -i for i, p in enumerate(["bc", "ab", "abc", "cd", "bcd", "a", "b", "c", "d"])}
        ids = {p: i for i, p in enumerate(score)}
        byte_id, unknown = {}, 99
    enc, letters = P.BacktrackEncoder(Toy), random.Random(4)
    for _ in range(2000):
        unit = "".join(letters.choice("abcdz") for _ in range(letters.randrange(1, 14)))
        assert enc.split(unit) == enc.merged(unit), unit
    assert 99 in enc.encode("az")


def test_memory_of_units_and_pairs_may_start_anew(spark, library, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(P, "PAIRS", 50)
    monkeypatch.setattr("panelspark.llm.tokens.UNITS", 20)
    enc = P.PieceEncoder(MODEL)
    for seed in range(5):
        texts = random_texts(40, 10 + seed)
        flat, at = enc.with_ends(*enc.encode(pa.array(texts)))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_bos=True, add_eos=True) for t in texts]


def test_awkward_tables(spark, library):
    rows = [(1, None), (2, ""), (3, "x y"), (3, "x y"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("ids", "n_tokens", "ids_sha256")})
    assert sorted(map(tuple, P.round_trip(docs, MODEL).collect()), key=str) == sorted((library_row(library, *r) for r in rows), key=str)
    assert P.round_trip(docs.limit(0), MODEL).collect() == [] and P.encode(docs.limit(0), MODEL).collect() == []


def test_query_equals_the_library(spark, sf, library):
    want = [library_row(library, r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_sentencepiece(spark, sf).collect())) == sorted(want)


# ---- hard negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, scale=256, keep=5, window=(80, 100)):
    """By definition, with Python integers."""
    rows = [(i, l, [math.floor(float(x) * scale) for x in e]) for i, l, e in rows if l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    order, out = lambda c: (-c[1], c[0] is None, c[0] or 0), []
    for a, la, ea in rows:
        if a is None or a % 100:
            continue
        scored = [(i, sum(x * y for x, y in zip(ea, e)), l) for i, l, e in rows]
        for p, ps, _ in sorted((c for c in scored if c[2] == la and c[0] != a), key=order)[:keep]:
            fit = sorted((c for c in scored if c[2] != la and window[0] * ps <= window[1] * c[1] <= window[1] * ps), key=order)
            out += [(a, p, k + 1, c[0], ps, c[1]) for k, c in enumerate(fit[:keep])]
    return sorted(out, key=str)


def mined(spark, rows, parts=3, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit("own") for c in ("block", "uid", "slot", "score", "rank", "anchor")})
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % 100 == 0, **more).collect()), key=str)


def vectors(n, dim, seed, spread=1.0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(4, dim))
    e = (base[r.integers(0, 4, n)] + 0.4 * r.normal(size=(n, dim))) * spread
    return [(i, int(r.integers(0, 3)), np.float32(v).tolist()) for i, v in enumerate(e)]


@pytest.mark.parametrize("dim, spread", [(1, 1.0), (7, 0.05), (64, 0.1), (65, 3.0), (200, 50.0)])
def test_equals_plain_arithmetic(spark, dim, spread):
    rows = vectors(420, dim, dim, spread)
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 10


def test_products_are_exact_up_to_the_bound():
    r = np.random.default_rng(5)
    for size, dim in ((3, 64), (2000, 130), (1 << 20, 64), (1 << 24, 255)):
        a, b = r.integers(-size, size + 1, (9, dim)), r.integers(-size, size + 1, (11, dim))
        primes = H.primes_for(size * size * dim)
        assert (H.product(H.Residues(a, primes).parts, H.Residues(b, primes).parts, primes) == a @ b.T).all()
    assert H.SLICE * (H.PRIMES[0] // 2) ** 2 < 1 << 24 and len(H.primes_for(70_000)) == 2
    with pytest.raises(ValueError):
        H.primes_for(1 << 56)


def test_awkward_rows_ties_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(260, 6, 8)
    same = [0.25, -0.5, 0.25, 0.0, 0.5, 0.25]
    rows += [(1000 + i, i % 3, same) for i in range(60)]  # ties: a third of the rows are one vector
    rows += [(100, 1, same), (100, 1, same), (200, None, same), (300, 1, None), (400, 1, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (500, 1, [nan] * 6), (600, 2, [inf] * 6), (700, 0, []), (800, 0, [0.0] * 6),
             (None, 1, same), (None, 2, same), (-100, 2, same), (900, 2, same[:4]), (901, 2, same + [1.0, 2.0]), (1100, 5, same)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows, parts=11, keep=2, window=(50, 100), scale=16) == plain(rows, 16, 2, (50, 100))


def test_empty_table_and_no_anchors(spark):
    assert mined(spark, [], 1) == [] and mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (2, 2, [1.0])]) == []


def test_many_blocks_tiles_and_files(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHORS", 2)
    rows = [(i * 50, l, e) for i, l, e in vectors(300, 8, 11)]
    assert mined(spark, rows, 9) == plain(rows)


def test_query_equals_plain_arithmetic(spark, sf):
    rows = [(r["vec_id"], None if r["label"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, sf).collect()), key=str) == plain(rows)

"""Archives, URL verdicts, vectors, components and the pipeline against brute force."""
import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import near_vectors, queries, url_filter, warc
from panelspark.llm.common import Scratch
from panelspark.llm.components import connected_components
from tools.check_oracle import TABLES, norm

PAGES = "page_id long, url string, html string"


def connect(sf):
    con = duckdb.connect()
    for t in dict.fromkeys([*TABLES, "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_oracle(spark, sf, name):
    df, rel = queries.QUERIES[name](spark, sf), connect(sf).sql(queries.ORACLE[name])
    order = [df.columns.index(c) for c in rel.columns]
    assert sorted(tuple(norm(r[i]) for i in order) for r in df.collect()) == sorted(tuple(norm(x) for x in r) for r in rel.fetchall())


# ---- archives

def page_rows():
    r = random.Random(4)
    shared = ["<p>" + "é" * 60 + "</p>", "x" * 99, "y" * 100, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "z" * 5000]
    rows = [(i, f"http://h{i}.example/\r\nX: y", r.choice(shared) if r.random() < 0.7 else "".join(r.choice("ab\r\né<") for _ in range(r.randint(0, 3000)))) for i in range(80)]
    return rows + [(80, None, None), (81, "", ""), (2, "again", rows[2][2]), (None, "u", "own " * 40), (None, "u", shared[4]), (90, "u", "long" * 200_000)]


def brute_records(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= 100:
            first[b] = min(p, first.get(b, p))
    out = collections.Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        back = first[b] if p is not None and b in first and first[b] != p else None
        out[p, len(b), hashlib.sha256(b).hexdigest(), "response" if back is None else "revisit", back] += 1
    return out


def test_archives_round_trip_in_segments_and_chunks(spark):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("own") for c in ("payload_bytes", "refers_to", "name", "n")})
    got = warc.round_trip(df, segment_bytes=1000, chunk_bytes=300, file_bytes=4000)
    assert collections.Counter(map(tuple, got.collect())) == brute_records(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chunk_table_carries_payload_and_digest(spark):
    rows = page_rows()
    scratch = Scratch(spark)
    root = scratch.folder("warc")
    files = scratch.stage(warc.write_archives(warc.plan_records(spark.createDataFrame(rows, PAGES)), root, segment_bytes=700), "files")
    chunks = collections.defaultdict(list)
    for r in warc.read_chunks(spark, files, root, chunk_bytes=250).where("record_type = 'response' AND page_id >= 80").collect():
        assert r["data"] is None or len(r["data"]) <= 250
        chunks[r["page_id"]].append((r["chunk_no"], bytes(r["data"] or b""), r["bytes_so_far"], r["sha256_so_far"], r["is_last"]))
    for page, _, html in rows:
        if page in (80, 81, 90):
            own, so_far = sorted(chunks[page]), b""
            assert [c[0] for c in own] == list(range(len(own))) and [c[4] for c in own] == [False] * (len(own) - 1) + [True]
            for _, data, n, digest, _ in own:
                so_far += data
                assert n == len(so_far) and digest == hashlib.sha256(so_far).hexdigest()
            assert so_far == (html or "").encode()


# ---- URLs

RULES = [url_filter.Rule(*r) for r in queries.URL_RULES]


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def brute_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_hosts_and_rules_equal_brute_force(spark):
    r = random.Random(6)
    urls = [f"{r.choice(['http', 'HTTPS', ''])}{r.choice(['://', '://', ':/'])}{r.choice(['', 'www.', 'a.b.'])}{r.choice(['Example.ORG', 'org', 'xorg', 'x.com', 'com', 'é.net', ''])}"
            f"{r.choice(['', '/', '/es/', '/en/12', '/en/2', '/fr/x', '/de/', '?q=/fr/', '#/de/', '/a://b/'])}{r.choice(['', '?x#y', '#top'])}" for _ in range(400)] + [None, "", "://", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(urls + urls[:20])), "page_id long, url string").withColumns({c: F.lit("own") for c in ("host", "cls", "fold", "rule", "score")})
    got = url_filter.judge(df, RULES).collect()
    assert len(got) == len(urls) + 20
    for x in got:
        url = (urls + urls[:20])[x["page_id"]]
        host, path = brute_split(url)
        rule = brute_rule(host, path)
        assert (x["host"], x["path"]) == (host, path) and x["rule"] == (rule and rule.text) and x["verdict"] in ("allow", "block")
        if rule:
            assert x["verdict"] == rule.verdict
    assert url_filter.judge(df.limit(0), RULES).count() == 0
    assert {x["verdict"] for x in url_filter.judge(df, []).collect()} == {"allow"}


def test_models_tell_classes_apart(spark):
    r = random.Random(8)
    good, bad = [f"https://news{r.randrange(99)}.example.net/story/{r.randrange(10 ** 5)}" for _ in range(400)], [f"http://pills{r.randrange(99)}.example.net/buy-cheap/{r.randrange(10 ** 5)}" for _ in range(400)]
    rules = [url_filter.Rule("org/", "allow"), url_filter.Rule("com/", "block")]
    train = [u.replace(".net", ".org") for u in good[:200]] + [u.replace(".net", ".com") for u in bad[:200]]
    df = spark.createDataFrame(list(enumerate(train + good[200:] + bad[200:])), "page_id long, url string")
    got = {x["page_id"]: x["verdict"] for x in url_filter.judge(df, rules).where("rule IS NULL").collect()}
    assert len(got) == 400 and np.mean([v == ("allow" if k < 600 else "block") for k, v in got.items()]) > 0.95


def test_scores_come_from_exact_counts_however_many_contexts(spark):
    """Every count against a dictionary, with more distinct contexts than the 65,536 cells that all once shared."""
    r = random.Random(10)
    urls = [f"http://h{r.randrange(9)}.example.{t}/" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for t in ("org", "com") for _ in range(1100)] + ["http://x.net/a", "", "http://x.net/a"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x["page_id"]: x["score"] for x in url_filter.judge(df, [url_filter.Rule("org/", "allow"), url_filter.Rule("com/", "block")]).collect()}
    count = [[collections.defaultdict(collections.Counter) for _ in range(url_filter.ORDERS + 1)] for _ in range(2)]
    marked = [[257] * url_filter.ORDERS + list(u.encode()) + [256] for u in urls]
    for i, m in enumerate(marked[:2200]):
        for at in range(url_filter.ORDERS, len(m)):
            for k in range(url_filter.ORDERS + 1):
                count[i < 1100][k][tuple(m[at - k:at])][m[at]] += 1
    assert min(len(c[-1]) for c in count) > 1 << 15
    for i in [*range(0, 2200, 50), 2200, 2201, 2202]:
        m, log = marked[i], [0.0, 0.0]
        for at in range(url_filter.ORDERS, len(m)):
            for cls in (0, 1):
                p = 1 / url_filter.ALPHABET
                for k in range(url_filter.ORDERS + 1):
                    own = count[cls][k].get(tuple(m[at - k:at]), {})
                    c = sum(own.values())
                    back = max(len(own) / (c + len(own)), url_filter.LEAST_BACKOFF) if c else 1.0
                    p = (1 - back) * (own.get(m[at], 0) / c if c else 0) + back * p
                log[cls] += np.log(p)
        assert got[i] == pytest.approx((log[1] - log[0]) / (len(m) - url_filter.ORDERS), abs=1e-9)


# ---- vectors

def brute_links(rows, least=0.9):
    ok = [i for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    near = collections.defaultdict(set)
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i < j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        root = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((v, len(near[i]), root, v is None or v == root))
    return collections.Counter(out)


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for c in rng.normal(size=(40, 24)):
        for _ in range(rng.integers(1, 12)):
            rows.append((c + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.2, 0.35])).astype(np.float32).tolist())
    hot = rng.normal(size=24)
    rows += [(hot + rng.normal(size=24) * 0.15).astype(np.float32).tolist() for _ in range(120)]
    rows += [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] + [0.0] * 23, [1.0, 2.0], [2.0, 4.0], [3.0], [1e38] * 24, [1e-38] * 24]
    ids = rng.permutation(len(rows)).tolist()
    rows = [(int(i), r) for i, r in zip(ids, rows)] + [(None, rows[0]), (int(ids[1]), rows[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in ("rep", "weight", "bucket", "block", "n", "dim")})
    rows = [(v, e and [None if x is None else float(np.float32(x)) for x in e]) for v, e in rows]
    assert collections.Counter(map(tuple, near_vectors.link_vectors(df, block=block).collect())) == brute_links(rows)
    assert near_vectors.link_vectors(df.limit(0)).count() == 0


def test_hashing_finds_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(2, 3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for n in (500, 50_000, 5_000_000):
        how = near_vectors.Hashing.for_rows(n, 64)
        a, b = near_vectors.buckets(x[:1000], how), near_vectors.buckets(y[:1000], how)
        assert ((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2)).mean() > 0.99


def test_components(spark):
    r = random.Random(12)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(100)] + [(7, 7), (None, 3)]
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


# ---- pipeline

def test_stages_on_their_own_inputs(spark, sf):
    from test_text_operators import brute_components, brute_lines
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = scratch.stage(stage(spark, docs, sf), "stage")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS and set(after) <= set(before)
        if name == "toxicity":
            toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            right = [(d in after) == (toxic[d] == 0) for d in before if d in toxic]
            assert np.mean(right) > 0.95
        elif name == "line dedup":
            want = {d: t for d, t, *_ in brute_lines([(d, r["text"]) for d, r in before.items()])}
            assert {d: r["text"] for d, r in after.items()} == want and all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "n-gram Jaccard join":
            parts = brute_components([(d, r["text"]) for d, r in before.items()])
            assert set(after) == {d for d, _, c in parts if d == c}
        else:
            items = [" ".join(re_words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            whole = {d for d, r in before.items() if any(f" {i} " in f" {' '.join(re_words(r['text']))} " for i in items)}
            assert whole and not whole & set(after) and len(after) > 0.9 * len(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def re_words(text):
    import re
    return re.findall(r"\w+", (text or "").lower())


def test_stages_take_empty_tables(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0

"""The dataset manifest against a plain tree in Python: group sizes around the powers of eight, awkward rows, bounded rows."""
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from panelspark.llm import manifest, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LONG = "Word " * 50_000


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))


def tree(nodes):
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, w in enumerate(at):
            lo = w // 8 * 8
            paths[i].append(("".join(level[lo:w]), "".join(level[w + 1:lo + 8])))
            at[i] = w // 8
        level = [sha("".join(level[k:k + 8])) for k in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    done = []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        done.append((mine, *tree([leaf(r) for r in mine])))
    if not done:
        return []
    root, tops = tree([s for _, s, _ in done])
    out = []
    for (mine, subroot, paths), top in zip(done, tops):
        for r, path in zip(mine, paths):
            acc = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                acc = leaf(r | {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])})
            for a, b in path + top:
                acc = sha(a + acc + b)
            out.append((r["doc_id"], leaf(r), subroot, root, sha("".join(a + b for a, b in path + top)), acc, acc == root))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_groups_of_all_sizes_and_awkward_rows(spark):
    rows = [(i, "s", f"l{n}", 3, f"Text {i}") for n in (1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513) for i in range(n)]
    rows += [(None, None, None, None, None), (5, None, None, 0, ""), (5, None, None, 0, ""), (5, "S", None, 0, "Ä É"), (6, "", "", -1, LONG), (-7, "x", "Z", 1, "ABC"), (-7, "x", "é", 1, "ABC")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain([r.asDict() for r in docs.collect()])
    clash = docs.repartition(5).withColumns({c: F.lit("own") for c in ("grp", "r", "n", "digest", "body", "path", "root", "leaf", "kids", "part", "uid", "block", "d0")})
    assert rows_of(manifest.verify_tampered(clash)) == sorted(want, key=str)


def test_empty_table_and_one_row(spark):
    assert manifest.verify_tampered(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(3, None, "en", 2, "Ab")], SCHEMA)
    assert rows_of(manifest.verify_tampered(docs)) == plain([docs.first().asDict()])


def test_a_hot_group_is_nested_in_bounded_blocks(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("Same").alias("text"))
    rolled = manifest._roll(docs.select(F.lit("g").alias("grp"), F.lit(5000).cast("long").alias("n"), F.col("doc_id").alias("r"), F.sha2("text", 256).alias("digest"), F.struct("doc_id").alias("body")), 0)
    sizes = [r["m"] for r in rolled.select(F.size(F.flatten(F.transform("kids", lambda a: a["body"]))).alias("m")).collect()]
    assert len(sizes) == 79 and sorted(set(sizes)) == [8, 64]
    out = manifest.verify_tampered(docs)
    assert rows_of(out) == sorted(plain([r.asDict() for r in docs.collect()]), key=str)


def test_same_doc_id_a_third_of_all_rows_is_dealt_out(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"),
                                    F.lit(1).cast("long").alias("n_chars"), F.lit("Text").alias("text"))
    assert rows_of(manifest.verify_tampered(docs)) == sorted(plain([r.asDict() for r in docs.collect()]), key=str)


def test_query_equals_the_plain_tree(spark, sf):
    want = plain([r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert rows_of(queries.op11_merkle_manifest(spark, sf)) == sorted(want, key=str)
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("value, text", [(None, "-"), ("", "0:"), ("ä", "2:ä"), ("a:b", "3:a:b")])
def test_framing_is_unambiguous(spark, value, text):
    assert spark.range(1).select(manifest.framed(F.lit(value).cast("string"))).first()[0] == text

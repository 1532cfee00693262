"""Token scan of the toxicity operator against matching every token; readers use a task a file."""
import random

import pyarrow as pa
from pyspark.sql import functions as F

from panelspark.llm import token_files, toxicity as T, warc
from panelspark.llm.common import Scratch
from panelspark.llm.queries import tokenizer

TERMS = {"idiot": "word", "scum": "word", "disgusting": "word", "pathetic": "word", "abc": "word", "vermin": "stem", "réeux": "stem"}


def spelled(word, r):
    kind = r.randrange(8)
    i = r.randrange(len(word))
    if kind == 0:
        return word[:i] + word[i + 1:]
    if kind == 1:
        return word[:i] + r.choice("abcxyzé") + word[i:]
    if kind == 2:
        return word[:i] + r.choice("abcxyzé") + word[i + 1:]
    if kind == 3 and i:
        return word[:i - 1] + word[i] + word[i - 1] + word[i + 1:]
    if kind == 4:
        return word[:i] + word[i] * r.choice([3, 45]) + word[i + 1:]
    if kind == 5:
        return "-".join(word)
    if kind == 6:
        return word.upper() + r.choice(["!", ",more", "/and", " x"])
    return word + r.choice(["", "s", "ous" * 20])


def test_scan_finds_the_texts_that_matching_every_token_finds(monkeypatch):
    r, letters = random.Random(5), "abcdeghimnopstuv réxü.,-3 "
    texts = [None, "", "  \n"] + [" ".join(r.choice([spelled(r.choice(list(TERMS)), r), "".join(r.choice(letters) for _ in range(r.randrange(1, 12)))]) for _ in range(r.randrange(1, 4))) for _ in range(4000)]
    m = T.Matcher(TERMS, frozenset({"idiots"}))
    want = [any(m.hits(t) for t in T._TOKEN.findall(x or "")) for x in texts]
    scan = T.TokenScan(T.Matcher(TERMS, frozenset({"idiots"})))
    assert scan.texts_with_hits(pa.array(texts)).tolist() == want and 500 < sum(want) < 3800
    assert scan.texts_with_hits(pa.array(texts)).tolist() == want  # now all tokens are known
    monkeypatch.setattr(T, "TOKENS", 100)
    assert sum((scan.texts_with_hits(pa.array(texts[i:i + 300])).tolist() for i in range(0, len(texts), 300)), []) == want


def test_long_tokens_are_matched():
    m = T.Matcher(TERMS)
    for token in ("idi" + "o" * 50 + "t", "vermin" + "x" * 200, "pa" + "t" * 100 + "hetic!"):
        assert m.token(token), token
    assert not m.token("b" * 5000) and not m.token("ab" * 3000)


def tasks_with_files(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_archives_and_token_files_are_read_by_many_tasks(spark):
    scratch = Scratch(spark)
    pages = spark.range(240).select(F.col("id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.repeat(F.lit("x y "), (F.col("id") + 100).cast("int")).alias("html"))
    root = scratch.folder("warc")
    files = scratch.stage(warc.write_archives(warc.plan_records(pages), root, 1 << 20, 4000), "files")
    read = warc.read_chunks(spark, files, root, with_data=False)
    assert files.count() >= 8 and read.rdd.getNumPartitions() == files.count() and tasks_with_files(read) > files.count() // 3
    root = scratch.folder("tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    parts = scratch.stage(token_files.write_tokens(docs, root, tokenizer("word_bpe_49k.json"), 1, 49408), "parts")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    read = token_files.read_tokens(spark, parts, root, 49408)
    assert parts.count() >= 3 and read.rdd.getNumPartitions() == parts.count() and tasks_with_files(read) >= 2

"""Corpus pipeline: toxicity, line dedup, near-duplicate groups, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
`documents`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import decontaminate, jaccard_join, line_dedup, packing, queries, toxicity
from panelspark.llm.common import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score as toxic.  The model learns from the given documents with labels outside fold 1."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take frequent lines out of all documents but the last that has them; texts and n_chars change."""
    return line_dedup.drop_repeated_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 similarity connect, the one with the least doc_id stays; a doc_id is one document."""
    linked = jaccard_join.link_documents(docs)
    drop = linked.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(Scratch(spark).stage(drop, "copies"), "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents with a passage of a benchmark item."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left; one row per piece."""
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_dedup_stage), ("n-gram Jaccard join", jaccard_stage), ("benchmark decontamination", decontamination_stage),
          ("best-fit packing", packing_stage)]
#: Scores, alignments and packing are not SQL; the stages have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

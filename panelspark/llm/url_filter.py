"""URL verdicts: host and path rules first, else the ratio of two character language models.

Each class has a variable-order Markov model over characters, smoothed from order to order by the number of distinct
continuations (Witten-Bell).  All counts are exact: a character and the five before it are one 54-bit key, the table of
these keys holds every order (a shorter context is a sum over longer ones), and it lives in Spark, so it grows with the
corpus and neither the driver nor a task holds it.  Every URL that a rule decides is counted.  The score is the difference
of the log-likelihoods over the number of characters; the threshold is calibrated on those URLs, each scored without its
own counts' fold.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm.common import Scratch, text_buffer

ORDERS = 5
FOLDS = 2
ALPHABET = 256
LEAST_BACKOFF = 0.05
SYMBOL_BITS = 9  # a byte, 256 for the end or 257 for what lies before the start
BLOCK_BITS = 12  # URLs in a block that are scored together: at most 2 ** BLOCK_BITS


@dataclass(frozen=True)
class Rule:
    """`host/path-prefix`, for the host and its subdomains."""
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host between the first :// and / ? # or the end, lower-cased; path up to ? # or the end; empty where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return _lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add rule and rule_verdict: the longest rule that fits, null without one.  The rules are a literal list."""
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.text) if rule is None else rule.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def context_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every character of every URL (bytes, with an end mark): the row, and the key of the character and the `ORDERS`
    before it, the character in the lowest bits, so the low bits of a key are the key of a shorter context."""
    data, offs = text_buffer(column)
    n = np.diff(offs)
    rows = np.repeat(np.arange(len(n)), n + 1)
    chars = np.full(len(rows), 256, np.int64)
    begin = np.concatenate([[0], np.cumsum(n + 1)])
    pos = np.arange(len(rows)) - begin[rows]
    chars[pos < n[rows]] = data
    key = chars.copy()
    for k in range(1, ORDERS + 1):
        back = np.full(len(rows), 257, np.int64)
        have = pos >= k
        back[have] = chars[np.flatnonzero(have) - k]
        key |= back << (SYMBOL_BITS * k)
    return rows, key


def _counts() -> list[str]:
    return [f"n{cls}{fold}" for cls in (0, 1) for fold in range(FOLDS)]


def count_grams(blocks: DataFrame) -> DataFrame:
    """(key, n00, n01, ...): the keys of all URLs, how often each occurs by class and fold in those with a cls.

    A task adds up an Arrow batch before it hands on rows, and Spark adds these before the shuffle.
    """
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows, key = context_grams(b.column("url"))
            part = b.column("part").to_numpy()[rows]
            keys, at = np.unique(key, return_inverse=True)
            n = np.zeros((len(keys), 2 * FOLDS + 1), np.int64)
            np.add.at(n, (at, part), 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(n[:, i])) for i in range(2 * FOLDS))], names=["key", *_counts()])

    # the last column of n is of URLs without a class: they ask for keys and count nothing
    part = F.coalesce(F.col("cls") * FOLDS + F.col("fold"), F.lit(2 * FOLDS)).cast("int").alias("part")
    found = blocks.select("url", part).mapInArrow(run, "key long, " + ", ".join(f"{c} long" for c in _counts()))
    return found.groupBy("key").agg(*[F.sum(c).alias(c) for c in _counts()])


def gram_values(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, v, v0, v1): what a character after its context adds to log p(accepted) - log p(rejected), from all counts and
    from those without fold 0 or 1.

    An order leaves distinct / (distinct + count) of a context's continuations to the shorter one (Witten-Bell), all to it
    where the context is new.  The share is `LEAST_BACKOFF` at least: a character that neither class has seen after a
    context that both know well must cost the same in both, however their sizes differ.  A group or a key of any step has
    as many rows as there are symbols at most.
    """
    spark_key = F.col("key")
    every = grams.select("key", F.explode(F.sequence(F.lit(0), F.lit(ORDERS))).alias("order"), *_counts())
    bits = F.element_at(F.array(*[F.lit((1 << SYMBOL_BITS * (k + 1)) - 1).cast("long") for k in range(ORDERS + 1)]), F.col("order") + 1)
    levels = every.withColumn("key", spark_key.bitwiseAND(bits)).groupBy("order", "key").agg(*[F.sum(c).alias(c) for c in _counts()])
    use = {(cls, skip): [f"n{cls}{f}" for f in range(FOLDS) if f != skip] for cls in (0, 1) for skip in (None, *range(FOLDS))}
    name = {k: f"{k[0]}{'' if k[1] is None else f'_{k[1]}'}" for k in use}
    w = Window.partitionBy("order", F.shiftright("key", SYMBOL_BITS))
    own = {k: sum((F.col(c) for c in cols[1:]), F.col(cols[0])) for k, cols in use.items()}
    levels = scratch.stage(levels.select("order", "key", *[x for k, n in own.items() for x in (
        n.alias(f"n{name[k]}"), F.sum(n).over(w).alias(f"c{name[k]}"), F.count_if(n > 0).over(w).alias(f"t{name[k]}"))]), "levels")
    out = None
    for order in range(ORDERS + 1):
        here = levels.where(F.col("order") == order).drop("order")
        if out is None:
            here = here.withColumns({f"p{x}": F.lit(1.0 / ALPHABET) for x in name.values()})
        else:
            here = here.withColumn("_short", spark_key.bitwiseAND(F.lit((1 << SYMBOL_BITS * order) - 1).cast("long"))).join(out.withColumnRenamed("key", "_short"), "_short")
        p = []
        for x in name.values():
            n, c, t = F.col(f"n{x}"), F.col(f"c{x}"), F.col(f"t{x}")
            back = F.when(c > 0, F.greatest(t / (c + t), F.lit(LEAST_BACKOFF))).otherwise(1.0)
            p.append(((1.0 - back) * F.when(c > 0, n / c).otherwise(0.0) + back * F.col(f"p{x}")).alias(f"p{x}"))
        out = here.select("key", *p)
    log = {skip: F.log(f"p{name[1, skip]}") - F.log(f"p{name[0, skip]}") for skip in (None, *range(FOLDS))}
    return out.select("key", *[x.alias("v" if skip is None else f"v{skip}") for skip, x in log.items()])


def asked_grams(blocks: DataFrame) -> DataFrame:
    """(block, key): the keys of the URLs of a block, once an Arrow batch."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows, key = context_grams(b.column("url"))
            block = b.column("block").to_numpy()[rows]
            order = np.lexsort((key, block))
            key, block = key[order], block[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(block[new]), pa.array(key[new])], names=["block", "key"])

    return blocks.select("block", "url").mapInArrow(run, "block long, key long")


def score_blocks(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """All columns of `blocks` but url and block; score from all counts, and step, the score without the URL's own fold in
    steps of 1/200, where the URL has a class.  A block meets the values of its own keys in one task."""
    keep = [f for f in blocks.schema.fields if f.name not in ("url", "block")]

    def run(urls: pa.Table, own: pa.Table) -> pa.Table:
        key = own.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        rows, asked = context_grams(urls.column("url").combine_chunks())
        at = order[np.searchsorted(key, asked)]
        size = np.bincount(rows, minlength=urls.num_rows)
        score, *without = (np.bincount(rows, own.column(c).to_numpy()[at], minlength=urls.num_rows) / size for c in ("v", *(f"v{f}" for f in range(FOLDS))))
        fold = urls.column("fold").to_numpy()
        step = np.clip(np.round(np.stack(without)[fold, np.arange(len(fold))] * 200), -2000, 2000).astype(np.int64)
        return pa.table([*(urls.column(f.name) for f in keep), pa.array(score), pa.array(step)], names=[*(f.name for f in keep), "score", "step"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", score double, step long"
    asked = asked_grams(blocks).join(values, "key")
    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, schema)


def best_threshold(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy on a histogram of the scores of labelled URLs; 0 without both classes."""
    hist = scored.where("cls IS NOT NULL").groupBy("cls", "step").agg(F.count("*").alias("n")).toPandas()  # at most 4,001 steps
    if hist["cls"].nunique() < 2:
        return 0.0
    table = hist.pivot_table(index="step", columns="cls", values="n", aggfunc="sum", fill_value=0).sort_index()
    rejected = (table[0].cumsum() / table[0].sum()).to_numpy()
    accepted = 1 - (table[1].cumsum() / table[1].sum()).to_numpy()
    steps, good = table.index.to_numpy(), rejected + accepted
    best = int(np.argmax(good))
    upper = steps[best + 1] if best + 1 < len(steps) else steps[best] + 1
    return float((steps[best] + upper) / 2) / 200


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the models, also where a rule decides).

    The models learn from the URLs that rules decide.  A null or empty URL has empty host and path and is judged by the
    models as an empty string; repeated rows are judged and counted each.  Scores equal to the threshold are allowed.
    Without rules or with rules that fit no URL of a class, all other URLs are allowed (score 0 at threshold 0 if both
    models are empty).  Further columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = split_url(F.col("url"))
    ruled = apply_rules(pages.select("page_id", "url").withColumns({"host": host, "path": path}), rules)
    ruled = ruled.withColumns({"url": F.coalesce("url", F.lit("")), "cls": (F.col("rule_verdict") == "allow").cast("int")})
    ruled = ruled.withColumns({"fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"), "block": F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)})
    blocks = scratch.stage(ruled, "blocks")
    grams = scratch.stage(count_grams(blocks), "grams")
    scored = scratch.stage(score_blocks(blocks, gram_values(grams, scratch)), "scored")
    threshold = best_threshold(scored)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

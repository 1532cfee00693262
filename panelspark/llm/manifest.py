"""Merkle manifest of a dataset: one leaf a row, one tree a group (language), one tree over the groups, a proof for every row.

A row's rank in its group is cut into base-8 digits.  `_roll` takes the two lowest digits: it groups them away one after
the other inside a block of 64 consecutive nodes, each time nesting the eight children as structs in a sorted array and
hashing them, so a block ends as one row with its digest.  The digests of the blocks are the nodes of the next tier, and so
on to one node a group, then over the groups.  On the way down `_walk` goes through a block's nested structs with
`transform`, adds the siblings of every level and explodes; the block's own path is added to its row by a union and a
grouping on the block, so no proof needs a join.  The largest row anywhere is a block of 64 nodes, whatever the group.

All of it is DataFrame functions.  Digests are lower-case hex text.  The tables between tiers are staged, so a lost executor
costs a re-read.

Defined cases: a null field hashes as `-`; rows with a null group form the first tree; rows are ordered by doc_id (null
first), then by leaf; repeated rows are leaves each; other columns of the input are ignored; an empty table has no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm.common import Scratch

DIGIT_BITS, DIGITS = 3, 2
BLOCK_BITS = DIGIT_BITS * DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """`-` for null, otherwise the byte count, a colon and the value as text; no two rows share their concatenation."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in fields]), 256)


def _ranked(rows: DataFrame, scratch: Scratch, order: list[str]) -> DataFrame:
    """Add r (0-based rank in grp by `order`) and n (rows of the grp).

    Rows are dealt to ranges of (grp, order, uid), so a group of any size spreads and equal rows do too; a range counts its
    rows by group, and the counts before it are its offset.
    """
    dealt = scratch.stage(rows.repartitionByRange("grp", *order, "uid").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (dealt.groupBy("grp", "part").agg(F.count("*").alias("m"))
              .select("grp", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("at"), F.sum("m").over(Window.partitionBy("grp")).alias("n")))
    own = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order, "uid"))
    return dealt.withColumn("own", own).join(counts, ["grp", "part"]).withColumn("r", F.col("at") + F.col("own") - 1).drop("part", "own", "at", "uid")


def _hashed(level: int) -> Column:
    """Whether the nodes of this level are more than one, so that they are hashed together."""
    return F.col("n") > F.lit(1 << (DIGIT_BITS * level)) if level < 21 else F.lit(False)


def _roll(nodes: DataFrame, tier: int) -> DataFrame:
    """(grp, n, r, digest, body) -> one row a block: (grp, n, r = block, digest, kids), kids nested DIGITS deep."""
    digits = [F.shiftright("r", DIGIT_BITS * k).bitwiseAND(F.lit(7)).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    rows = nodes.select("grp", "n", F.shiftright("r", BLOCK_BITS).alias("block"), *digits, "digest", "body").repartition("grp", "block")
    for k in range(DIGITS):
        rest = [f"d{j}" for j in range(k + 1, DIGITS)]
        rows = rows.groupBy("grp", "n", "block", *rest).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "digest", "body"))).alias("body"))
        joined = F.sha2(F.array_join(F.col("body.digest"), ""), 256)
        rows = rows.withColumn("digest", F.when(_hashed(DIGITS * tier + k), joined).otherwise(F.col("body")[0]["digest"]))
    return rows.select("grp", "n", F.col("block").alias("r"), "digest", F.col("body").alias("kids"))


def _step(kids: Column, at: Column, level: int) -> Column:
    """The siblings of one child as a path of one step; no step where the level is not hashed."""
    digests = F.transform(kids, lambda k: k["digest"])
    step = F.struct(F.array_join(F.slice(digests, F.lit(1), at), "").alias("left"), F.array_join(F.slice(digests, at + 2, F.lit(7)), "").alias("right"))
    return F.when(_hashed(level), F.array(step)).otherwise(F.array().cast(PATH))


def _walk(blocks: DataFrame, tier: int, carried: list[str]) -> DataFrame:
    """(grp, r, n, kids, path, carried ...) of blocks -> (grp, r, digest, body, path, carried ...) of their nodes.

    One transform and explode a level, so a row holds no more than the eight children it came from.
    """
    nodes = blocks.withColumnRenamed("kids", "body").withColumn("digest", F.lit(""))
    for k in range(DIGITS - 1, -1, -1):
        child = F.explode(F.transform("body", lambda kid, i: F.struct(kid["d"].alias("d"), kid["digest"].alias("digest"), kid["body"].alias("body"), _step(F.col("body"), i, DIGITS * tier + k).alias("step"))))
        nodes = nodes.select("grp", "r", "n", "path", *carried, child.alias("kid"))
        nodes = nodes.select("grp", (F.col("r") * 8 + F.col("kid.d")).alias("r"), "n", F.concat("kid.step", "path").alias("path"), *carried, "kid.digest", "kid.body")
    return nodes.drop("n")


def _climb(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Blocks of every tier, from the leaves to one block a group; each staged."""
    tiers, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = scratch.stage(_roll(nodes, len(tiers)), f"{name}-{len(tiers)}")
        tiers.append(blocks)
        most = -(-most // (1 << BLOCK_BITS))
        if most <= 1:
            return tiers
        nodes = blocks.select("grp", "n", "r", "digest", F.lit(None).cast("int").alias("body"))


def _descend(tiers: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """Give every node of the lowest tier its path.  `above` has (grp, r = 0, path, carried ...) for the one top block a group."""
    for tier in range(len(tiers) - 1, -1, -1):
        blocks = tiers[tier].select("grp", "r", "n", "kids")
        met = blocks.unionByName(above, allowMissingColumns=True).groupBy("grp", "r").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", *carried)])
        above = _walk(met, tier, carried)
        if tier:
            above = above.drop("digest", "body")
    return above


def build(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None,
          where: Column | None = None) -> DataFrame:
    """(key, leaf, other_leaf, subroot, root, path) of every row; path lists (left, right) sibling digests from leaf to root.

    `changed` replaces fields for other_leaf, the leaf of an altered copy of the row, where the condition `where` holds.
    """
    scratch = Scratch(docs.sparkSession)
    value = {c: F.col(c) for c in fields}
    other = F.when(where, leaf(list((value | changed).values()))) if changed else F.lit(None).cast("string")
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # "" for null sorts before every "=value"
    leaves = scratch.stage(docs.select(F.col(key), g.alias("grp"), leaf(list(value.values())).alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("uid")), "leaves")
    nodes = _ranked(leaves, scratch, [key, "digest"]).select("grp", "n", "r", "digest", F.struct(key, "other").alias("body"))
    tiers = _climb(scratch.stage(nodes, "nodes"), scratch, "group")
    subroots = tiers[-1].select("grp", F.col("digest").alias("subroot"), F.lit(0).alias("uid"))
    tops = _ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "subroot", "uid"), scratch, ["name"])
    upper = _climb(scratch.stage(tops.select("grp", "n", "r", F.col("subroot").alias("digest"), F.struct("name").alias("body")), "subroots"), scratch, "root")
    start = upper[-1].select("grp", "r", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    groups = _descend(upper, start, ["root"]).select(F.col("body.name").alias("grp"), F.lit(0).cast("long").alias("r"), "path", F.col("digest").alias("subroot"), "root")
    out = _descend(tiers, groups, ["subroot", "root"])
    return out.select(F.col(f"body.{key}").alias(key), F.col("digest").alias("leaf"), F.col("body.other").alias("other_leaf"), "subroot", "root", "path")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def verify_tampered(docs: DataFrame) -> DataFrame:
    """Digests of every document, and whether its proof still holds where documents with an id hash divisible by 3 were
    lower-cased: their leaf is recomputed, all siblings stay."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = build(docs, changed={"text": F.translate("text", UPPER, LOWER)}, where=tampered)
    rows = rows.withColumn("folded_root", fold(F.coalesce("other_leaf", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

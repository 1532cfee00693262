"""Weights, turnover, drift, composition and closed-form allocations (all Catalyst-visible)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.scalar import col, ratio
from panelspark.operators.panel import weight_changes


# ---------------------------------------------------------------- allocations
def static_mix(decisions: DataFrame, mix: dict[str, float]) -> DataFrame:
    """The same literal weights at every decision."""
    legs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(float(w)).alias("weight")) for k, w in mix.items()])
    return decisions.select("*", F.inline(legs))


def equal_weight(df: DataFrame, group: list[str]) -> DataFrame:
    n = df.groupBy(*group).agg(F.count("*").alias("_n"))
    return df.join(n, group).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def inverse_vol(df: DataFrame, group: list[str], sigma: str, fill: Column | None = None) -> DataFrame:
    """Weights proportional to 1 / sigma.  ``fill`` replaces a zero volatility (a group median).

    The total is one map-side combined row per group joined back, not a window over the group.
    """
    s = F.col(sigma) if fill is None else F.coalesce(F.nullif(F.col(sigma), F.lit(0.0)), fill)
    d = df.withColumn("_inv", 1.0 / F.greatest(s, F.lit(1e-8)))
    total = d.groupBy(*group).agg(F.sum("_inv").alias("_t"))
    return d.join(total, group).withColumn("weight", F.col("_inv") / F.col("_t")).drop("_inv", "_t")


def trend_filtered(df: DataFrame, group: list[str], signal: str) -> DataFrame:
    """Keep the weight of names with a positive signal; the anchor itself when there is none."""
    pos = F.when(F.col(signal) > 0, F.col("weight")).otherwise(F.lit(0.0))
    d = df.join(df.groupBy(*group).agg(F.sum(pos).alias("_t")), group)
    return d.withColumn("weight", F.when(F.col("_t") > 0, pos / F.nullif("_t", F.lit(0.0))).otherwise(F.col("weight"))).drop("_t")


def scaled_with_cash(core: DataFrame, keys: list[str], scale: str, cash: str) -> DataFrame:
    """Core weights times a scale, the rest in the cash key (also when the core holds it)."""
    legs = core.select(*keys, "key", (F.col("weight") * F.col(scale)).alias("weight"))
    rest = core.groupBy(*keys).agg(F.greatest(F.lit(0.0), 1.0 - F.first(scale)).alias("weight")).select(*keys, F.lit(cash).alias("key"), "weight")
    return legs.unionByName(rest).groupBy(*keys, "key").agg(F.sum("weight").alias("weight"))


def sleeve_caps(df: DataFrame, group: list[str], single: float = 0.15, total: float = 0.25) -> DataFrame:
    """Clip each sleeve weight, then scale the sleeve down to its total."""
    d = df.withColumn("weight", F.least(F.greatest(F.col("weight"), F.lit(0.0)), F.lit(single)))
    d = d.join(d.groupBy(*group).agg(F.sum("weight").alias("_s")), group)
    return d.withColumn("weight", F.when(F.col("_s") > total + 1e-12, F.col("weight") * total / F.col("_s")).otherwise(F.col("weight"))).drop("_s")


def fund_by_core_trim(core: DataFrame, sleeve: DataFrame, keys: list[str]) -> DataFrame:
    """Pay for a sleeve by scaling the core to 1 - sum(sleeve)."""
    s = sleeve.groupBy(*keys).agg(F.sum("weight").alias("_s"))
    trimmed = core.join(s, keys, "left").select(*keys, "key", (F.col("weight") * (1.0 - F.coalesce("_s", F.lit(0.0)))).alias("weight"))
    return trimmed.unionByName(sleeve.select(*keys, "key", "weight")).groupBy(*keys, "key").agg(F.sum("weight").alias("weight"))


def pick_top(df: DataFrame, group: list[str], score: str, n: int, flag: str, total: float = 0.25, single: float = 0.15) -> DataFrame:
    """Top n by score where flagged names stop once their provisional budget is used.

    The budget ceil(total / single) is a running count of flagged names.
    """
    import math
    budget = math.ceil(total / single - 1e-12)
    w = Window.partitionBy(*group).orderBy(F.desc(score), "key")
    # no pick can lie beyond the n-th of its own kind, so a map-side top-n shrinks every group first
    own = Window.partitionBy(*group, flag).orderBy(F.desc(score), "key")
    d = df.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= max(n, budget)).drop("_r")
    d = d.withColumn("_f", F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.where(~F.col(flag) | (F.col("_f") <= budget)).drop("_f")
    return d.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def capped(df: DataFrame, group: list[str], flag: str, cap_flag: float = 0.15, cap_other: float = 0.40, total: float = 0.25,
           passes: int = 20) -> DataFrame:
    """Caps with room-proportional redistribution.

    After the first clip a pass moves every weight of one side (flagged or not) by the same affine map, which follows from
    the group's two totals and two counts.  So one aggregate per group, combined map-side, is enough: the passes run on the
    group's row, and names join their side's map.  No name waits for the others of its decision.
    """
    d = df.withColumn("_w", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    d = d.join(d.groupBy(*group).agg(F.sum("_w").alias("_all")), group)
    cap = F.when(F.col(flag), F.lit(cap_flag)).otherwise(F.lit(cap_other))
    d = d.withColumn("_w", F.least(F.coalesce(ratio("_w", "_all"), F.lit(0.0)), cap)).drop("_all")
    on = F.coalesce(F.col(flag), F.lit(False))
    g = d.groupBy(*group).agg(F.sum(F.when(on, F.col("_w")).otherwise(0.0)).alias("f"), F.sum(F.when(on, 0.0).otherwise(F.col("_w"))).alias("o"),
                              F.count_if(on).cast("double").alias("nf"), F.count_if(~on).cast("double").alias("no"))
    state = F.struct(F.col("f").alias("f"), F.col("o").alias("o"), F.lit(1.0).alias("af"), F.lit(0.0).alias("bf"), F.lit(1.0).alias("ao"), F.lit(0.0).alias("bo"))

    def one(s, _):
        # weights of a side are a * w + b; a share of room beyond 1 puts every weight at or over its cap, where the next clip leaves it
        over = (s["af"] < 0) | (s["ao"] < 0)
        f, o = F.when(over, F.col("nf") * cap_flag).otherwise(s["f"]), F.when(over, F.col("no") * cap_other).otherwise(s["o"])
        af, bf = F.when(over, 0.0).otherwise(s["af"]), F.when(over, F.lit(cap_flag)).otherwise(s["bf"])
        ao, bo = F.when(over, 0.0).otherwise(s["ao"]), F.when(over, F.lit(cap_other)).otherwise(s["bo"])
        k = F.when(f > total, F.lit(total) / f).otherwise(F.lit(1.0))
        rem = 1.0 - k * f - o
        room_f, room_o = F.col("nf") * cap_flag - k * f, F.col("no") * cap_other - o
        room = F.greatest(room_f, F.lit(0.0)) + F.greatest(room_o, F.lit(0.0))
        share = F.when((F.abs(rem) >= 1e-10) & (room > 1e-12), rem / room).otherwise(0.0)
        return F.struct((k * f + share * room_f).alias("f"), (o + share * room_o).alias("o"), (af * k * (1.0 - share)).alias("af"), (bf * k * (1.0 - share) + share * cap_flag).alias("bf"),
                        (ao * (1.0 - share)).alias("ao"), (bo * (1.0 - share) + share * cap_other).alias("bo"))

    g = g.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(passes)), state, one)).select(*group, "_s")
    w = F.when(on, F.col("_s.af") * F.col("_w") + F.col("_s.bf")).otherwise(F.col("_s.ao") * F.col("_w") + F.col("_s.bo"))
    return d.join(g, group).withColumn("weight", ratio(w, F.col("_s.f") + F.col("_s.o"))).drop("_w", "_s")


def sleeve_to_members(sleeve_w: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Spread a sleeve's weight equally over its members at each decision."""
    n = members.groupBy(*keys, "sleeve").agg(F.count("*").alias("_n"))
    return (members.join(n, [*keys, "sleeve"]).join(sleeve_w.select(*keys, "sleeve", F.col("weight").alias("_w")), [*keys, "sleeve"])
            .select(*keys, "key", (F.col("_w") / F.col("_n")).alias("weight")))


def distance(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """L2 and half-L1 distance of two weight tables."""
    d = a.select(*keys, "key", F.col("weight").alias("x")).unionByName(b.select(*keys, "key", F.col("weight").alias("y")), allowMissingColumns=True)
    d = d.groupBy(*keys, "key").agg((F.coalesce(F.sum("x"), F.lit(0.0)) - F.coalesce(F.sum("y"), F.lit(0.0))).alias("d"))
    return d.groupBy(*keys).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("l2"), (0.5 * F.sum(F.abs("d"))).alias("half_l1"))


# ---------------------------------------------------------------- accounting
def drifted(weights: DataFrame, returns: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Weights of each rebalance grown to the next one, renormalised.

    Compounds every period in between through a cumulative log-wealth column, so a skipped
    rebalance needs no loop: two equi joins on (key, period).
    """
    cum = returns.select("key", F.col(idx).alias("_i"), F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(
        Window.partitionBy("key").orderBy(idx)).alias("_c"))
    reb = weights.select(*keys, idx).distinct()
    reb = reb.withColumn("_next", F.lead(idx).over(Window.partitionBy(*keys).orderBy(idx))).where("_next is not null")
    d = weights.select(*keys, idx, "key", "weight").join(reb, [*keys, idx])
    d = d.join(cum.select("key", F.col("_i").alias(idx), F.col("_c").alias("_c0")), ["key", idx], "left")
    d = d.join(cum.select("key", F.col("_i").alias("_next"), F.col("_c").alias("_c1")), ["key", "_next"], "left")
    d = d.withColumn("_g", F.col("weight") * F.exp(F.coalesce("_c1", "_c0", F.lit(0.0)) - F.coalesce("_c0", F.lit(0.0))))
    total = d.groupBy(*keys, "_next").agg(F.sum("_g").alias("_t"))
    return d.join(total, [*keys, "_next"]).select(*keys, F.col("_next").alias(idx), "key", ratio("_g", "_t").alias("weight"))


def turnover(weights: DataFrame, keys: list[str], idx: str, first: str = "half", cost_bps: float = 5.0,
             previous: DataFrame | None = None) -> DataFrame:
    """Half the absolute weight change per rebalance, and its cost.

    first: 'zero' or 'half' (building the book costs half its gross).  previous: drifted
    holdings at the same rebalance; by default the targets of the one before.
    """
    if previous is None:
        d = weight_changes(weights, keys, idx)
    else:
        d = weights.select(*keys, idx, "key", F.col("weight").alias("dw"), F.lit(0).alias("_p")).unionByName(
            previous.select(*keys, idx, "key", (-F.col("weight")).alias("dw"), F.lit(1).alias("_p")))
        d = d.groupBy(*keys, idx, "key").agg(F.sum("dw").alias("dw"), F.max("_p").alias("_p"))
    t = d.groupBy(*keys, idx).agg((0.5 * F.sum(F.abs("dw"))).alias("turnover"), *(
        [F.first("first").alias("first")] if previous is None else [(F.max("_p") == 0).alias("first")]))
    if first == "zero":
        t = t.withColumn("turnover", F.when(F.col("first"), F.lit(0.0)).otherwise(F.col("turnover")))
    return t.withColumn("cost", F.col("turnover") * cost_bps / 10000.0)


def book_returns(weights: DataFrame, returns: DataFrame, keys: list[str], idx: str, missing: str = "null", lead: int = 1) -> DataFrame:
    """Sum of weight x next-period return.  missing: 'error' | 'null' | 'skip' for a held name without a return."""
    r = returns.select("key", (F.col(idx) - lead).alias(idx), "ret")
    d = weights.where("weight <> 0").join(r, ["key", idx], "left")
    gaps = F.count_if(F.col("ret").isNull())
    total = F.sum(F.col("weight") * F.col("ret"))
    out = (F.when(gaps == 0, total) if missing == "null" else total if missing == "skip" else
           F.when(gaps == 0, total).otherwise(F.raise_error(F.lit("missing return of a held name")).cast("double")))
    return d.groupBy(*keys, idx).agg(out.alias("gross"), F.count("*").alias("n_names"))


def concentration(weights: DataFrame, keys: list[str], period: str, held: float = 0.001) -> DataFrame:
    """HHI, effective number and names held, averaged over rebalances."""
    per = weights.groupBy(*keys, period).agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.count_if(F.col("weight") > held).alias("held"),
                                             F.max("weight").alias("largest"))
    return per.groupBy(*keys).agg(F.avg("hhi").alias("hhi_mean"), F.avg(1.0 / F.col("hhi")).alias("eff_n_mean"), F.avg("held").alias("names_held_mean"),
                                  F.avg("largest").alias("largest_mean"), F.count("*").alias("rebalances"))


def average_holdings(weights: DataFrame, keys: list[str], period: str, name: str = "key") -> DataFrame:
    """Mean weight per name over the rebalances of its strategy, ranked."""
    n = weights.select(*keys, period).distinct().groupBy(*keys).agg(F.count("*").alias("_n"))
    avg = weights.groupBy(*keys, name).agg(F.sum("weight").alias("_w")).join(n, keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("avg_weight"), name)
    return avg.select(*keys, name, (F.col("_w") / F.col("_n")).alias("avg_weight")).withColumn("rank", F.row_number().over(w))


def with_other(weights: DataFrame, keys: list[str], period: str, top: int, pinned: list[str] = ()) -> DataFrame:
    """Top names by average weight plus pinned ones; the rest is summed as 'Other'."""
    avg = average_holdings(weights, keys, period)
    keep = (F.col("rank") <= top) & (F.col("avg_weight") > 0) | F.col("key").isin(*pinned) if pinned else (F.col("rank") <= top) & (F.col("avg_weight") > 0)
    d = weights.join(avg.where(keep).select(*keys, "key", F.lit(True).alias("_own")), [*keys, "key"], "left")
    label = F.when(F.col("_own"), F.col("key")).otherwise("Other")
    return d.groupBy(*keys, period, label.alias("key")).agg(F.sum("weight").alias("weight"))


def tag_shares(weights: DataFrame, universe: DataFrame, keys: list[str], period: str, tags: list[str]) -> DataFrame:
    """Average share per tag over rebalances; not computable when a holding is unknown."""
    d = weights.join(universe.select("key", *tags, F.lit(True).alias("_known")), "key", "left")
    n = F.count_distinct(period)
    unknown = F.count_if(F.col("_known").isNull())
    share = {t: F.sum(F.when(F.col(t), F.col("weight")).otherwise(0.0)) / n for t in tags}
    out = d.groupBy(*keys).agg((unknown == 0).alias("computable"), *[F.when(unknown == 0, s).alias(f"{t}_share") for t, s in share.items()],
                               F.array_join(F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), F.col("key")))), ", ").alias("_bad"))
    total = sum((F.col(f"{t}_share") for t in tags[1:]), F.col(f"{tags[0]}_share"))
    return out.withColumn("tagged_share", total).withColumn(
        "reason", F.when(F.col("computable"), "").otherwise(F.concat(F.lit("no constituent weights for: "), F.col("_bad")))).drop("_bad")


def _head(values: Column, k) -> Column:
    """Sum of the first k values of a short array."""
    return F.aggregate(F.slice(values, F.lit(1), k), F.lit(0.0), lambda a, x: a + x)


def _over(values: Column, start: Column, test) -> Column:
    """How many of the values after the first `start` pass the test; the values descend, so these come next."""
    return F.size(F.filter(values, lambda x, i: (i >= start) & test(x)))


def capped_frozen(df: DataFrame, group: list[str], flag: str, name_cap: float = 0.20, group_cap: float = 0.30, binding: str | None = None, tol: float = 1e-10) -> DataFrame:
    """Group cap, then name cap; capped names freeze and the excess goes pro rata to the others, until nothing is over.

    Names that are not capped keep their proportions, so a decision's answer is one scale a side and a number of capped names,
    the largest ones.  No more than 1 / name_cap names can be at the cap, so the largest few of each side, kept map-side, and
    the two totals decide everything: prefix sums of the few give the scale that any number of capped names leaves.  The scale
    rises until no further name is over or the flagged side is over its cap; then that side is scaled to the cap and frozen,
    and the other side's scale follows from the smallest number of capped names whose next name fits.  Names join the
    decision's row.  binding: name of a column to add, 'name cap' or 'group cap' where that cap holds the weight down.

    Weights must not be negative and must sum to 1; caps that leave too little room raise.
    """
    most = int(1.0 / name_cap + 1e-9) + 1
    on = F.coalesce(F.col(flag), F.lit(False))
    d = df.withColumn("_w", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).withColumn("_on", on)
    few = d.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_on").orderBy(F.desc("_w")))).where(F.col("_r") <= most)
    side = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("_w"))), asc=False)
    few = few.groupBy(*group).agg(side(F.col("_on")).alias("lf"), side(~F.col("_on")).alias("lo"))
    part = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    total = d.groupBy(*group).agg(part(F.col("_on"), F.col("_w")).alias("sf"), part(~F.col("_on"), F.col("_w")).alias("so"), F.min("weight").alias("low"),
                                  F.count_if("_on").alias("nf"), F.count_if(~F.col("_on")).alias("no"), F.count_if(F.col("_on") & (F.col("_w") > 0)).alias("pf"), F.count_if(~F.col("_on") & (F.col("_w") > 0)).alias("po"))
    g = total.join(few, group)
    lf, lo, cap = F.col("lf"), F.col("lo"), F.lit(name_cap)
    fits = F.least(F.lit(group_cap), F.col("nf") * name_cap) + F.col("no") * name_cap >= 1.0 - 1e-12
    bad = F.when((F.col("low") < -tol) | (F.abs(F.col("sf") + F.col("so") - 1.0) > 1e-8), "weights must be long-only and sum to 1").when(~fits, "infeasible caps")

    # Names under no cap hold w * t + u; u is only used where all of them have weight 0, which then share equally.
    def one(s, _):
        free_f = F.col("sf") - _head(lf, s["kf"])
        held = s["kf"] * cap + free_f * s["t"] + (F.col("nf") - s["kf"]) * s["u"]
        bind = held > group_cap + tol
        over = lambda x: x * s["t"] + s["u"] > name_cap + tol
        kf, ko = s["kf"] + _over(lf, s["kf"], over), s["ko"] + _over(lo, s["ko"], over)
        room = 1.0 - (kf + ko) * cap
        none = (F.col("pf") <= kf) & (F.col("po") <= ko)
        t = F.when(none, s["t"]).otherwise(F.try_divide(room, F.col("sf") - _head(lf, kf) + F.col("so") - _head(lo, ko)))
        u = F.when(none, F.coalesce(F.try_divide(room, F.col("nf") + F.col("no") - kf - ko), F.lit(0.0))).otherwise(0.0)
        same = (kf == s["kf"]) & (ko == s["ko"])
        stop = s["done"] | bind | same
        keep = lambda new, old: F.when(stop, s[old]).otherwise(new).alias(old)
        return F.struct(keep(t, "t"), keep(u, "u"), keep(kf, "kf"), keep(ko, "ko"), F.when(s["done"], s["held"]).otherwise(held).alias("held"),
                        F.when(s["done"], s["bind"]).otherwise(bind).alias("bind"), stop.alias("done"))

    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("u"), F.lit(0).alias("kf"), F.lit(0).alias("ko"), F.lit(0.0).alias("held"), F.lit(False).alias("bind"), F.lit(False).alias("done"))
    g = g.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(2 * most + 2)), start, one))  # every step but the last caps a name
    s = F.col("s")
    scale = F.when(s["bind"], F.lit(group_cap) / s["held"]).otherwise(F.lit(1.0))
    g = g.withColumns({"tf": s["t"] * scale, "uf": s["u"] * scale, "cf": cap * scale})
    g = g.withColumn("jf", F.when(s["bind"], s["kf"] + _over(lf, s["kf"], lambda x: x * F.col("tf") + F.col("uf") > name_cap + tol)).otherwise(s["kf"]))
    g = g.withColumn("rest", 1.0 - (s["kf"] * F.col("cf") + (F.col("jf") - s["kf"]) * cap + (F.col("sf") - _head(lf, F.col("jf"))) * F.col("tf") + (F.col("nf") - F.col("jf")) * F.col("uf")))

    def other(k):
        """(k, scale, equal share) of the other side with k names at the cap."""
        left, none = F.col("rest") - k * cap, F.col("po") <= k
        return F.struct(k.alias("k"), F.when(none, F.lit(0.0)).otherwise(F.try_divide(left, F.col("so") - _head(lo, k))).alias("t"),
                        F.when(none, F.coalesce(F.try_divide(left, F.col("no") - k), F.lit(0.0))).otherwise(F.lit(0.0)).alias("u"))
    tries = F.transform(F.sequence(s["ko"], F.greatest(F.size(lo), s["ko"])), other)
    tries = F.filter(tries, lambda x: F.coalesce(F.get(lo, x["k"]), F.lit(0.0)) * x["t"] + x["u"] <= name_cap + tol)
    g = g.withColumn("o", F.when(s["bind"], F.get(tries, F.lit(0))).otherwise(F.struct(s["ko"].alias("k"), s["t"].alias("t"), s["u"].alias("u"))))
    edge = lambda values, k: F.when(k > 0, F.get(values, k - 1))
    g = g.select(*group, bad.alias("bad"), s["bind"].alias("bind"), "tf", "uf", "cf", edge(lf, s["kf"]).alias("f1"), edge(lf, F.col("jf")).alias("f2"), F.col("o.t").alias("to"), F.col("o.u").alias("uo"), edge(lo, F.col("o.k")).alias("o1"))
    d = d.join(g.select(*group, F.struct("bad", "bind", "tf", "uf", "cf", "f1", "f2", "to", "uo", "o1").alias("_s")), group)
    at = lambda c: F.coalesce(F.col("_w") >= F.col(c), F.lit(False))
    own = F.when(F.col("_on"), F.when(at("_s.f1"), F.col("_s.cf")).when(at("_s.f2"), cap).otherwise(F.col("_w") * F.col("_s.tf") + F.col("_s.uf")))
    own = own.when(at("_s.o1"), cap).otherwise(F.col("_w") * F.col("_s.to") + F.col("_s.uo"))
    out = d.withColumn("weight", F.when(F.col("_s.bad").isNull(), own).otherwise(F.raise_error(F.col("_s.bad")).cast("double")))
    if binding:
        out = out.withColumn(binding, F.when(F.when(F.col("_on"), at("_s.f2")).otherwise(at("_s.o1")), "name cap").when(F.col("_on") & F.col("_s.bind"), "group cap"))
    return out.drop("_w", "_on", "_s")


def cap_report(before: DataFrame, after: DataFrame, group: list[str], flag: str, binding: str) -> DataFrame:
    """Per decision: whether the group cap binds, the names at the name cap, and the flagged share and largest weight before and after.

    At most 1 / name_cap names are listed.
    """
    on = lambda: F.coalesce(F.sum(F.when(F.col(flag), F.col("weight"))), F.lit(0.0))
    pre = before.groupBy(*group).agg(on().alias("share_pre"), F.max("weight").alias("largest_pre"))
    post = after.groupBy(*group).agg(F.coalesce(F.max(F.col(binding) == "group cap"), F.lit(False)).alias("group_binds"), on().alias("share_post"), F.max("weight").alias("largest_post"),
                                     F.array_join(F.sort_array(F.collect_list(F.when(F.col(binding) == "name cap", F.col("key")))), ",").alias("names_bound"))
    return pre.join(post, group)

"""Order statistics, tails and drawdowns of expanding or sliding frames, without a frame's values in any row.

``percentile`` over an unbounded frame and an array of the window in every row both cost rows x window.  Here the values of a
series get dense ranks once, and a question ("the k-th smallest of the rows my frame sees", "how many of them are below x")
walks down the digits of the rank: at each of the few levels one window counts the values of the 16 children of the node the
question stands in, by time, and the question steps into the child that holds its answer.  Rows and questions move down
together, so a level is one sort of rows plus questions, and the whole is n log n for any series length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.scalar import ratio
from panelspark.sources.stage import stage

UNB = Window.unboundedPreceding
DIGIT = 4
WAYS = 1 << DIGIT
#: Series of at most SHORT rows use the engine's percentile of a frame, windows of at most LAGS rows lag columns; the results are the same.
SHORT, LAGS = 256, 64


def _descend(values: DataFrame, asked: DataFrame, keys: list[str], levels: int, lo: int | None, hi: int, sums: bool) -> DataFrame:
    """values: (keys, _t, _v, _rank).  asked: (keys, _t, _id, _k, _r): the _k-th smallest (from 0) of the frame [lo, hi] around
    _t, or with _r the values of rank below _r.  Returns asked with _node (the answer's rank), _n and _sum (values before it)
    and _here, _here_sum (values equal to it)."""
    q = asked.withColumns({"_node": F.lit(0), "_n": F.lit(0).cast("long"), "_sum": F.lit(0.0), "_here": F.lit(0).cast("long"), "_here_sum": F.lit(0.0)})
    own = [*keys, "_t", "_id", "_k", "_r", "_node", "_n", "_sum"]
    for level in range(levels - 1, -1, -1):
        down = DIGIT * level
        rows = values.select(*keys, "_t", F.shiftright("_rank", down + DIGIT).alias("_node"), F.shiftright("_rank", down).bitwiseAND(F.lit(WAYS - 1)).alias("_c"), "_v")
        both = q.select(*own).unionByName(rows, allowMissingColumns=True)
        w = Window.partitionBy(*keys, "_node").orderBy("_t")
        upto = {f"_c{j}": F.count(F.when(F.col("_c") <= j, 1)) for j in range(WAYS)}
        if sums:
            upto |= {f"_s{j}": F.sum(F.when(F.col("_c") <= j, F.col("_v"))) for j in range(WAYS)}

        def framed(agg):
            # a sliding frame as the difference of two running ones: a sliding window would add up its rows anew for each row
            run = F.coalesce(agg.over(w.rangeBetween(UNB, hi)), F.lit(0))
            return run if lo is None else run - F.coalesce(agg.over(w.rangeBetween(UNB, lo - 1)), F.lit(0))
        q = both.select(*own, *[framed(x).alias(n) for n, x in upto.items()]).where(F.col("_id").isNotNull())
        digit = F.shiftright("_r", down).bitwiseAND(F.lit(WAYS - 1))
        c, total = [F.col(f"_c{j}") for j in range(WAYS)], [F.col(f"_s{j}") for j in range(WAYS)] if sums else [F.lit(0.0)] * WAYS
        left = [F.when(F.col("_r").isNull(), c[j] <= F.col("_k")).otherwise(F.lit(j) < digit) for j in range(WAYS)]  # children wholly before the answer
        q = q.withColumn("_j", sum((x.cast("int") for x in left[1:]), left[0].cast("int")))
        before = F.get(F.array(F.lit(0).cast("long"), *c), F.col("_j"))
        before_sum = F.get(F.array(F.lit(0.0), *total), F.col("_j"))
        q = q.withColumns({"_bn": before, "_bs": before_sum, "_un": F.coalesce(F.get(F.array(*c), F.col("_j")), before), "_us": F.coalesce(F.get(F.array(*total), F.col("_j")), before_sum)})
        q = q.select(*keys, "_t", "_id", (F.col("_k") - F.col("_bn")).alias("_k"), "_r", (F.col("_node") * WAYS + F.col("_j")).alias("_node"), (F.col("_n") + F.col("_bn")).alias("_n"),
                     (F.col("_sum") + F.col("_bs")).alias("_sum"), (F.col("_un") - F.col("_bn")).alias("_here"), (F.col("_us") - F.col("_bs")).alias("_here_sum"))
    return q


def _numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with _t, their number in the series; staged, since several branches read them."""
    return stage(df.withColumn("_t", F.row_number().over(Window.partitionBy(*keys).orderBy(order))))


def _ranked(d: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, int]:
    """(keys, _t, _v, _rank): values with dense ranks, staged; and the number of levels."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_v")) - 1
    values = stage(d.where(F.col(value).isNotNull()).select(*keys, "_t", F.col(value).cast("double").alias("_v")).withColumn("_rank", rank))
    top, levels = (values.agg(F.max("_rank")).first()[0] or 0) + 1, 1  # one more than any rank: a bound above all values
    while top >> (DIGIT * levels):
        levels += 1
    return values, levels


def _seen(keys: list[str], value: str, rows: int | None, prior: bool) -> Column:
    """How many values the frame of a row has, from running counts."""
    w = Window.partitionBy(*keys).orderBy("_t")
    upto = F.count(value).over(w.rowsBetween(UNB, -1 if prior else 0))
    return upto if rows is None else upto - F.coalesce(F.count(value).over(w.rowsBetween(UNB, -rows - (1 if prior else 0))), F.lit(0))


def _quantile_asked(d: DataFrame, keys: list[str], quantiles: list[float], min_periods: int) -> DataFrame:
    """Questions 2k and 2k + 1: the values below and above the k-th quantile's place in a frame of _c values."""
    at = [(F.col("_c") - 1) * F.lit(float(q)) for q in quantiles]
    ask = lambda i, k: F.struct(F.lit(i).alias("_id"), k.cast("long").alias("_k"))
    both = F.concat(*[F.when(F.ceil(x) > F.floor(x), F.array(ask(2 * i, F.floor(x)), ask(2 * i + 1, F.ceil(x)))).otherwise(F.array(ask(2 * i, F.floor(x)))) for i, x in enumerate(at)])
    return d.where(F.col("_c") >= max(1, min_periods)).select(*keys, "_t", F.inline(both)).withColumn("_r", F.lit(None).cast("int"))


def _below_asked(d: DataFrame, values: DataFrame, keys: list[str], bound: str, number: int) -> DataFrame:
    """A question for the count below a row's own bound.  The bound's rank is the number of distinct values below it: bounds
    are sorted in among the values."""
    marks = d.where(F.col(bound).isNotNull()).select(*keys, "_t", F.col(bound).cast("double").alias("_v"), F.lit(1).alias("_mark"))
    mixed = values.select(*keys, "_v", "_rank", F.lit(0).alias("_mark")).unionByName(marks, allowMissingColumns=True)
    upto = F.max("_rank").over(Window.partitionBy(*keys).orderBy("_v").rangeBetween(UNB, Window.currentRow))
    equal = F.max("_rank").over(Window.partitionBy(*keys, "_v"))
    asked = mixed.withColumn("_r", F.coalesce(equal, upto + 1, F.lit(0))).where("_mark = 1")
    return asked.select(*keys, "_t", F.lit(number).alias("_id"), F.lit(None).cast("long").alias("_k"), "_r")


def _found_quantile(i: int, q: float) -> dict[str, Column]:
    """The two values of a quantile's question, as aggregates over a row's answers."""
    pick = lambda n, c: F.max(F.when(F.col("_id") == n, F.col(c)))
    return {f"_a{i}": pick(2 * i, "_v"), f"_b{i}": pick(2 * i + 1, "_v")}


def _interpolated(i: int, q: float) -> Column:
    at = (F.col("_c") - 1) * F.lit(float(q))
    low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
    return F.when(high.isNull(), low).otherwise(low + (high - low) * (at - F.floor(at)))


def frame_quantile(df: DataFrame, keys: list[str], order: str, value: str, quantiles: dict[str, float], rows: int | None = None, prior: bool = True,
                   min_periods: int = 1) -> DataFrame:
    """Add exact interpolated quantiles of every row's past: all rows up to the one before (prior) or up to itself, or the
    last `rows` of these; NULL below min_periods values.  NULL values do not count.  A series has one row per `order`."""
    d = _numbered(df, keys, order)
    longest = d.agg(F.max("_t")).first()[0] or 0
    if longest <= SHORT:
        return _by_frame(d, keys, value, quantiles, rows, prior, min_periods).drop("_t", "_c")
    size = F.max("_t").over(Window.partitionBy(*keys))
    d = d.withColumn("_size", size)
    short = _by_frame(d.where(F.col("_size") <= SHORT), keys, value, quantiles, rows, prior, min_periods)
    d = d.where(F.col("_size") > SHORT)
    values, levels = _ranked(d, keys, value)
    d, hi = d.withColumn("_c", _seen(keys, value, rows, prior)), -1 if prior else 0
    found = _descend(values, _quantile_asked(d, keys, list(quantiles.values()), min_periods), keys, levels, None if rows is None else hi - rows + 1, hi, False)
    found = found.join(values.select(*keys, F.col("_rank").alias("_node"), "_v").distinct(), [*keys, "_node"])
    cols = {n: c for i, q in enumerate(quantiles.values()) for n, c in _found_quantile(i, q).items()}
    out = d.join(found.groupBy(*keys, "_t").agg(*[c.alias(n) for n, c in cols.items()]), [*keys, "_t"], "left")
    out = out.withColumns({name: _interpolated(i, q) for i, (name, q) in enumerate(quantiles.items())}).drop(*cols)
    return out.unionByName(short).drop("_t", "_c", "_size")


def _by_frame(d: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], rows: int | None, prior: bool, min_periods: int) -> DataFrame:
    """The engine's own percentile of a frame, for series of at most SHORT rows: rows x history is bounded there."""
    hi = -1 if prior else 0
    f = Window.partitionBy(*keys).orderBy("_t").rowsBetween(UNB if rows is None else hi - rows + 1, hi)
    d = d.withColumn("_c", F.count(value).over(f))
    return d.withColumns({name: F.when(F.col("_c") >= max(1, min_periods), F.percentile(value, F.lit(float(q))).over(f)) for name, q in quantiles.items()})


def left_tail(df: DataFrame, keys: list[str], order: str, value: str, rows: int, level: float = 0.05, k: float = 1.0) -> DataFrame:
    """Add cvar_5, the negated mean of a row's last `rows` values at or below their quantile, and below_sigma, the share of
    them below -k sample deviations; both from three values on.

    A window of at most LAGS rows is read as that many lag columns in one pass; a longer one takes one walk for both.
    """
    w = Window.partitionBy(*keys).orderBy("_t")
    f = w.rowsBetween(-rows + 1, 0)
    bound = F.when(F.col("_sd") >= 1e-12, -k * F.col("_sd"))
    if rows <= LAGS:
        d = df.withColumn("_t", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
        d = d.select("*", F.count(value).over(f).alias("_c"), F.stddev_samp(value).over(f).alias("_sd"), F.percentile(value, F.lit(level)).over(f).alias("_cut"),
                     *[F.lag(value, i).over(w).alias(f"_l{i}") for i in range(rows)])
        seen = [F.col(f"_l{i}") for i in range(rows)]
        out = d.withColumns({"_tail": sum((F.coalesce((x <= F.col("_cut")).cast("int"), F.lit(0)) for x in seen), F.lit(0)), "_total": sum((F.when(x <= F.col("_cut"), x).otherwise(0.0) for x in seen), F.lit(0.0)),
                             "_bound": bound, "_less": sum((F.coalesce((x < bound).cast("int"), F.lit(0)) for x in seen), F.lit(0))}).drop("_cut", *[f"_l{i}" for i in range(rows)])
    else:
        d = _numbered(df, keys, order)
        values, levels = _ranked(d, keys, value)
        d = d.withColumn("_c", _seen(keys, value, rows, False)).withColumn("_sd", F.stddev_samp(value).over(f)).withColumn("_bound", bound)
        asked = _quantile_asked(d, keys, [level], 3).unionByName(_below_asked(d, values, keys, "_bound", 2))
        found = _descend(values, asked, keys, levels, -rows + 1, 0, True)
        at = lambda n, c: F.max(F.when(F.col("_id") == n, c))
        # no value of the frame lies between the quantile's two neighbours, so the tail is what is at or below the lower one
        found = found.groupBy(*keys, "_t").agg(at(0, F.col("_n") + F.col("_here")).alias("_tail"), at(0, F.col("_sum") + F.col("_here_sum")).alias("_total"), at(2, F.col("_n")).alias("_less"))
        out = d.join(found, [*keys, "_t"], "left")
    return (out.withColumn("cvar_5", F.when(F.col("_c") >= 3, -ratio("_total", "_tail"))).withColumn("below_sigma", F.when((F.col("_c") >= 3) & F.col("_bound").isNotNull(), ratio("_less", "_c")))
            .drop("_t", "_c", "_sd", "_bound", "_tail", "_total", "_less"))


def sliding_drawdown(df: DataFrame, keys: list[str], order: str, price: str, rows: int, out: str) -> DataFrame:
    """Worst fall from a peak within the last `rows` rows, from two prices on.

    A series is cut into blocks of `rows` rows.  A window is the end of one block and the beginning of the next, and the
    drawdown of two adjoining pieces follows from their highest and lowest prices and own drawdowns; so running states from
    both ends of a block and one look-up a row do, and no row carries its window.
    """
    p, w = F.col(price).cast("double"), Window.partitionBy(*keys).orderBy("_n")
    d = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).withColumn("_b", F.floor(F.col("_n") / rows))
    head = Window.partitionBy(*keys, "_b").orderBy("_n").rowsBetween(UNB, 0)
    d = d.withColumns({"_hi": F.max(p).over(head), "_lo": F.min(p).over(head), "_seen": F.count(p).over(w.rowsBetween(UNB, 0))})
    d = d.withColumn("_dd", F.min(ratio(p, "_hi") - 1.0).over(head))
    tail = Window.partitionBy(*keys, "_b").orderBy(F.desc("_n")).rowsBetween(UNB, 0)
    d = d.withColumns({"_hi_after": F.max(p).over(tail), "_lo_after": F.min(p).over(tail)})
    d = d.withColumn("_dd_after", F.min(ratio("_lo_after", p) - 1.0).over(tail))
    partial = F.col("_n") % rows != rows - 1
    before = lambda c: F.when(partial, F.lag(c, rows - 1).over(w)) if rows > 1 else F.lit(None).cast("double")
    values = F.col("_seen") - F.coalesce(F.lag("_seen", rows).over(w), F.lit(0))
    d = d.withColumns({"_a": before("_dd_after"), "_h": before("_hi_after"), "_values": values})
    worst = F.least("_dd", "_a", ratio("_lo", "_h") - 1.0)
    return d.withColumn(out, F.when(F.col("_values") >= 2, worst)).drop("_n", "_b", "_hi", "_lo", "_seen", "_dd", "_hi_after", "_lo_after", "_dd_after", "_a", "_h", "_values")

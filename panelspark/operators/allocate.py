"""Allocation jobs: one task per decision matrix, moments and accounting in Spark."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.operators.covariance import augmented, solve

MAX_NAMES = 2000  # 2 million rows with two names each, some 400 MB in a worker; larger sets raise and belong in sleeves


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    names = np.unique(pdf["k1"].to_numpy().astype(str))
    if len(names) > MAX_NAMES:
        raise ValueError(f"{len(names)} names in one decision; group them into sleeves or use inverse volatility")
    i = np.searchsorted(names, pdf["k1"].to_numpy().astype(str))
    j = np.searchsorted(names, pdf["k2"].to_numpy().astype(str))
    c = np.zeros((len(names), len(names)))
    c[i, j] = c[j, i] = pdf["cov"].to_numpy()
    return names, c


def _schema(df: DataFrame, group: list[str], extra: str) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{g} {types[g]}" for g in group) + ", " + extra


def allocate(entries: DataFrame, group: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Run ``kernel(matrix) -> weights`` on every decision; kernels and user callables share the protocol."""
    def one(keys, pdf):
        names, c = _matrix(pdf)
        out = pd.DataFrame({"key": names, "weight": np.asarray(kernel(c), float)})
        for g, k in zip(group, keys):
            out[g] = k
        return out[[*group, "key", "weight"]]
    return entries.select(*group, "k1", "k2", "cov").groupBy(*group).applyInPandas(one, _schema(entries, group, "key string, weight double"))


def allocate_many(entries: DataFrame, group: list[str], kernels: dict[str, Callable[[np.ndarray], np.ndarray]], label: str = "strategy") -> DataFrame:
    """Several kernels on the same matrix in one pass: the moments are built and shuffled once."""
    def one(keys, pdf):
        names, c = _matrix(pdf)
        out = pd.concat([pd.DataFrame({"key": names, "weight": np.asarray(fn(c), float), label: name}) for name, fn in kernels.items()])
        for g, k in zip(group, keys):
            out[g] = k
        return out[[*group, label, "key", "weight"]]
    return entries.select(*group, "k1", "k2", "cov").groupBy(*group).applyInPandas(one, _schema(entries, group, f"{label} string, key string, weight double"))


def _with_inputs(entries: DataFrame, inputs: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Matrix rows with the inputs of their first name; one join instead of a second grouped side."""
    i = inputs.select(*group, F.col("key").alias("k1"), *columns)
    return entries.select(*group, "k1", "k2", "cov").join(i, [*group, "k1"], "left")


def _diagonal(pdf: pd.DataFrame, names: np.ndarray, columns: list[str]) -> np.ndarray:
    own = pdf[pdf["k1"] == pdf["k2"]].set_index("k1")
    return own.loc[names, columns].to_numpy(float)


def frontier_scalars(entries: DataFrame, means: DataFrame, group: list[str]) -> DataFrame:
    """A = 1'C^-1 1, B = m'C^-1 1, C = m'C^-1 m per decision."""
    def one(keys, pdf):
        names, c = _matrix(pdf)
        m = _diagonal(pdf, names, ["mean"])[:, 0]
        x = np.linalg.solve(c, np.column_stack([np.ones(len(m)), m]))
        return pd.DataFrame({**{g: [k] for g, k in zip(group, keys)}, "a": [x[:, 0].sum()], "b": [m @ x[:, 0]], "c": [m @ x[:, 1]]})
    d = _with_inputs(entries, means, group, ["mean"])
    return d.groupBy(*group).applyInPandas(one, _schema(entries, group, "a double, b double, c double"))


def var1_forecast(df: DataFrame, keys: list[str], order: str, columns: list[str], lookback: int, min_rows: int = 13) -> DataFrame:
    """One-step forecast of a vector by a VAR(1) on the `lookback` rows before each decision; no change (the last row) where
    there are fewer than min_rows or the system is singular.  A row without any history is left out.

    Each equation has an intercept, so slopes follow from covariances: these are frame aggregates over pairs of neighbouring
    rows, and the system of the columns is solved in an expression; no row is copied to the decisions that see it.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.select(*keys, order, *columns, *[F.lag(c).over(w).alias(f"_p{i}") for i, c in enumerate(columns)], (F.row_number().over(w) - 1).alias("_before"))
    f, n = w.rowsBetween(-lookback + 1, -1), len(columns)
    out = {f"a_{i}_{j}": F.covar_pop(f"_p{i}", f"_p{j}").over(f) for i in range(n) for j in range(i, n)}
    out |= {f"y{q}_{i}": F.covar_pop(f"_p{i}", c).over(f) for q, c in enumerate(columns) for i in range(n)}
    paired = lambda c: F.avg(F.when(F.col("_p0").isNotNull(), F.col(c))).over(f)
    out |= {f"_mx{i}": F.avg(f"_p{i}").over(f) for i in range(n)} | {f"_my{q}": paired(c) for q, c in enumerate(columns)}
    d = d.withColumns(out).withColumn("_s", solve(augmented(n, [[F.col(f"y{q}_{i}") for i in range(n)] for q in range(n)]), n))
    d = d.withColumn("rows", F.least("_before", F.lit(lookback)).cast("int")).where("rows > 0")
    fit = {q: sum((F.col("_s")[i][n + q] * (F.col(f"_p{i}") - F.col(f"_mx{i}")) for i in range(n)), F.col(f"_my{q}")) for q in range(n)}
    return d.select(*keys, order, *[F.coalesce(F.when(F.col("rows") >= min_rows, fit[q]), F.col(f"_p{q}")).alias(f"{c}_hat") for q, c in enumerate(columns)], "rows")


def regime_labels(df: DataFrame, order: str, columns: list[str], vol: str, min_rows: int = 36, lookback: int | None = None,
                  group: list[str] = (), steps: int = 8) -> DataFrame:
    """Walk-forward two-state label (stress) of every row from `min_rows` rows on, without looking ahead.

    Two-means where a row's state is decided at its own date: its distance, in that date's standard deviations, to the mean of
    the rows of either state up to that date (or among the last `lookback` periods).  The states begin as the nearer of the
    calmest and the wildest row so far, and `steps` rounds move the means.  A round is two conditional frame averages for each
    column over the states of the round before, so a row is in the frames of later dates and copied to none.  Stress is the
    state with the higher mean volatility; a past of equal rows is calm.  settled: whether the last round changed nothing.
    """
    g, cols = list(group), [vol, *[c for c in columns if c != vol]]
    w = Window.partitionBy(*g).orderBy(order)
    f = w.rangeBetween(Window.unboundedPreceding if lookback is None else -lookback + 1, 0)
    d = df.where(" and ".join(f"{c} is not null" for c in cols)).select(*g, order, *cols)
    own = F.struct(*cols)
    d = d.withColumns({"rows": F.count("*").over(f).cast("int"), "_lo": F.min_by(own, vol).over(f), "_hi": F.max_by(own, vol).over(f)}
                      | {f"_sd_{c}": F.coalesce(F.nullif(F.stddev_samp(c).over(f), F.lit(0.0)), F.lit(1.0)) for c in cols})

    def nearest(centre):
        away = [sum((F.pow((F.col(c) - centre(k, c)) / F.col(f"_sd_{c}"), F.lit(2.0)) for c in cols), F.lit(0.0)) for k in (0, 1)]
        return (away[1] < away[0]).cast("int")
    d = d.withColumn("_state", nearest(lambda k, c: F.col(f"_{('lo', 'hi')[k]}.{c}")))
    for _ in range(steps):
        means = {f"_m{k}_{c}": F.avg(F.when(F.col("_state") == k, F.col(c))).over(f) for k in (0, 1) for c in cols}
        d = d.withColumns(means).withColumnRenamed("_state", "_was")
        d = d.withColumn("_state", nearest(lambda k, c: F.coalesce(F.col(f"_m{k}_{c}"), F.col(f"_{('lo', 'hi')[k]}.{c}")))).withColumn("settled", F.col("_state") == F.col("_was")).drop("_was")
    mean = {k: F.avg(F.when(F.col("_state") == k, F.col(vol))).over(f) for k in (0, 1)}
    d = d.withColumns({"_v0": mean[0], "_v1": mean[1]})
    stress = F.when(F.col("_v1").isNull(), 0).when(F.col("_v0").isNull() | (F.col("_v1") >= F.col("_v0")), F.col("_state")).otherwise(1 - F.col("_state"))
    return d.where(F.col("rows") >= min_rows).select(*g, order, stress.alias("stress"), "rows", "settled")

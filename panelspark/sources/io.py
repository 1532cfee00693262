"""Sources and sinks.  Schemas are explicit; wide files become long at the edge."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions.scalar import loose_true, norm_key, strict_bool
from panelspark.operators import quality as Q
from panelspark.sources.stage import scratch_dir  # noqa: F401 (part of this module's interface)

DATE_NAMES = ("date", "datetime", "timestamp")


def _wide(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', mode="FAILFAST")


def _date_column(columns: list[str]) -> str:
    return next((c for c in columns if c.strip().lower() in DATE_NAMES), columns[0])


def read_wide_panel(spark: SparkSession, path: str, value: str = "price") -> DataFrame:
    """Wide CSV (date column + one column per key) to (key, date, value); bad numbers become NULL rows dropped."""
    df = _wide(spark, path)
    date = _date_column(df.columns)
    keys = [c for c in df.columns if c != date]
    long = df.select(F.to_date(date).alias("date"), *[F.col(f"`{c}`") for c in keys]).unpivot("date", keys, "key", value)
    return long.select(norm_key("key").alias("key"), "date", F.expr(f"try_cast({value} as double)").alias(value)).where(F.col(value).isNotNull())


def pivot_keys(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """Column names of a wide file, from the data; more than a file can hold is an error, never a cut."""
    keys = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} values of {column}: write the long form")
    return sorted(keys)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def read_universe(spark: SparkSession, path: str, key: str = "Ticker", tags: tuple[str, ...] = ()) -> DataFrame:
    df = require_columns(_wide(spark, path), key)
    return df.withColumn(key, norm_key(key)).withColumns({t: strict_bool(t) for t in tags})


def thin_flags(coverage: DataFrame, key: str = "ticker", flag: str = "thin_lt5y") -> DataFrame:
    """Thin-history flag per key from a coverage table with either header case."""
    name = next((c for c in coverage.columns if c.lower() == key.lower()), None)
    if name is None or flag not in coverage.columns:
        raise ValueError("coverage needs a key and a thin flag")
    return coverage.select(norm_key(name).alias("key"), loose_true(flag).alias("thin"))


def read_rate(spark: SparkSession, path: str, value: str, date: str = "observation_date") -> DataFrame:
    """Percent annual rate to a monthly decimal (x / 1200); one row per month or an error on read."""
    df = _wide(spark, path)
    df = df.select(F.trunc(F.to_date(date), "MM").alias("month"), (F.expr(f"try_cast(`{value}` as double)") / 1200.0).alias("rate"))
    n = F.count("*")
    g = df.groupBy("month").agg(F.first("rate").alias("rate"), n.alias("_n"))
    ok = F.when(F.col("_n") == 1, F.col("rate")).otherwise(F.raise_error(F.concat(F.lit("duplicate month "), F.col("month").cast("string"))).cast("double"))
    return g.select("month", ok.alias("rate")).where("rate is not null")


def saved_series(df: DataFrame, filters: dict[str, str], value: str, date: str = "date", min_day: int = 25) -> DataFrame:
    """Equality filters and one column of a saved result table, rows before the 25th dropped."""
    for k, v in filters.items():
        df = df.where(F.col(k).cast("string") == str(v))
    return df.where(F.dayofmonth(date) >= min_day).select(F.trunc(date, "MM").alias("month"), F.col(value).alias("ret"))


def long_weights(df: DataFrame, filters: dict[str, str], key: str = "key", month: str = "month", weight: str = "weight") -> DataFrame:
    for k, v in filters.items():
        df = df.where(F.col(k).cast("string") == str(v))
    return df.select(F.trunc(month, "MM").alias("month"), F.col(key).cast("string").alias("key"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("weight"))


def wide_weights(df: DataFrame, ids: list[str], prefix: str = "w_") -> DataFrame:
    """Columns w_<KEY> to rows."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    long = df.select(*ids, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in cols]).unpivot(ids, cols, "key", "weight")
    return long.withColumn("key", F.substring("key", len(prefix) + 1, 1000))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("dateFormat", "yyyy-MM-dd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_json(df: DataFrame, path: str, id_col: str, mode: str = "errorifexists") -> None:
    """One JSON object per subject; NaN and infinities become null."""
    cols = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode(mode).partitionBy(id_col).option("ignoreNullFields", False).json(path)


def write_bundle(tables: dict[str, DataFrame], record: DataFrame, path: str, provenance: DataFrame | None) -> None:
    """Result bundle: the record must be consistent and carry provenance, and nothing is overwritten.

    ``record``: one row (gate, mechanical, composition, label).  Checks run before any write.
    """
    if provenance is None or provenance.limit(1).count() == 0:
        raise ValueError("panel provenance is required")
    bad = Q.record_errors(record, "label", "mechanical", "composition").limit(1).collect()
    if bad:
        raise ValueError(f"inconsistent record: {bad[0].asDict()}")
    write_table(record, f"{path}/record", "json")
    write_table(provenance, f"{path}/provenance", "json")
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Quoted text with doubled quotes, CRLF and BOM; an unclosed quote fails the read."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", mode="FAILFAST")


def provenance(df: DataFrame, name: str, date: str, source: str) -> DataFrame:
    """One row that says where a panel ends and comes from."""
    return df.agg(F.lit(name).alias("panel"), F.lit(source).alias("source"), F.max(date).alias("source_asof"), F.count("*").alias("rows"))

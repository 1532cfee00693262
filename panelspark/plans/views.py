"""Canonical panel views over the source tables.

Every view starts with a partial aggregation of the fact table to (key, period), so a
key that holds a third of the rows shuffles one combined row per task and period.
Dates are cast once here.  An incomplete final month is left out: its first day is taken
from the data, a scalar that the scan filters on.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelspark.functions.scalar import month_idx, month_of, ratio
from panelspark.functions.stats import steady_sum
from panelspark.session import ship
from panelspark.sources.stage import stage

RATE_SPLIT = "1997-07-01"  # months before it use the fallback rate
BENCH_B, BENCH_S = "Brand#1", "S1"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def shared(self, *names: str) -> "Views":
        """Stage views that a job reads more than once: the fact table is then scanned once.

        A derived view (returns) must be named before or instead of its base (prices).
        """
        for n in names:
            setattr(self, n, stage(getattr(self, n)))
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def complete_months(self, name: str, date: str) -> DataFrame:
        """Rows of a table before its final month, unless that month's last day is there."""
        t = self.table(name)
        end = t.agg(F.date_trunc("month", F.date_add(F.max(date).cast("date"), 1)).alias("end")).scalar()
        return t.where(F.col(date) < end)

    def rows(self, schema: str, *data) -> DataFrame:
        return self.spark.createDataFrame(list(data), schema)

    # ------------------------------------------------------------ price panels
    @staticmethod
    def _prices(lines: DataFrame, key, period) -> DataFrame:
        return (lines.groupBy(key.alias("key"), period.alias("period"))
                .agg(ratio(steady_sum("l_extendedprice"), steady_sum("l_quantity")).alias("price"),
                     steady_sum("l_quantity").alias("volume")))

    @cached_property
    def _lines(self) -> DataFrame:
        return self.complete_months("lineitem", "l_shipdate").withColumn("d", F.col("l_shipdate").cast("date"))

    @cached_property
    def px_s(self) -> DataFrame:
        """Supplier x month price panel; the key count grows with the data."""
        p = self._prices(self._lines, F.concat(F.lit("S"), F.col("l_suppkey")), month_of("d"))
        return p.withColumnRenamed("period", "month").withColumn("midx", month_idx("month"))

    def _by_part(self, attr: str, period) -> DataFrame:
        lines = (self._lines.groupBy("l_partkey", period.alias("period"))
                 .agg(steady_sum("l_extendedprice").alias("l_extendedprice"), steady_sum("l_quantity").alias("l_quantity")))
        part = self.table("part").select("p_partkey", attr)
        return self._prices(lines.join(part, lines.l_partkey == part.p_partkey), F.col(attr), F.col("period"))

    @cached_property
    def px_b(self) -> DataFrame:
        """Brand x month price panel (25 keys), the input of matrix-shaped jobs."""
        return (self._by_part("p_brand", month_of("d")).withColumnRenamed("period", "month")
                .withColumn("midx", month_idx("month")))

    @cached_property
    def px_d(self) -> DataFrame:
        """Part type x ship day price panel."""
        return self._by_part("p_type", F.col("d")).withColumnRenamed("period", "date")

    @staticmethod
    def _ret(px: DataFrame) -> DataFrame:
        w = Window.partitionBy("key").orderBy("midx")
        adjacent = F.lag("midx").over(w) == F.col("midx") - 1
        return px.select("key", "month", "midx",
                         F.when(adjacent, ratio("price", F.lag("price").over(w)) - 1.0).alias("ret"))

    @cached_property
    def ret_s(self) -> DataFrame:
        return self._ret(self.px_s)

    @cached_property
    def ret_b(self) -> DataFrame:
        return self._ret(self.px_b)

    @cached_property
    def ret_d(self) -> DataFrame:
        """Daily returns of observed prices (previous observed row)."""
        w = Window.partitionBy("key").orderBy("date")
        return self.px_d.select("key", "date", "price", "volume",
                                (ratio("price", F.lag("price").over(w)) - 1.0).alias("ret"))

    # ------------------------------------------------------------ dimensions
    @staticmethod
    def _tags(df: DataFrame) -> DataFrame:
        n = F.col("num")
        return df.select(
            "key", "num", "name", F.concat(F.lit("C"), n % 5).alias("category"),
            F.when(n % 11 == 0, "Appendix 3").otherwise("Core").alias("section"),
            (n % 7 == 0).alias("cash_like"), (n % 7 == 1).alias("short_duration"), (n % 7 == 2).alias("near_cash"),
            (n % 7 == 3).alias("thin"), (n % 7 >= 4).alias("equity_only"),
            F.element_at(F.array(F.lit("equity"), F.lit("bond"), F.lit("commodity")), (n % 3 + 1).cast("int"))
            .alias("asset_class"), (n % 10 != 9).alias("approved"))

    @cached_property
    def uni_s(self) -> DataFrame:
        return self._tags(self.table("supplier").select(
            F.concat(F.lit("S"), F.col("s_suppkey")).alias("key"), F.col("s_suppkey").alias("num"),
            F.col("s_name").alias("name")))

    @cached_property
    def uni_b(self) -> DataFrame:
        return self._tags(self.table("part").select(F.col("p_brand").alias("key")).distinct().select(
            "key", F.split("key", "#")[1].cast("bigint").alias("num"), F.col("key").alias("name")))

    @cached_property
    def deny_s(self) -> DataFrame:
        return self.uni_s.where(F.col("num") % 25 == 3).select("key")

    @cached_property
    def coverage_s(self) -> DataFrame:
        return self.px_s.groupBy("key").agg(F.min("month").alias("start"), F.max("month").alias("end"),
                                            F.count("price").alias("n_obs"))

    # ------------------------------------------------------------ rates, series, weights
    @cached_property
    def rates(self) -> DataFrame:
        m = month_of("d").alias("month")
        r = self._lines.groupBy(m).agg((F.avg("l_discount") / 12.0).alias("fallback"), (F.avg("l_tax") / 12.0).alias("own"))
        late = F.col("month") >= F.lit(RATE_SPLIT).cast("date")
        return r.select("month", month_idx("month").alias("midx"), F.when(late, F.col("own")).otherwise(F.col("fallback")).alias("rate"),
                        F.when(late, "own").otherwise("fallback").alias("source"))

    @cached_property
    def _order_values(self) -> DataFrame:
        """Order value by (customer, month): combined before the customer join."""
        return (self.complete_months("orders", "o_orderdate")
                .groupBy("o_custkey", month_of(F.col("o_orderdate").cast("date")).alias("month"))
                .agg(F.sum("o_totalprice").alias("v"))
                .join(self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"),
                      "o_custkey"))

    @staticmethod
    def _change(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("key").orderBy("midx")
        return df.select("key", "month", "midx", F.when(F.lag("midx").over(w) == F.col("midx") - 1,
                                                        ratio("v", F.lag("v").over(w)) - 1.0).alias("ret"))

    @cached_property
    def series(self) -> DataFrame:
        """Monthly change of order value per market segment."""
        g = self._order_values.groupBy(F.col("c_mktsegment").alias("key"), "month").agg(F.sum("v").alias("v"))
        return (self._change(g.withColumn("midx", month_idx("month"))).where(F.col("ret").isNotNull())
                .withColumnRenamed("key", "series_id"))

    @cached_property
    def trial_ret(self) -> DataFrame:
        """One return series per (segment, region): the trial table of the inference jobs."""
        g = (self._order_values.join(self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
             .groupBy(F.concat_ws("_R", "c_mktsegment", F.col("n_regionkey").cast("string")).alias("key"), "month")
             .agg(F.sum("v").alias("v")))
        return (self._change(g.withColumn("midx", month_idx("month"))).where(F.col("ret").isNotNull())
                .withColumnRenamed("key", "trial_id"))

    @cached_property
    def weights(self) -> DataFrame:
        """Share of a segment's monthly order value by nation."""
        g = (self._order_values.join(self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
             .groupBy(F.col("c_mktsegment").alias("strategy"), "month", F.col("n_name").alias("key"))
             .agg(F.sum("v").alias("v")))
        total = g.groupBy("strategy", "month").agg(F.sum("v").alias("t"))
        return (g.join(total, ["strategy", "month"])
                .select("strategy", "month", month_idx("month").alias("midx"), "key", ratio("v", "t").alias("weight")))

    @cached_property
    def nation_ret(self) -> DataFrame:
        """Monthly change of order value per nation: the returns the weights earn."""
        g = (self._order_values.join(self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
             .groupBy(F.col("n_name").alias("key"), "month").agg(F.sum("v").alias("v")))
        return self._change(g.withColumn("midx", month_idx("month")))

    @cached_property
    def constituents(self) -> DataFrame:
        """Region sleeves with equal weight per nation."""
        n, r = self.table("nation"), self.table("region")
        size = n.groupBy("n_regionkey").agg(F.count("*").alias("k"))
        return (n.join(size, "n_regionkey").join(r, F.col("n_regionkey") == r.r_regionkey)
                .select(F.col("r_name").alias("sleeve"), F.col("n_name").alias("key"), (1.0 / F.col("k")).alias("within")))

    @cached_property
    def uni_n(self) -> DataFrame:
        return self._tags(self.table("nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("bigint").alias("num"),
                                                      F.col("n_name").alias("name")))

    @cached_property
    def events_daily(self) -> DataFrame:
        return (self.table("events").groupBy(F.col("event_type").alias("key"), F.col("ts").cast("date").alias("date"))
                .agg(F.avg("value").alias("value")))

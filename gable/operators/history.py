"""Prices of one thing over time, without a task that holds or orders a whole history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _falls(old: Column, new: Column) -> Column:
    """Whether a price is below the one before it (a struct, null if there is none); missing prices count as 0."""
    return old.isNotNull() & (F.coalesce(new, F.lit(0)) < F.coalesce(old["price"], F.lit(0)))


def changes(rows: DataFrame, key: str, at: str, tie: str, price: str, period: str = "month") -> DataFrame:
    """key, n, last, before (the price before the last one), any_drop and last_drop (by the rules of functions.finance) of each history.

    Histories are in order of `at` and `tie`, missing ones first; a missing key has a history of its own. They are cut into periods: each is put in
    order alone and leaves one row, its ends, and the ends are linked in order. So a task orders one key's rows of a period, or its periods.
    """
    own = rows.select(F.col(key).alias(key), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")).alias("_place"), F.col(price).alias("price"), F.struct(F.date_trunc(period, at).alias("period")).alias("_period"))
    own = own.withColumn("_before", F.lag(F.struct("price")).over(Window.partitionBy(key, "_period").orderBy("_place")))
    ends = own.groupBy(key, "_period").agg(
        F.count("*").alias("n"), F.min_by("price", "_place").alias("_first"), F.max_by(F.struct("price", "_before"), "_place").alias("_last"),
        F.bool_or(_falls(F.col("_before"), F.col("price"))).alias("_drop"),
    )
    ends = ends.withColumn("_carried", F.lag(F.struct(F.col("_last.price").alias("price"))).over(Window.partitionBy(key).orderBy("_period")))
    out = ends.groupBy(key).agg(
        F.sum("n").alias("n"), F.max_by(F.struct(F.col("_last.price").alias("last"), F.coalesce("_last._before", "_carried").alias("before")), "_period").alias("_end"),
        F.bool_or(F.col("_drop") | _falls(F.col("_carried"), F.col("_first"))).alias("any_drop"),
    )
    out = out.select(key, "n", F.col("_end.last").alias("last"), F.col("_end.before.price").alias("before"), "any_drop")
    return out.withColumn("last_drop", F.coalesce((F.col("last") < F.col("before")) & (F.col("before") > 0), F.lit(False)))

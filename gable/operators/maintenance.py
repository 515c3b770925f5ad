"""Tables at rest: retention, upserts, seeds, compaction, newest files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def retained(rows: DataFrame, column: str, as_of: dt.datetime, days: int) -> DataFrame:
    """Rows at most `days` old; rows without a date stay."""
    cutoff = F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")
    return rows.where(F.col(column).isNull() | (F.col(column) >= cutoff))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """target with source's rows in the place of those of equal keys; columns in `keep` stay as target has them."""
    for c in keep or []:
        source = source.drop(c).join(target.select(*keys, c), keys, "left") if c in target.columns else source
    return target.join(source, keys, "left_anti").unionByName(source, allowMissingColumns=True)


def insert_absent(target: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(seed.join(target, keys, "left_anti"), allowMissingColumns=True)


def compact(spark: SparkSession, source: str, to: str, target_bytes: int = 128 << 20) -> None:
    """Rewrite a Parquet folder in files of about target_bytes; the rebalance hint lets Spark size them."""
    spark.read.parquet(source).hint("rebalance").write.option("maxRecordsPerFile", 0).option("parquet.block.size", target_bytes).parquet(to)


def newest(files: DataFrame, as_of: dt.datetime, hours: int = 48) -> DataFrame:
    """The newest file of a catalogue (path, modified) and whether it is too old."""
    out = files.agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))
    old = F.timestamp_diff("HOUR", F.col("modified"), F.lit(as_of).cast("timestamp_ntz"))
    return out.withColumn("status", F.when(F.col("path").isNull(), "critical").when(old > hours, "warning").otherwise("ok"))


def expired(at: Column, as_of: dt.datetime, days: int) -> Column:
    """Whether a date is more than `days` old; a missing one isn't."""
    return F.coalesce(at < F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz"), F.lit(False))


def without_parents(children: DataFrame, purged: DataFrame, key: str) -> DataFrame:
    """The children whose parent isn't purged."""
    return children.join(purged.select(key), key, "left_anti")


def keep_newest(rows: DataFrame, by: str, newest_first: list[str], n: int) -> DataFrame:
    """The n newest rows of each group."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in newest_first))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cached(entries: DataFrame, key: str, at: str) -> DataFrame:
    """A cache after appending: of each key the newest entry."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_e")).select(key, *(F.col(f"_e.{c}").alias(c) for c in rest))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified and size of every file in a folder and those inside it, as a scan that reads no content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("modified"), F.col("length").alias("size"))

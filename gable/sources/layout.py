"""How tables lie on disk: rows that are near in several columns near in the files, joins without a shuffle, statistics for the optimiser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of each column in a place.
BITS = 16


def _spread(x: Column, n: int) -> Column:
    """The BITS bits of a long, n places apart."""
    return reduce(Column.bitwiseOR, (F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long")), i * n) for i in range(BITS)))


def morton(df: DataFrame, columns: list[str]) -> Column:
    """A row's place on a curve that keeps rows near which are near in all columns (4 at most): the bits of the columns' places, taken in turns.

    Numbers, dates and times lie by their value between the smallest and the largest; texts by their hash, so that equal ones lie together. Nulls come first.
    """
    if not 0 < len(columns) <= 4:
        raise ValueError("one to four columns")
    kinds = {c: df.schema[c].dataType for c in columns}
    as_number = {c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(c).cast("double") for c, k in kinds.items() if not isinstance(k, T.StringType)}
    ends = df.agg(*(f(v).alias(f"{n}_{c}") for c, v in as_number.items() for n, f in (("low", F.min), ("high", F.max)))).first() if as_number else {}
    top, places = (1 << BITS) - 1, []
    for c in columns:
        if c not in as_number:
            place = F.pmod(F.xxhash64(c), F.lit(top)) + 1
        else:
            low, high = ends[f"low_{c}"], ends[f"high_{c}"]
            place = F.floor((as_number[c] - low) / (high - low) * (top - 1)) + 1 if low is not None and high > low else F.lit(1)
        places.append(F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(place.cast("long")))
    return reduce(Column.bitwiseOR, (F.shiftleft(_spread(p, len(columns)), i) for i, p in enumerate(places)))


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int, row_group_bytes: int = 16 << 20) -> None:
    """Write df as Parquet in files that each hold a stretch of the curve, so that a filter on any of the columns skips most row groups by their statistics."""
    own = df.withColumn("_place", morton(df, columns))
    own.repartitionByRange(files, "_place").sortWithinPartitions("_place").drop("_place").write.option("parquet.block.size", row_group_bytes).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> None:
    """Write df as a table in buckets of its keys, sorted: tables of as many buckets are joined on them without a shuffle or a sort."""
    df.repartition(buckets, *keys).write.bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:]).option("path", path).mode("errorifexists").saveAsTable(name)


def analyse(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    """Gather a table's statistics and give them: column, nulls, distinct, low, high. The optimiser uses them where spark.sql.cbo.enabled is set."""
    listed = ", ".join(f"`{c}`" for c in columns)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {listed}")
    found = [{r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {name} `{c}`").collect()} for c in columns]
    whole = lambda x: int(x) if x not in (None, "NULL") else None
    rows = [(c, whole(f.get("num_nulls")), whole(f.get("distinct_count")), f.get("min"), f.get("max")) for c, f in zip(columns, found)]
    return spark.createDataFrame(rows, "column string, nulls long, distinct long, low string, high string")

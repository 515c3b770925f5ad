"""Rows near in several columns lie near in the files, bucketed joins don't shuffle, statistics reach the optimiser."""

import datetime as dt
import random
import uuid

import pytest
from gable.sources import layout
from pyspark.sql import functions as F


def scanned(df):
    """Rows that the scan of a plan without shuffles gave."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_places_interleave_the_bits(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-5, 5), rng.uniform(0, 1), rng.choice("abc")) for _ in range(300)] + [(None, 0.5, "a"), (-5.0, None, None), (5.0, 1.0, "a"), (-5.0, 0.0, "a")]
    df = spark.createDataFrame(rows, "x double, y double, s string")
    got = df.select("x", "y", layout.morton(df, ["x", "y"]).alias("z")).collect()
    ends = [(min(r[i] for r in rows if r[i] is not None), max(r[i] for r in rows if r[i] is not None)) for i in (0, 1)]
    for x, y, z in got:
        places = [0 if v is None else int((v - low) / (high - low) * 65534) + 1 for v, (low, high) in zip((x, y), ends)]
        assert z == sum((places[k] >> b & 1) << (2 * b + k) for b in range(16) for k in (0, 1))
    assert df.select(layout.morton(df, ["s"]).alias("z"), "s").distinct().count() == 4
    with pytest.raises(ValueError):
        layout.morton(df, [])


def test_filters_skip_row_groups(spark, tmp_path):
    df = spark.range(200_000).select(F.rand(1).alias("lat"), F.rand(2).alias("lon"), "id", (F.lit(dt.datetime(2020, 1, 1)) + F.make_dt_interval((F.col("id") % 900).cast("int"))).alias("at")).cache()
    layout.write_clustered(df, f"{tmp_path}/near", ["lat", "lon"], 4, 64 << 10)
    df.write.option("parquet.block.size", 64 << 10).parquet(f"{tmp_path}/plain")
    near, plain = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("near", "plain"))
    for cut in ("lat between 0.4 and 0.45", "lon < 0.05", "lat > 0.9 and lon > 0.9"):
        assert sorted(near.where(cut).select("id").collect()) == sorted(plain.where(cut).select("id").collect())
        assert scanned(near.where(cut)) < 0.5 * scanned(plain.where(cut))
    layout.write_clustered(df, f"{tmp_path}/days", ["id", "at"], 4)
    assert spark.read.parquet(f"{tmp_path}/days").count() == 200_000
    layout.write_clustered(df.where("false"), f"{tmp_path}/none", ["lat", "lon"], 4)
    assert spark.read.schema(df.schema).parquet(f"{tmp_path}/none").count() == 0
    df.unpersist()


def test_bucketed_joins_do_not_shuffle(spark, tmp_path):
    a, b = (f"t_{uuid.uuid4().hex}" for _ in range(2))
    layout.write_bucketed(spark.range(5000).withColumn("v", F.when(F.col("id") % 10 > 0, F.col("id") % 7)), a, f"{tmp_path}/a", ["id"], 4)
    layout.write_bucketed(spark.range(0, 9000, 3).withColumn("w", F.lit("x")), b, f"{tmp_path}/b", ["id"], 4)
    try:
        joined = spark.table(a).hint("merge").join(spark.table(b), "id")
        assert joined.count() == 1667
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        found = {r["column"]: (r["nulls"], r["low"], r["high"]) for r in layout.analyse(spark, a, ["id", "v"]).collect()}
        assert found == {"id": (0, "0", "4999"), "v": (500, "0", "6")}
        spark.conf.set("spark.sql.cbo.enabled", True)
        assert spark.table(a)._jdf.queryExecution().optimizedPlan().stats().rowCount().get() == 5000
    finally:
        spark.conf.unset("spark.sql.cbo.enabled")
        for name in (a, b):
            spark.sql(f"DROP TABLE IF EXISTS {name}")

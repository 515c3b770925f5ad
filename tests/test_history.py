"""Price histories cut into periods equal those gathered whole; limits by rank are taken in the map tasks."""

import datetime as dt
import random

from gable.functions import finance
from gable.operators import dedup, history, maintenance
from pyspark.sql import functions as F

SCHEMA = "seller long, at timestamp_ntz, id long, price double"


def test_changes_equal_whole_histories(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *[start + dt.timedelta(days=rng.randrange(200), hours=rng.randrange(3)) for _ in range(9)]]), i, rng.choice([None, 0.0, -1.0, 5.0, 7.0, 9.0])) for i in range(400)]
    rows += [(10, start, 1000, 160.0), (10, start + dt.timedelta(days=40), 1001, 145.0), (11, start, 1002, 145.0), (11, start + dt.timedelta(days=40), 1003, 160.0), (12, start, 1004, 1.0), (13, start, 1005, None)]
    rows += [(20 + k, start + dt.timedelta(days=20 * i), 2000 + 10 * k + i, rng.choice([None, 0.0, 5.0, 7.0])) for k in range(60) for i in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = df.groupBy("seller").agg(F.sort_array(F.collect_list(F.struct("at", "id", "price"))).alias("h")).select("seller", F.transform("h", lambda x: x["price"]).alias("p"))
    whole = whole.select("seller", F.size("p").alias("n"), F.try_element_at("p", F.lit(-1)).alias("last"), F.try_element_at("p", F.lit(-2)).alias("before"), finance.any_drop(F.col("p")).alias("any_drop"), finance.last_drop(F.col("p")).alias("last_drop"))
    order = lambda r: (r[0] is None, r[0] or 0)
    expected = sorted((tuple(r) for r in whole.collect()), key=order)
    for period in ("month", "day", "year"):
        assert sorted((tuple(r) for r in history.changes(df, "seller", "at", "id", "price", period).collect()), key=order) == expected
    assert sum(r[4] for r in expected) > 5 < sum(r[5] for r in expected) < len(expected)
    assert history.changes(df.where("false"), "seller", "at", "id", "price").count() == 0


def test_no_whole_history_is_gathered_or_ordered(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1 + i % 12, 1), i, 1.0) for i in range(50)], SCHEMA)
    plan = history.changes(df, "seller", "at", "id", "price")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    assert plan.index("hashpartitioning(seller") > 0 and "_period" in plan[plan.rindex("hashpartitioning(seller") :].split(")")[0]  # rows go by seller and period


def test_limits_by_rank_are_taken_before_the_shuffle(spark):
    """Of a hot key no more rows leave a map task than the limit."""
    df = spark.range(1000).select((F.col("id") % 2).alias("key"), "id")
    for out, kept in ((dedup.first_seen(df, "key", "id", "id"), [0, 1]), (maintenance.keep_newest(df, "key", ["id"], 2), [996, 997, 998, 999])):
        assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
        assert sorted(r["id"] for r in out.collect()) == kept

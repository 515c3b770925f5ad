"""Registries, retention, upserts and health over small states."""

import datetime as dt

import pytest
from gable.operators import alerts, health, maintenance, observatory, validation
from gable.sources import tables
from pyspark.sql import functions as F

NOW = dt.datetime(2026, 3, 10)


def test_alert_actions_and_registry(spark):
    registry = spark.createDataFrame([("a", "bon", 100.0, NOW - dt.timedelta(days=61), NOW), ("b", "top", 100.0, NOW, NOW)], "url string, level string, price double, first_sent timestamp_ntz, last_sent timestamp_ntz")
    seen = spark.createDataFrame([("a", 100.0, "bon"), ("b", 90.0, "top"), ("c", 5.0, "bon"), ("", 5.0, "bon"), ("b", 120.0, "top")], "url string, price double, level string")
    decided = alerts.actions(seen, registry)
    assert sorted((r["url"], r["price"], r["action"]) for r in decided.collect()) == [("", 5.0, "new"), ("a", 100.0, "skip"), ("b", 90.0, "drop"), ("b", 120.0, "skip"), ("c", 5.0, "new")]
    after = {r["url"]: r for r in alerts.updated_registry(decided, registry, NOW).collect()}
    assert after["b"]["price"] == 90.0 and after["a"]["price"] == 100.0 and after["c"]["first_sent"] == NOW and "" not in after
    assert {r["url"] for r in alerts.purge(registry, NOW, 60).collect()} == {"b"}


def test_streaks(spark):
    rows = [(i, "s", NOW - dt.timedelta(hours=i), 0, 1) for i in range(3)] + [(9, "s", NOW - dt.timedelta(hours=12), 5, 0), (10, "t", NOW, 3, 0)]
    log = spark.createDataFrame(rows, "id int, source string, at timestamp_ntz, scraped int, errors int")
    found = {r["source"]: r for r in health.streaks(log).collect()}
    assert (found["s"]["failures"], found["s"]["status"], found["t"]["status"]) == (3, "critical", "ok")
    assert health.parsing_rate(log).first()["status"] == "ok"
    assert health.parsing_rate(log.where("false")).first()["status"] == "warning"
    assert health.report(spark.createDataFrame([("a", "ok"), ("b", "warning")], "name string, status string")).first()["status"] == "warning"


def test_retention_keeps_undated_rows(spark):
    df = spark.createDataFrame([(1, NOW), (2, NOW - dt.timedelta(days=31)), (3, None)], "id int, at timestamp_ntz")
    assert sorted(r["id"] for r in maintenance.retained(df, "at", NOW, 30).collect()) == [1, 3]


def test_upsert_keeps_named_columns(spark):
    target = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v int, computed int")
    source = spark.createDataFrame([("b", 5, 99), ("c", 6, 99)], "k string, v int, computed int")
    out = {r["k"]: (r["v"], r["computed"]) for r in maintenance.upsert(target, source, ["k"], keep=["computed"]).collect()}
    assert out == {"a": (1, 10), "b": (5, 20), "c": (6, None)}


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", "top", "top", NOW)], tables.SCHEMAS["alerts"])
    tables.append(df, str(tmp_path), "alerts")
    tables.append(df, str(tmp_path), "alerts")
    assert tables.read(spark, str(tmp_path), "alerts").count() == 2
    maintenance.compact(spark, f"{tmp_path}/alerts", f"{tmp_path}/compacted")
    assert spark.read.parquet(f"{tmp_path}/compacted").count() == 2


def test_newest_file(spark):
    df = spark.createDataFrame([("a", NOW - dt.timedelta(days=3)), ("b", NOW - dt.timedelta(days=4))], "path string, modified timestamp_ntz")
    assert maintenance.newest(df, NOW).first() == ("a", NOW - dt.timedelta(days=3), "warning")
    assert maintenance.newest(df.where("false"), NOW).first()["status"] == "critical"


class _State:
    """A group's state, by hand."""

    def __init__(self):
        self.value, self.timeout, self.hasTimedOut = None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        self.timeout = at

    def getCurrentWatermarkMs(self):
        return 0


def test_entries_of_the_stream_expire():
    import pandas as pd
    from gable.streaming import twins

    decide, state, day = twins._decide_within(60), _State(), dt.timedelta(days=1)

    def said(url, *rows):
        batch = pd.DataFrame([(url, p, i, pd.Timestamp(NOW) + d * day) for i, (p, d) in enumerate(rows)], columns=["url", "price", "seq", "at"])
        return [a for part in decide((url,), iter([batch]), state) for a in part["action"]]

    assert said("a", (100.0, 0), (90.0, 1), (95.0, 2)) == ["new", "drop", "skip"]
    assert said("a", (95.0, 60), (80.0, 61), (80.0, 62)) == ["skip", "new", "skip"]  # kept for 60 days after the first alert, then new
    assert state.timeout == state.value[1] + 60 * 86_400_000 + 1
    state.hasTimedOut = True
    assert said("a") == [] and not state.exists
    state.hasTimedOut = False
    assert said("", (5.0, 0), (5.0, 1)) == ["new", "new"] and not state.exists


def test_budget_without_limit_is_critical(spark):
    assert spark.range(1).select(health.budget(F.lit(0), 0).alias("s")).first()["s"] == "critical"
    log = spark.createDataFrame([(1, "s", NOW, 1, 0, 1)], "id int, source string, at timestamp_ntz, scraped int, errors int, fresh int")
    found = {r["name"]: r["status"] for r in health.checks(log, NOW, 300, 0.1).collect()}
    assert found == {"source_s": "ok", "parsing_rate": "ok", "new_listings": "ok", "api_budget": "ok", "disk_space": "critical"}
    assert health.report(health.checks(log, NOW, 300, 0.1)).first()["summary"] == "Sante globale: CRITICAL - 4 OK, 0 avertissement(s), 1 critique(s)."


def test_quantiles_of_ties_nulls_and_single_values(spark):
    import numpy as np

    values = {"a": [1.0, 1.0, 1.0, 9.0], "b": [5.0], "c": [3.0, 1.0, 2.0], "d": [None], None: [4.0, 8.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double")
    got = {r["k"]: (r["q1"], r["m"], r["n"]) for r in observatory.quantiles(rows, ["k"], "v", {"q1": 0.25, "m": 0.5}, "n").collect()}
    kept = {k: [v for v in vs if v is not None] for k, vs in values.items()}
    assert got == {k: (float(np.quantile(vs, 0.25)), float(np.median(vs)), len(vs)) for k, vs in kept.items() if vs}


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_order_statistics_of_one_large_group(spark, bins):
    """Most rows in one group, values of very different sizes, ties, weights; against numpy and a sorted walk."""
    import numpy as np

    rng = np.random.default_rng(bins)
    v = np.concatenate([rng.lognormal(0, 4, 900), rng.integers(0, 5, 300).astype(float), [-1e12, 1e15]])
    rows = [("a" if i % 10 else None, None, "x", float(x), float(w)) for i, (x, w) in enumerate(zip(v, rng.random(len(v))))]
    df = spark.createDataFrame(rows, "district string, kind string, furnished string, v double, w double").repartition(7)
    shares = {"q1": 0.25, "m": 0.5, "q99": 0.99}
    got = {r["district"]: [r[c] for c in shares] + [r["n"]] for r in observatory.quantiles(df, observatory.SEGMENT, "v", shares, "n", bins).collect()}
    middle = {r["district"]: r["middle"] for r in observatory.weighted_median(df, "v", "w", "middle", bins).collect()}
    for k in ("a", None):
        own = sorted((r[3], r[4]) for r in rows if r[0] == k)
        assert got[k][:3] == pytest.approx([np.quantile([x for x, _ in own], q) for q in shares.values()], rel=1e-12) and got[k][3] == len(own)
        sums = np.cumsum([w for _, w in own])
        assert middle[k] == own[int(np.searchsorted(sums, sums[-1] / 2))][0]


def test_district_stats_keep_districts_without_a_name_or_a_price(spark):
    rows = spark.createDataFrame([("x", 10.0, 2.0), ("x", 30.0, 2.0), (None, 8.0, 4.0), ("y", None, 4.0), ("y", 5.0, 0.0)], "d string, p double, s double")
    got = {r["district"]: (r["median_m2"], r["n"]) for r in validation.district_stats(rows, "d", "p", "s").collect()}
    assert got == {"x": (10.0, 2), None: (2.0, 1), "y": (None, 0)}

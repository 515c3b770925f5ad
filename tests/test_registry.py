"""The registry as stream state and the sink that commits by batch, against the batch operators."""

import datetime as dt

import pytest
from gable.operators import alerts
from gable.streaming import registry
from pyspark.sql import functions as F

NOW = dt.datetime(2026, 3, 10)
DAY = dt.timedelta(days=1)
LISTED = "url string, level string, price double, seq long, at timestamp"


@pytest.fixture
def rocksdb(spark):
    for k, v in registry.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k in registry.ROCKSDB:
        spark.conf.unset(k)


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, LISTED).coalesce(1).write.parquet(f"{folder}/in/{name}")


def run(spark, folder, decide):
    source = spark.readStream.schema(LISTED).parquet(f"{folder}/in/*")
    decide(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return {r["seq"]: r for r in spark.read.parquet(f"{folder}/out").collect()}


def test_stream_equals_the_registry_after_a_restart(spark, tmp_path, rocksdb):
    known = [("a", "bon", 100.0, NOW - 20 * DAY, NOW - 10 * DAY), ("old", "top", 50.0, NOW - 70 * DAY, NOW - 61 * DAY)]
    held = spark.createDataFrame(known, "url string, level string, price double, first_sent timestamp, last_sent timestamp")
    days = [
        [("a", "top", 90.0, 1, NOW), ("old", "bon", 60.0, 2, NOW), ("b", "bon", 10.0, 3, NOW), ("", "bon", 5.0, 4, NOW), (None, "bon", 5.0, 5, NOW)],
        [("a", "veille", 95.0, 6, NOW + DAY), ("b", "top", 9.0, 7, NOW + DAY), ("old", "top", 60.0, 8, NOW + DAY), ("", "bon", 5.0, 9, NOW + DAY)],
        [("a", "bon", 95.0, 10, NOW + 41 * DAY), ("b", "bon", 9.5, 11, NOW + 41 * DAY), ("c", "bon", 1.0, 12, NOW + 41 * DAY)],
    ]
    out = {}
    for i, rows in enumerate(days):
        land(spark, tmp_path, i, rows)
        out = run(spark, tmp_path, lambda s: registry.registry_decisions(s, 60, held))  # each run goes on from the state of the one before
    table, said = held.select("url", "level", "price", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_sent", "last_sent"))), {}
    for rows in days:
        at = rows[0][4]
        table = spark.createDataFrame(alerts.purge(table, at, 60).collect(), table.schema)
        decided = alerts.actions(spark.createDataFrame(rows, LISTED).withColumn("url", F.coalesce("url", F.lit(""))), table).collect()
        said |= {r["seq"]: r["action"] for r in decided}
        table = spark.createDataFrame(alerts.updated_registry(spark.createDataFrame(decided), table, at).collect(), table.schema)
    assert {k: r["action"] for k, r in out.items()} == said
    assert said == {1: "drop", 2: "new", 3: "new", 4: "new", 5: "new", 6: "skip", 7: "drop", 8: "skip", 9: "new", 10: "new", 11: "skip", 12: "new"}
    last = {r["url"]: (r["first_sent"], r["last_sent"]) for _, r in sorted(out.items()) if r["url"]}
    assert last == {r["url"]: (r["first_sent"], r["last_sent"]) for r in table.collect()}


def test_answers_are_held(spark, tmp_path, rocksdb):
    land(spark, tmp_path, 0, [("x", "", 47.0, 1, NOW), ("x", "", 48.0, 2, NOW), ("y", "", None, 3, NOW)])
    source = spark.readStream.schema(LISTED).parquet(f"{tmp_path}/in/*").select(F.col("url").alias("key"), "seq", F.col("price").alias("lat"), F.lit(6.0).alias("lon"))
    asked = registry.geocode_stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start()
    asked.awaitTermination()
    assert {r["seq"]: (r["hit"], r["lat"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: (False, 47.0), 2: (True, 47.0), 3: (False, None)}


def test_a_repeated_batch_writes_nothing_twice(spark, tmp_path):
    folder = f"file://{tmp_path}/sink"
    batches = [[("a", "top", 100.0, 1, NOW), ("a", "bon", 90.0, 2, NOW), ("", "bon", 5.0, 3, NOW)], [("a", "bon", 95.0, 4, NOW), ("b", "bon", 7.0, 5, NOW), ("c", "bon", 8.0, 6, NOW)], [("b", "top", 6.0, 7, NOW), ("c", "top", 8.0, 8, NOW)]]
    frames = [spark.createDataFrame(rows, LISTED) for rows in batches]
    sink = registry.AlertSink(spark, folder, lambda n: NOW + n * DAY, lambda found: found.where("url != 'c' or level = 'top'"))
    assert sink.registry().count() == 0 and sink.alerts().count() == 0
    for n, frame in enumerate(frames):
        sink(frame, n)
        sink(frame, n)  # repeated after a failure
    assert {(r["seq"], r["action"], r["batch"]) for r in sink.alerts().collect()} == {(1, "new", 0), (2, "drop", 0), (3, "new", 0), (5, "new", 1), (7, "drop", 2), (8, "new", 2)}
    assert sink.alerts().count() == 6
    found = {r["url"]: (r["level"], r["price"], r["first_sent"], r["last_sent"]) for r in sink.registry().collect()}
    # c was decided in batch 1 but not sent, so it is new in batch 2
    assert found == {"a": ("bon", 90.0, NOW, NOW), "b": ("top", 6.0, NOW + DAY, NOW + 2 * DAY), "c": ("top", 8.0, NOW + 2 * DAY, NOW + 2 * DAY)}


def test_alerts_without_their_registry_are_not_read(spark, tmp_path):
    """A writer that stops between a batch's alerts and its registry leaves the batch before."""
    folder = f"file://{tmp_path}/sink"
    sink = registry.AlertSink(spark, folder, lambda n: NOW)
    rows = spark.createDataFrame([("a", "top", 100.0, 1, NOW)], LISTED)
    sink(rows, 0)
    rows.selectExpr("url", "level", "price - 1 as price", "seq + 1 as seq", "'drop' as action").write.parquet(f"{folder}/alerts/batch=1")
    assert [r["seq"] for r in sink.alerts().collect()] == [1] and sink.registry().first()["price"] == 100.0
    sink(rows.selectExpr("url", "level", "price - 1 as price", "seq + 1 as seq", "at"), 1)
    assert sorted(r["seq"] for r in sink.alerts().collect()) == [1, 2] and sink.registry().first()["price"] == 99.0

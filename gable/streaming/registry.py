"""The registry of sent alerts as a stream's own state, the cache of geocodes with an expiry, and a sink that commits by batch.

State calls of Python processors wait about 40 ms each over TCP (small messages and delayed acknowledgements), so sessions that run registry_decisions or
geocode_stream should be started with spark.python.unix.domain.socket.enabled. They need the settings in ROCKSDB. State that expires by the clock always
has more to do, so geocode_stream doesn't end under the availableNow trigger.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import alerts

ENTRY = "url string, level string, price double, first_sent timestamp, last_sent timestamp"
DECIDED = "url string, level string, price double, seq long, action string, first_sent timestamp, last_sent timestamp"
#: Where such state is kept: on disk beside the tasks, its changes in the checkpoint folder.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class AlertRegistry(StatefulProcessor):
    """Decides the listings of a URL in order, as the batch rule does, and keeps what the registry holds of it: level, price, first and last alert.

    A timer `days` after the first alert ends the entry; a listing that old is new again, whether the timer has fired or not.
    """

    def __init__(self, days: int):
        self.span = pd.Timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "level string, price double, first_sent timestamp, last_sent timestamp")

    def _keep(self, level: str | None, price: float, first: pd.Timestamp, last: pd.Timestamp) -> None:
        self.entry.update((level, float(price), first.to_pydatetime(), last.to_pydatetime()))

    def _end_at(self, first: pd.Timestamp) -> int:
        return int((first + self.span).value // 1_000_000) + 1

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            if key[0]:
                first = pd.Timestamp(r.first_sent)
                self._keep(r.level, r.price, first, pd.Timestamp(r.last_sent))
                self.handle.registerTimer(self._end_at(first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["at", "seq"])
        held = self.entry.get() if self.entry.exists() else None
        level, price, first, last = (held[0], held[1], pd.Timestamp(held[2]), pd.Timestamp(held[3])) if held else (None, None, None, None)
        began, out = first, []
        for r in found.itertuples():
            known = bool(key[0]) and first is not None and r.at - first <= self.span
            said = "new" if not known else "drop" if r.price < price else "skip"
            if said != "skip":
                level, price, last, first = r.level, r.price, r.at, first if known else r.at
            out.append((key[0], r.level, r.price, r.seq, said, first, last))
        if key[0]:
            self._keep(level, price, first, last)
            if first != began:
                if began is not None:
                    self.handle.deleteTimer(self._end_at(began))
                self.handle.registerTimer(max(self._end_at(first), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["url", "level", "price", "seq", "action", "first_sent", "last_sent"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield pd.DataFrame(columns=["url", "level", "price", "seq", "action", "first_sent", "last_sent"])

    def close(self) -> None:
        pass


def registry_decisions(listings: DataFrame, days: int, registry: DataFrame | None = None, delay: str = "1 day") -> DataFrame:
    """Every listing (url, level, price, seq, at; a stream) with its action and the dates of its URL's first and last alert.

    registry (url, level, price, first_sent, last_sent; a batch) is what a first run starts from; later runs go on from their own state. A URL's rows of one
    micro-batch are put in order in its task. Listings later than the watermark allows are not decided; an empty URL is always new.
    """
    own = listings.withColumn("url", F.coalesce("url", F.lit(""))).withWatermark("at", delay)
    initial = registry.groupBy("url") if registry is not None else None
    return own.groupBy("url").transformWithStateInPandas(AlertRegistry(days), DECIDED, "append", "EventTime", initialState=initial)


class GeocodeCache(StatefulProcessor):
    """Answers of an address, kept for a time after they came."""

    def __init__(self, hours: float):
        self.ttl = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "lat double, lon double", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.answer.get() if self.answer.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            hit = held is not None
            if not hit and not pd.isna(r.lat):
                held = (float(r.lat), float(r.lon))
                self.answer.update(held)
            out.append((key[0], r.seq, hit, *(held or (None, None))))
        yield pd.DataFrame(out, columns=["key", "seq", "hit", "lat", "lon"]).astype({"lat": float, "lon": float})

    def close(self) -> None:
        pass


def geocode_stream(rows: DataFrame, hours: float = 24.0) -> DataFrame:
    """rows (key, seq, lat, lon; a stream) with `hit`: whether the key's answer was held. A row's own answer is held if none was, for `hours`."""
    return rows.groupBy("key").transformWithStateInPandas(GeocodeCache(hours), "key string, seq long, hit boolean, lat double, lon double", "append", "ProcessingTime")


def decided_in_order(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (url, level, price, seq) with `action` by the registry and by the rows of the same URL before them: the stored price is the least so far."""
    stored = registry.select("url", F.col("price").alias("_stored"))
    before = F.min("price").over(Window.partitionBy("url").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    own = rows.withColumn("url", F.coalesce("url", F.lit(""))).join(stored, "url", "left").withColumn("_before", before)
    return own.withColumn("action", alerts.action(F.col("url"), F.least("_stored", "_before"), F.col("price"))).drop("_stored", "_before")


class AlertSink:
    """Writes each micro-batch's alerts and the registry they lead to, under the batch's number in `folder`, which driver and executors share.

    A batch is decided against the registry of the batch before it, its alerts are written, and the next registry is made of those that were written. A
    batch that is repeated, after a failure at any point, writes the same under the same number, so nothing comes twice; readers take the batches up
    to the last registry. `sent` tells which alerts of a batch went out (by default all): the others leave no trace in the registry.
    """

    def __init__(self, spark: SparkSession, folder: str, now: Callable[[int], dt.datetime], sent: Callable[[DataFrame], DataFrame] = lambda alerts: alerts):
        self.spark, self.folder, self.now, self.sent = spark, folder, now, sent

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        if not there:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def registry(self, before: int | None = None) -> DataFrame:
        """The registry after the last batch, or the last one before a number."""
        found = self._read("registry", ENTRY)
        found = found.where(F.col("batch") < before) if before is not None else found
        last = found.agg(F.max("batch")).first()[0]  # read from the folders' names
        return found.where(F.col("batch") == (-1 if last is None else last)).drop("batch")

    def alerts(self) -> DataFrame:
        """All alerts of whole batches, with their batch."""
        whole = self._read("registry", ENTRY).agg(F.max("batch")).first()[0]
        return self._read("alerts", "url string, level string, price double, seq long, action string").where(F.col("batch") <= (-1 if whole is None else whole))

    def __call__(self, batch: DataFrame, number: int) -> None:
        held = self.registry(number)
        decided = decided_in_order(batch.select("url", "level", F.col("price").cast("double").alias("price"), F.col("seq").cast("long").alias("seq")), held)
        to = f"{self.folder}/alerts/batch={number}"
        self.sent(decided.where("action != 'skip'")).select("url", "level", "price", "seq", "action").write.mode("overwrite").parquet(to)
        written = self.spark.read.schema("url string, level string, price double, seq long, action string").parquet(to)
        after = alerts.updated_registry(written, held.select("url", "level", "price", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_sent", "last_sent"))), self.now(number))
        after.select("url", "level", "price", *(F.col(c).cast("timestamp").alias(c) for c in ("first_sent", "last_sent"))).write.mode("overwrite").parquet(f"{self.folder}/registry/batch={number}")

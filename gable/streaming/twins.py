"""Streaming twins of the stateful operators: alert decisions, first occurrences, freshness by day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISION = "url string, price double, seq long, action string"


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Per URL: the first is new, a price below the stored one a drop (which is stored), anything else a skip."""
    stored = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq")
    if not key[0]:  # never registered
        yield pd.DataFrame({"url": key[0], "price": rows["price"], "seq": rows["seq"], "action": "new"})
        return
    out = []
    for price, seq in zip(rows["price"], rows["seq"]):
        said = "new" if stored is None else "drop" if price < stored else "skip"
        if said != "skip":
            stored = float(price)
        out.append((key[0], float(price), int(seq), said))
    state.update((stored,))
    yield pd.DataFrame(out, columns=["url", "price", "seq", "action"])


def alert_decisions(listings: DataFrame) -> DataFrame:
    """listings: url, price, seq (a stream). The state of a URL is one price."""
    return listings.groupBy("url").applyInPandasWithState(_decide, DECISION, "price double", "append", "NoTimeout")


def _decide_within(days: int):
    span = days * 86_400_000

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """As _decide, but an entry ends when its first alert is over `days` old: the next listing is new again."""
        if state.hasTimedOut:
            state.remove()
            return
        stored, first = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        out = []
        for price, seq, at in zip(rows["price"], rows["seq"], rows["at"].astype("datetime64[ms]").astype("int64")):
            known = bool(key[0]) and first is not None and at - first <= span
            said = "new" if not known else "drop" if price < stored else "skip"
            if not known:
                first = int(at)
            if said != "skip":
                stored = float(price)
            out.append((key[0], float(price), int(seq), said))
        if key[0]:
            state.update((stored, first))
            state.setTimeoutTimestamp(max(first + span, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["url", "price", "seq", "action"])

    return decide


def expiring_decisions(listings: DataFrame, days: int, delay: str = "1 day") -> DataFrame:
    """listings: url, price, seq, at (a stream). The state of a URL is a price and the time of its first alert; it goes once the watermark is `days` past that.

    Listings later than the watermark allows are not decided; a listing without a URL is always new.
    """
    own = listings.withWatermark("at", delay)
    return own.groupBy("url").applyInPandasWithState(_decide_within(days), DECISION, "price double, first long", "append", "EventTimeTimeout")


def first_occurrences(rows: DataFrame, key: str, at: str, within: str) -> DataFrame:
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def daily_freshness(log: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """Runs and new listings by day, once a day's window is past the watermark."""
    return log.withWatermark(at, delay).groupBy(F.window(at, "24 hours")).agg(F.count("*").alias("runs"), F.sum("fresh").alias("fresh"))

"""Checks over the log of runs: streaks of failures, parsing rate, freshness, budgets, and the report of all."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HealthConfig


def failed(errors: Column, scraped: Column) -> Column:
    return (errors > 0) & (scraped == 0)


def source_status(log: DataFrame, sources: DataFrame, config: HealthConfig = HealthConfig()) -> DataFrame:
    """streaks of every source that there should be (source), with a message: one without a log is a warning."""
    found = sources.select("source").distinct().join(streaks(log, config), "source", "left")
    failures, said = F.coalesce("failures", F.lit(0)), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    message = (
        F.when(F.col("runs").isNull(), said("Aucun log de scraping pour ", F.col("source"), "."))
        .when(F.col("status") == "critical", said("Source ", F.col("source"), " indisponible: ", failures.cast("string"), " echecs consecutifs."))
        .when(F.col("status") == "warning", said("Source ", F.col("source"), ": ", failures.cast("string"), " echec(s) recent(s).")).otherwise(said("Source ", F.col("source"), " operationnelle."))
    )
    return found.select("source", failures.alias("failures"), "last_success", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("status", F.lit("warning")).alias("status"), message.alias("message"))


def streaks(log: DataFrame, config: HealthConfig = HealthConfig()) -> DataFrame:
    """Failures of each source since its last success. log: source, at, id, scraped, errors.

    Two aggregations, the second against each source's last success: no source's log is ordered in one task.
    """
    good = ~failed(F.col("errors"), F.col("scraped"))
    last = log.groupBy("source").agg(F.max(F.when(good, F.struct("at", "id"))).alias("last"))
    own = log.join(last, "source")
    out = own.groupBy("source").agg(
        F.count_if(F.col("last").isNull() | (F.struct("at", "id") > F.col("last"))).alias("failures"), F.max("last")["at"].alias("last_success"), F.count("*").alias("runs")
    )
    return out.withColumn("status", F.when(F.col("failures") >= config.failures, "critical").when(F.col("failures") > 0, "warning").otherwise("ok"))


def parsing_rate(log: DataFrame, config: HealthConfig = HealthConfig()) -> DataFrame:
    low, fair = config.parse_rate
    out = log.agg(F.coalesce(F.sum("scraped"), F.lit(0)).alias("scraped"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
    rate = F.try_divide(F.col("scraped").cast("double"), F.col("scraped") + F.col("errors"))
    return out.withColumn("rate", rate).withColumn("status", F.when(rate.isNull(), "warning").when(rate < low, "critical").when(rate < fair, "warning").otherwise("ok"))


def freshness(log: DataFrame, as_of: dt.datetime, hours: int) -> DataFrame:
    since = F.lit(as_of - dt.timedelta(hours=hours)).cast("timestamp_ntz")
    out = log.where(F.col("at") >= since).agg(F.count("*").alias("runs"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("fresh"))
    return out.withColumn("status", F.when((F.col("runs") == 0) | (F.col("fresh") == 0), "critical").otherwise("ok"))


def budget(calls: Column, limit: int, config: HealthConfig = HealthConfig()) -> Column:
    if limit <= 0:
        return F.lit("critical")
    return F.when(calls >= limit, "critical").when(calls >= limit * config.budget, "warning").otherwise("ok")


def disk(free: Column, config: HealthConfig = HealthConfig()) -> Column:
    low, fair = config.disk
    return F.when(free < low, "critical").when(free < fair, "warning").otherwise("ok")


def checks(log: DataFrame, as_of: dt.datetime, calls: int, free: float, config: HealthConfig = HealthConfig()) -> DataFrame:
    """name and status of every check: each source, parsing, freshness, the day's calls against their limit, the free share of the disk."""
    since = F.lit(as_of - dt.timedelta(hours=24)).cast("timestamp_ntz")
    day = log.where(F.col("at") >= since).agg(F.count("*").alias("n"))
    own = streaks(log, config).select(F.concat(F.lit("source_"), "source").alias("name"), "status")
    for name, found in (
        ("parsing_rate", parsing_rate(log, config)), ("new_listings", freshness(log, as_of, config.fresh_hours)), ("api_budget", day.select(budget(F.col("n"), calls, config).alias("status"))),
        ("disk_space", log.sparkSession.range(1).select(disk(F.lit(free), config).alias("status"))),
    ):
        own = own.unionByName(found.select(F.lit(name).alias("name"), F.col("status")))
    return own


def report(checks: DataFrame) -> DataFrame:
    """The worst status, how many there are of each, and all of it as text. checks: name, status."""
    grade = F.when(F.col("status") == "critical", 2).when(F.col("status") == "warning", 1).otherwise(0)
    out = checks.agg(F.max(grade).alias("g"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warning", "critical")])
    out = out.select(F.when(F.col("g") == 2, "critical").when(F.col("g") == 1, "warning").otherwise("ok").alias("status"), "ok", "warning", "critical")
    return out.withColumn("summary", F.format_string("Sante globale: %s - %d OK, %d avertissement(s), %d critique(s).", F.upper("status"), "ok", "warning", "critical"))

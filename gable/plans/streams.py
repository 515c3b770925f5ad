"""Streaming queries, run to their end over the given tables; their checks are the batch results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RetentionConfig
from ..streaming import registry, twins
from . import views
from .registry import registrar

REGISTER: dict = {}
query = registrar(REGISTER)
C = F.col


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='gable-')}"
    return f"{shared}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input there is, written once."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("""WITH o AS (SELECT 'u' || (o_custkey % 500) AS url, o_totalprice AS price, o_orderkey AS seq FROM orders),
    r AS (SELECT *, min(price) OVER (PARTITION BY url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM o)
    SELECT url, price, seq, CASE WHEN stored IS NULL THEN 'new' WHEN price < stored THEN 'drop' ELSE 'skip' END AS action FROM r""")
def alert_state_stream(spark, sf_dir):
    own = stream(spark, sf_dir, "orders").select(F.concat(F.lit("u"), (C("o_custkey") % 500).cast("string")).alias("url"), C("o_totalprice").alias("price"), C("o_orderkey").alias("seq"))
    return drained(twins.alert_decisions(own))


@query("""WITH RECURSIVE o AS (SELECT 'u' || (o_custkey % 500) AS url, o_totalprice AS price, o_orderkey AS seq, o_orderdate AS t, row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
    r AS (SELECT url, price, seq, n, price AS stored, t AS began, 'new' AS action FROM o WHERE n = 1
      UNION ALL SELECT o.url, o.price, o.seq, o.n, CASE WHEN o.t > began + INTERVAL 60 DAY THEN o.price ELSE least(o.price, stored) END, CASE WHEN o.t > began + INTERVAL 60 DAY THEN o.t ELSE began END,
        CASE WHEN o.t > began + INTERVAL 60 DAY THEN 'new' WHEN o.price < stored THEN 'drop' ELSE 'skip' END FROM r JOIN o ON o.url = r.url AND o.n = r.n + 1)
    SELECT url, price, seq, action FROM r""")
def alert_expiry_stream(spark, sf_dir):
    own = stream(spark, sf_dir, "orders").select(F.concat(F.lit("u"), (C("o_custkey") % 500).cast("string")).alias("url"), C("o_totalprice").alias("price"), C("o_orderkey").alias("seq"), C("o_orderdate").cast("timestamp").alias("at"))
    return drained(twins.expiring_decisions(own, RetentionConfig().registry_days))


@query("SELECT DISTINCT event_id FROM events")
def dedup_watermark_stream(spark, sf_dir):
    own = stream(spark, sf_dir, "events").select("event_id", C("ts").cast("timestamp").alias("at"))
    return drained(twins.first_occurrences(own, "event_id", "at", "365 days").select("event_id"))


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS runs, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)::BIGINT AS fresh FROM events GROUP BY 1), m AS (SELECT max(ts) AS t FROM events)
    SELECT d.day AS day, runs, fresh FROM d, m WHERE d.day + INTERVAL 1 DAY <= m.t - INTERVAL 1 HOUR""")
def freshness_window_stream(spark, sf_dir):
    own = stream(spark, sf_dir, "events").select(C("ts").cast("timestamp").alias("at"), (C("event_type") == "signup").cast("long").alias("fresh"))
    return drained(twins.daily_freshness(own)).select(C("window.start").cast("timestamp_ntz").alias("day"), "runs", "fresh")


_LEVEL = "CASE o_orderkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'bon' ELSE 'veille' END"


def _alert_rows(spark: SparkSession, sf_dir: str, urls: int) -> DataFrame:
    level = F.when(C("o_orderkey") % 3 == 0, "top").when(C("o_orderkey") % 3 == 1, "bon").otherwise("veille")
    url = F.concat(F.lit("u"), (C("o_custkey") % urls).cast("string"))
    return stream(spark, sf_dir, "orders").select(url.alias("url"), level.alias("level"), C("o_totalprice").alias("price"), C("o_orderkey").alias("seq"), C("o_orderdate").cast("timestamp").alias("at"))


@query(f"""WITH o AS (SELECT 'u' || (o_custkey % 900) AS url, {_LEVEL} AS level, o_totalprice AS price, o_orderkey AS seq FROM orders),
    r AS (SELECT *, min(price) OVER (PARTITION BY url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM o)
    SELECT url, level, price, seq, CASE WHEN stored IS NULL THEN 'new' ELSE 'drop' END AS action FROM r WHERE stored IS NULL OR price < stored""")
def alert_sink_stream(spark, sf_dir):
    """Alerts of every order as a listing, as the sink has written them by batch."""
    return _sunk(spark, sf_dir).alerts().drop("batch")


@query(f"""WITH o AS (SELECT 'u' || (o_custkey % 900) AS url, {_LEVEL} AS level, o_totalprice AS price, o_orderkey AS seq FROM orders)
    SELECT url, arg_min(level, (price, seq)) AS level, min(price) AS price, TIMESTAMP '2001-12-01' AS first_sent, TIMESTAMP '2001-12-01' AS last_sent FROM o GROUP BY url""")
def alert_sink_registry(spark, sf_dir):
    """The registry that those alerts lead to: an alert for each URL's first price and for each lower one, the last and lowest of which is held."""
    out = _sunk(spark, sf_dir).registry()
    return out.withColumns({c: C(c).cast("timestamp_ntz") for c in ("first_sent", "last_sent")})


def _sunk(spark: SparkSession, sf_dir: str) -> registry.AlertSink:
    folder = _folder(spark)
    sink = registry.AlertSink(spark, f"{folder}/sink", lambda number: views.AS_OF)
    _alert_rows(spark, sf_dir, 900).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return sink

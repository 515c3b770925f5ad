"""The listing model on the given tables: DataFrames for the engine, and the same views as SQL text for the checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.datetime(2001, 12, 1)
LOG_AS_OF = dt.datetime(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales: one row for each order, its lines as rooms and their quantity as surface."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("surface"), F.count("*").alias("rooms"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows in every size
    own = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    own = own.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey")
    return own.select(
        key.alias("id"), F.col("o_totalprice").alias("price"), "surface", "rooms", F.col("n_name").alias("district"), F.col("o_orderstatus").alias("source"), F.col("o_orderdate").alias("published"),
        F.substring(F.lit("ABCDEFGX"), F.lit(1) + (key % 8).cast("int"), F.lit(1)).alias("energy"), F.col("o_custkey").alias("seller"),
        F.concat(F.lit("https://Ads.Example.org/v/"), (key % 5000).cast("string"), F.lit("/?b=2&utm_source=x&a="), (key % 3).cast("string"), F.lit("#top")).alias("url"),
        F.concat((key % 97).cast("string"), F.lit(" av. de la "), F.col("n_name"), F.lit(", 25"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(" Besançon")).alias("address"),
        F.concat(F.lit("Prix a debattre, "), F.lower("o_orderpriority"), F.when(key % 7 == 0, F.lit(" urgent succession honoraires agence")).otherwise(F.lit(" calme"))).alias("description"),
        (((F.col("c_nationkey") % 10) / F.lit(10.0))).alias("tension"), (F.lit(40.0) + F.col("c_nationkey") * 2).alias("appeal"),
    )


def rents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rentals: one row for each line item."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    own = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return own.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") / 20).alias("rent"), F.col("l_quantity").alias("surface"), (1 + F.col("l_linenumber") % 3).alias("rooms"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("furnished"), F.col("n_name").alias("district"), F.col("l_shipdate").alias("seen_at"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")).alias("source"), F.col("ts").alias("at"),
        F.when(kind == "error", 0).otherwise(1).alias("scraped"), F.when(kind == "error", 1).otherwise(0).alias("errors"), F.when(kind == "signup", 1).otherwise(0).alias("fresh"), "value",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (47.24 + F.element_at(e, 1).cast("double") * 0.05).alias("lat"), (6.02 + F.element_at(e, 2).cast("double") * 0.05).alias("lon"),
    )


SQL = {
    "listings": """
        SELECT o_orderkey AS id, o_totalprice AS price, surface, rooms, n_name AS district, o_orderstatus AS source, o_orderdate AS published,
               substr('ABCDEFGX', 1 + CAST(o_orderkey % 8 AS INTEGER), 1) AS energy, o_custkey AS seller,
               'https://Ads.Example.org/v/' || (o_orderkey % 5000) || '/?b=2&utm_source=x&a=' || (o_orderkey % 3) || '#top' AS url,
               (o_orderkey % 97) || ' av. de la ' || n_name || ', 25' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' Besançon' AS address,
               'Prix a debattre, ' || lower(o_orderpriority) || CASE WHEN o_orderkey % 7 = 0 THEN ' urgent succession honoraires agence' ELSE ' calme' END AS description,
               (c_nationkey % 10) / 10.0::DOUBLE AS tension, 40.0::DOUBLE + c_nationkey * 2 AS appeal
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS surface, count(*) AS rooms FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "rents": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice / 20 AS rent, l_quantity AS surface, 1 + l_linenumber % 3 AS rooms,
               CASE WHEN l_returnflag = 'A' THEN true WHEN l_returnflag = 'R' THEN false END AS furnished, n_name AS district, l_shipdate AS seen_at
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "run_log": """
        SELECT event_id AS id, 'src' || (user_id % 3) AS source, ts AS "at", CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS scraped,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS fresh, value
        FROM events""",
    "points": """
        SELECT vec_id AS id, 47.24::DOUBLE + embedding[1]::DOUBLE * 0.05::DOUBLE AS lat, 6.02::DOUBLE + embedding[2]::DOUBLE * 0.05::DOUBLE AS lon FROM embeddings""",
}


def sql(body: str, *names: str) -> str:
    """The body with the named views before it, as common table expressions."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    return f"WITH {views}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"

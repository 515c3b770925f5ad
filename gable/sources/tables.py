"""Tables of the listing model at rest: schemas, atomic writes, partitioned logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "listings": "url string, source string, hash string, source_ids array<string>, price int, surface double, rooms int, energy string, floor int, address string, district string, place struct<lat:double,lon:double>, charges double, description string, photos array<string>, published timestamp_ntz, seen timestamp_ntz, modified timestamp_ntz, history array<struct<date:string,price:int>>, completeness double, status string",
    "scores": "url string, score double, yield double, yield_5 double, yield_10 double, yield_15 double, location double, energy double, negotiation double, vacancy double, regime string, rent double, reliability string, computed timestamp_ntz",
    "enrichments": "url string, signals array<string>, state string, equipment array<string>, red_flags array<string>, condo struct<lots:int,charges:double,lot_charges:double>, summary string, analysed timestamp_ntz",
    "districts": "district string, appeal double, profile string, tension double",
    "rents": "url string, source string, hash string, rent double, rent_bare double, surface double, rooms int, furnished boolean, district string, place struct<lat:double,lon:double>, energy string, published timestamp_ntz, seen timestamp_ntz",
    "rent_reference": "district string, kind string, furnished boolean, rent_median double, rent_q1 double, rent_q3 double, n long, reliability string, rent_m2_median double, computed timestamp_ntz",
    "alerts": "url string, channel string, level string, sent timestamp_ntz",
    "runs": "source string, kind string, at timestamp_ntz, scraped int, fresh int, errors int, seconds double, detail string",
    "rejects": "url string, source string, reason string, payload string, at timestamp_ntz",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def append(df: DataFrame, folder: str, name: str, by: str | None = None) -> None:
    """Add a batch in one write; the committer makes it visible as a whole."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")


def replace(df: DataFrame, folder: str, name: str) -> None:
    """Write the next version of a table beside the current one, then the caller reads that."""
    df.write.mode("errorifexists").parquet(f"{folder}/{name}")

"""Queries of yields and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ScoreConfig
from ..functions import finance, text
from ..operators import history
from . import views
from .expressions import _hits
from .registry import registrar

REGISTER: dict = {}
query = registrar(REGISTER)
C = F.col
_RENT = "(400.0::DOUBLE + id % 500)"


def _rent():
    return F.lit(400.0) + C("id") % 500


@query(views.sql(f"SELECT id, " + ", ".join(f"round({_RENT} * 12.0::DOUBLE * 100.0::DOUBLE / (CASE WHEN price > 0 THEN price END * {1 - d / 100}::DOUBLE), 4) AS yield_{d}" for d in finance.DISCOUNTS) + " FROM listings", "listings"))
def yield_scenarios(spark, sf_dir):
    """Of every listing; a price that isn't positive has no yield."""
    return views.listings(spark, sf_dir).select("id", *[F.round(finance.gross_yield(C("price"), _rent(), d), 4).alias(f"yield_{d}") for d in finance.DISCOUNTS])


@query(views.sql(f"SELECT id, CASE WHEN id % 9 = 0 THEN 0.0::DOUBLE ELSE round({_RENT} * 1200.0::DOUBLE / price, 4) END AS simple FROM listings", "listings"))
def yield_simple(spark, sf_dir):
    price = F.when(C("id") % 9 == 0, F.lit(0.0)).otherwise(C("price"))
    return views.listings(spark, sf_dir).select("id", F.round(finance.simple_yield(price, _rent()), 4).alias("simple"))


@query(views.sql(f"SELECT id, {_RENT} * 6 AS furnished_taxable, round({_RENT} * 12 * 0.7::DOUBLE, 4) AS bare_taxable, 'lmnp' AS regime, round({_RENT} * 12 * 0.7::DOUBLE - {_RENT} * 6, 4) AS saving, surface AS charges FROM listings", "listings"))
def fiscal_compare(spark, sf_dir):
    parts = finance.fiscal(_rent() * 12, C("surface"))
    return views.listings(spark, sf_dir).select("id", *[(F.round(c, 4) if k in ("bare_taxable", "saving") else c).alias(k) for k, c in parts.items()])


_ENERGY = "CASE energy WHEN 'A' THEN 100.0::DOUBLE WHEN 'B' THEN 85 WHEN 'C' THEN 65 WHEN 'D' THEN 40 WHEN 'E' THEN 0 WHEN 'F' THEN 0 WHEN 'G' THEN 0 ELSE 30 END"
_VACANCY = "CASE WHEN tension >= 0.8::DOUBLE THEN 90.0::DOUBLE WHEN tension >= 0.5::DOUBLE THEN 60 ELSE 30 END"


@query(views.sql(f"SELECT energy, CAST({_ENERGY} AS DOUBLE) AS score, count(*) AS n FROM listings GROUP BY ALL", "listings"))
def energy_score(spark, sf_dir):
    return views.listings(spark, sf_dir).groupBy("energy", finance.energy_score(C("energy")).alias("score")).agg(F.count("*").alias("n"))


@query(views.sql(f"SELECT id, tension, CAST({_VACANCY} AS DOUBLE) AS score FROM listings", "listings"))
def vacancy_score(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", "tension", finance.vacancy_score(C("tension")).alias("score"))


def histories(spark, sf_dir) -> DataFrame:
    """The changes of price over each seller's listings in order of date."""
    return history.changes(views.table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice").withColumnRenamed("o_custkey", "seller")


_LAG = "SELECT o_custkey AS seller, o_totalprice AS price, lag(o_totalprice) OVER w AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT seller, coalesce(bool_or(price < before), false) AS any_drop, coalesce(bool_or(price < before AND before > 0) FILTER (WHERE back = 1), false) AS last_drop FROM ({_LAG}) GROUP BY 1")
def price_history_drops(spark, sf_dir):
    return histories(spark, sf_dir).select("seller", "any_drop", "last_drop")


@query(f"SELECT seller, round(before, 2) AS old_price, round(price, 2) AS new_price, round(price - before, 2) AS diff, round((price - before) * 100.0::DOUBLE / before, 4) AS pct FROM ({_LAG}) WHERE back = 1 AND price < before AND before > 0")
def price_drops(spark, sf_dir):
    own = histories(spark, sf_dir).where("last_drop")
    diff, pct = finance.price_change(C("before"), C("last"))
    return own.select("seller", F.round("before", 2).alias("old_price"), F.round("last", 2).alias("new_price"), F.round(diff, 2).alias("diff"), F.round(pct, 4).alias("pct"))


_NEGOTIATION = f"least({_hits('description', ScoreConfig().signals)}, 2) * 15.0::DOUBLE + CASE WHEN id % 4 = 0 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END"


def _negotiation():
    return finance.negotiation_score(text.contains_count(C("description"), ScoreConfig().signals), C("id") % 4 == 0)


@query(views.sql(f"SELECT id, {_NEGOTIATION} AS score FROM listings", "listings"))
def negotiation_score(spark, sf_dir):
    return views.listings(spark, sf_dir).select("id", _negotiation().alias("score"))


_YIELD = f"({_RENT} * 12.0::DOUBLE * 100.0::DOUBLE / price)"
_SCORED = f"""scored AS (SELECT id, district, price, surface, {_YIELD} AS y, {_YIELD} / 0.85::DOUBLE AS best, (CASE WHEN {_YIELD} <= 4 THEN 0.0::DOUBLE WHEN {_YIELD} >= 12 THEN 100 ELSE ({_YIELD} - 4) / 8 * 100 END) * 0.4::DOUBLE
    + appeal * 0.25::DOUBLE + ({_ENERGY}) * 0.15::DOUBLE + ({_NEGOTIATION}) * 0.1::DOUBLE + ({_VACANCY}) * 0.1::DOUBLE AS score FROM listings WHERE price > 0),
    graded AS (SELECT *, CASE WHEN score >= 80 OR y >= 8 THEN 'top' WHEN score >= 60 OR best >= 8 THEN 'bon' ELSE 'veille' END AS level FROM scored)"""


def graded(spark, sf_dir) -> DataFrame:
    """Listings with yield, score and level."""
    own = views.listings(spark, sf_dir).where("price > 0")
    own = own.withColumn("y", finance.gross_yield(C("price"), _rent())).withColumn("best", finance.gross_yield(C("price"), _rent(), 15))
    parts = {"yield": finance.yield_score(C("y")), "location": C("appeal"), "energy": finance.energy_score(C("energy")), "negotiation": _negotiation(), "vacancy": finance.vacancy_score(C("tension"))}
    own = own.withColumn("score", finance.composite(parts))
    return own.withColumn("level", finance.alert_level(C("score"), C("y"), C("best")))


@query(views.sql(f"WITH {_SCORED} SELECT id, round(y, 4) AS yield, round(score, 4) AS score FROM graded", "listings"))
def composite_score(spark, sf_dir):
    return graded(spark, sf_dir).select("id", F.round("y", 4).alias("yield"), F.round("score", 4).alias("score"))


@query(views.sql(f"WITH {_SCORED} SELECT id, level FROM graded", "listings"))
def alert_level(spark, sf_dir):
    return graded(spark, sf_dir).select("id", "level")

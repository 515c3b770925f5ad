"""Queries of the rent observatory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import dates
from ..operators import observatory as obs
from . import views
from .registry import registrar

REGISTER: dict = {}
query = registrar(REGISTER)
C = F.col

_SEG = "seg AS (SELECT *, 'T' || rooms AS kind FROM rents WHERE district IS NOT NULL AND rooms IS NOT NULL AND furnished IS NOT NULL AND rent IS NOT NULL)"
_KEPT = f"""{_SEG}, q AS (SELECT district, kind, furnished, count(*) AS n_all, quantile_cont(rent, 0.25) AS q1, quantile_cont(rent, 0.75) AS q3 FROM seg GROUP BY ALL),
  kept AS (SELECT seg.* FROM seg JOIN q USING (district, kind, furnished) WHERE n_all < 4 OR q3 = q1 OR rent BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)),
  weighed AS (SELECT *, rent / surface AS rent_m2, coalesce(pow(2.0::DOUBLE, -greatest(date_diff('second', seen_at, TIMESTAMP '2001-12-01') / 86400.0::DOUBLE, 0) / 30.0::DOUBLE), 0.5) AS w FROM kept)"""
_MEDIANS = f"""{_KEPT}, run AS (SELECT *, sum(w) OVER (s ORDER BY rent) AS r1, sum(w) OVER (s ORDER BY rent_m2) AS r2, sum(w) OVER s AS total FROM weighed WINDOW s AS (PARTITION BY district, kind, furnished)),
  reference AS (SELECT district, kind, furnished, min(CASE WHEN r1 >= total / 2 THEN rent END) AS rent_median, quantile_cont(rent, 0.25) AS rent_q1, quantile_cont(rent, 0.75) AS rent_q3,
    min(CASE WHEN r2 >= total / 2 THEN rent_m2 END) AS rent_m2_median, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'fiable' ELSE 'preliminaire' END AS reliability FROM run GROUP BY ALL)"""
_ROUNDED = "round({0}, 6) AS {0}"


def reference(spark: SparkSession, sf_dir: str, per_m2: bool = True) -> DataFrame:
    return obs.medians(views.rents(spark, sf_dir), views.AS_OF, per_m2=per_m2)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query(views.sql(f"WITH {_MEDIANS} SELECT district, kind, furnished, {', '.join(_ROUNDED.format(c) for c in ('rent_median', 'rent_q1', 'rent_q3', 'rent_m2_median'))}, n, reliability FROM reference", "rents"))
def segment_rent_medians(spark, sf_dir):
    return rounded(reference(spark, sf_dir), "rent_median", "rent_q1", "rent_q3", "rent_m2_median")


@query(views.sql(f"WITH {_SEG} SELECT district, kind, furnished, count(*) AS n FROM seg GROUP BY ALL", "rents"))
def rent_segments(spark, sf_dir):
    return obs.segments(views.rents(spark, sf_dir)).groupBy(*obs.SEGMENT).agg(F.count("*").alias("n"))


@query(views.sql(f"WITH {_SEG} SELECT district, kind, furnished, count(*) AS n_all, round(quantile_cont(rent, 0.25), 6) AS q1, round(quantile_cont(rent, 0.75), 6) AS q3 FROM seg GROUP BY ALL", "rents"))
def rent_quartiles(spark, sf_dir):
    return rounded(obs.quartiles(obs.segments(views.rents(spark, sf_dir))), "q1", "q3")


@query(views.sql(f"WITH {_KEPT} SELECT district, kind, furnished, count(*) AS kept, round(min(rent), 4) AS low, round(max(rent), 4) AS high FROM kept GROUP BY ALL", "rents"))
def iqr_filter(spark, sf_dir):
    kept = obs.without_outliers(obs.segments(views.rents(spark, sf_dir)))
    return kept.groupBy(*obs.SEGMENT).agg(F.count("*").alias("kept"), F.round(F.min("rent"), 4).alias("low"), F.round(F.max("rent"), 4).alias("high"))


@query(views.sql("""SELECT id, round(CASE WHEN id % 11 = 0 THEN 0.5::DOUBLE ELSE pow(2.0::DOUBLE, -greatest(date_diff('second', seen_at, TIMESTAMP '2001-12-01') / 86400.0::DOUBLE, 0) / 30.0::DOUBLE) END, 6) AS weight FROM rents""", "rents"))
def decay_weights(spark, sf_dir):
    at = F.when(C("id") % 11 != 0, C("seen_at"))
    return views.rents(spark, sf_dir).select("id", F.round(dates.decay(at, views.AS_OF, 30.0, 0.5), 6).alias("weight"))


@query(views.sql(f"""WITH {_SEG}, run AS (SELECT *, sum(surface) OVER (s ORDER BY rent) AS r, sum(surface) OVER s AS total FROM seg WINDOW s AS (PARTITION BY district, kind, furnished))
    SELECT district, kind, furnished, round(min(CASE WHEN r >= total / 2 THEN rent END), 6) AS middle FROM run GROUP BY ALL""", "rents"))
def weighted_median(spark, sf_dir):
    return rounded(obs.weighted_median(obs.segments(views.rents(spark, sf_dir)), "rent", "surface", "middle"), "middle")


@query(views.sql(f"WITH {_MEDIANS} SELECT count(*) AS segments, count(*) FILTER (WHERE n >= 5) AS reliable, CAST(round(100.0 * count(*) FILTER (WHERE n >= 5) / count(*)) AS INTEGER) || '% fiable (' || count(*) FILTER (WHERE n >= 5) || '/' || count(*) || ')' AS summary FROM reference", "rents"))
def observatory_coverage(spark, sf_dir):
    return obs.coverage(reference(spark, sf_dir, False))


def _named(spark, sf_dir) -> DataFrame:
    """Listings whose district is spelt as in the list, in part, or not at all."""
    k = C("id") % 5
    name = F.when(k == 0, "Battant").when(k == 1, "planoise").when(k == 2, "Quartier Velotte sud").when(k == 3, F.lit(None).cast("string")).otherwise(C("district"))
    own = views.listings(spark, sf_dir).withColumn("district", name)
    return own.withColumn("kind", F.concat(F.lit("T"), C("rooms").cast("string"))).withColumn("furnished", C("id") % 2 == 0)


_MATCHED = "CASE id % 5 WHEN 0 THEN 'Battant' WHEN 1 THEN 'Planoise - Châteaufarine' WHEN 2 THEN 'Velotte' ELSE 'Centre-Ville' END"


@query(views.sql(f"SELECT id, {_MATCHED} AS matched FROM listings", "listings"))
def match_district(spark, sf_dir):
    return obs.match_district(_named(spark, sf_dir), dims.districts(spark)).select("id", "matched")


def _values(rows) -> str:
    def lit(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_FALLBACK = "fallback(matched, kind, furnished, fallback) AS (VALUES " + _values([(d[0], f"T{t}", f, d[6 + 2 * (t - 1) + (0 if f else 1)]) for d in dims.DISTRICTS for t in (1, 2, 3) for f in (True, False)]) + ")"
_TYPICAL = "CASE kind WHEN 'T1' THEN 25.0::DOUBLE WHEN 'T2' THEN 45.0::DOUBLE WHEN 'T3' THEN 65.0::DOUBLE WHEN 'T4' THEN 85.0::DOUBLE WHEN 'T5' THEN 105.0::DOUBLE END"
_BASE = "coalesce(rent_median, fallback)"
_ADJUSTED = f"""coalesce(CASE WHEN surface > 0 AND {_TYPICAL} IS NOT NULL THEN {_BASE} * (1 + least(0.15::DOUBLE, greatest(-0.15::DOUBLE, CASE WHEN (surface - {_TYPICAL}) / {_TYPICAL} > 0.2::DOUBLE THEN (surface - {_TYPICAL}) / {_TYPICAL} - 0.2::DOUBLE
    WHEN (surface - {_TYPICAL}) / {_TYPICAL} < -0.2::DOUBLE THEN (surface - {_TYPICAL}) / {_TYPICAL} + 0.2::DOUBLE ELSE 0 END))) END, {_BASE})"""
_ASKED = f"""asked AS (SELECT id, surface, 'T' || rooms AS kind, id % 2 = 0 AS furnished, {_MATCHED} AS matched, CASE WHEN id % 5 = 4 THEN district END AS district FROM listings)"""


@query(views.sql(f"""WITH {_MEDIANS}, {_FALLBACK}, {_ASKED} SELECT id, CAST(format('{{:.2f}}', {_ADJUSTED}) AS DOUBLE) AS estimate,
    CASE WHEN rent_median IS NOT NULL THEN 'fiable' WHEN fallback IS NOT NULL THEN 'preliminaire' ELSE 'indisponible' END AS reliability
    FROM asked LEFT JOIN (SELECT district, kind, furnished, rent_median FROM reference WHERE n >= 5) r USING (district, kind, furnished) LEFT JOIN fallback f USING (matched, kind, furnished)""", "rents", "listings"))
def estimate_rent(spark, sf_dir):
    rows = obs.match_district(_named(spark, sf_dir), dims.districts(spark))
    out = obs.estimate(rows, reference(spark, sf_dir, False), dims.fallback_rents(spark))
    return out.select("id", "estimate", "reliability")

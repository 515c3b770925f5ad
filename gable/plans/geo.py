"""Queries of distances and location scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..config import GeoConfig
from ..functions import geo
from ..operators import spatial
from ..sources import layout
from . import streams, views
from .registry import registrar

REGISTER: dict = {}
query = registrar(REGISTER)
C = F.col


def _hav(lat: str, lon: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon}) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


@query(views.sql(f"SELECT id, round({_hav('lat', 'lon', '47.2378::DOUBLE', '6.0241::DOUBLE')}, 3) AS metres FROM points", "points"))
def haversine_pairs(spark, sf_dir):
    return views.points(spark, sf_dir).select("id", F.round(geo.haversine(C("lat"), C("lon"), F.lit(47.2378), F.lit(6.0241)), 3).alias("metres"))


_CENTRES = "centres(pos, district, clat, clon, appeal) AS (VALUES " + ", ".join(f"({i}, '{d[0]}', {d[4]}::DOUBLE, {d[5]}::DOUBLE, {d[1]}::DOUBLE)" for i, d in enumerate(dims.DISTRICTS)) + ")"


def nearest(rows):
    """rows with the nearest district centre in the radius, unrolled over the fixed list: no join."""
    near = [F.struct(geo.haversine(C("lat"), C("lon"), F.lit(d[4]), F.lit(d[5])).alias("m"), F.lit(i).alias("pos"), F.lit(d[0]).alias("district"), F.lit(d[1]).alias("appeal")) for i, d in enumerate(dims.DISTRICTS)]
    best = F.array_min(F.array(*near))
    return rows.withColumn("_b", best).withColumn("district", F.when(C("_b.m") <= GeoConfig().district_radius, C("_b.district"))).withColumn("appeal", F.when(C("_b.m") <= GeoConfig().district_radius, C("_b.appeal"))).drop("_b")


@query(views.sql(f"WITH {_CENTRES} SELECT id, min_by(district, (m, pos)) FILTER (WHERE m <= 2000) AS district FROM (SELECT id, pos, district, {_hav('lat', 'lon', 'clat', 'clon')} AS m FROM points, centres) GROUP BY id", "points"))
def nearest_district(spark, sf_dir):
    return nearest(views.points(spark, sf_dir)).select("id", "district")


def _best(kind: str) -> str:
    r = GeoConfig().radius[kind]
    return "greatest(0.0::DOUBLE, " + ", ".join(f"100 * (1 - {_hav('lat', 'lon', f'{a}::DOUBLE', f'{b}::DOUBLE')} / {r}::DOUBLE)" for a, b in dims.POINTS[kind]) + ")"


@query(views.sql("SELECT id, round(" + " + ".join(f"{_best(k)} * {w}::DOUBLE" for k, w in GeoConfig().weights.items() if k != "appeal") + " + 50.0::DOUBLE * 0.1::DOUBLE, 4) AS score FROM points", "points"))
def poi_location_score(spark, sf_dir):
    score = geo.location_score(C("lat"), C("lon"), dims.POINTS, F.lit(None).cast("double"))
    return views.points(spark, sf_dir).select("id", F.round(score, 4).alias("score"))


@query("SELECT n_name AS district, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 85.0::DOUBLE END, 50.0) AS appeal, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 0.85::DOUBLE END, 0.5) AS tension, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 'faible' END, 'moyen') AS risk FROM nation")
def district_attributes(spark, sf_dir):
    own = views.table(spark, sf_dir, "nation").withColumn("name", F.when(C("n_nationkey") % 4 == 0, "Centre-Ville").otherwise(C("n_name")))
    known = F.broadcast(dims.districts(spark).select(C("district").alias("name"), "appeal", "tension", "risk"))
    out = own.join(known, "name", "left")
    return out.select(C("n_name").alias("district"), F.coalesce("appeal", F.lit(50.0)).alias("appeal"), F.coalesce("tension", F.lit(0.5)).alias("tension"), F.coalesce("risk", F.lit("moyen")).alias("risk"))


@query(views.sql(f"""WITH p AS (SELECT id, arg_min(other, (m, other)) AS point, min(m) AS metres FROM (SELECT a.id, b.id AS other, {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM points a, points b WHERE b.id % 5 = 0 AND b.id <> a.id) WHERE m <= 700 GROUP BY 1)
    SELECT points.id, point, round(metres, 3) AS metres FROM points LEFT JOIN p USING (id)""", "points"))
def nearest_cells(spark, sf_dir):
    """The nearest other point of every fifth, within 700 metres, for every point."""
    own = views.points(spark, sf_dir)
    return spatial.nearest_point(own, own.where("id % 5 = 0"), "id", "id", 700.0, others=True).select("id", "point", F.round("metres", 3).alias("metres"))


@query(views.sql("SELECT id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM points WHERE lat BETWEEN 47.235 AND 47.245 AND lon > 6.02", "points"))
def clustered_points(spark, sf_dir):
    """Points of a box, from a table that is laid out by both coordinates."""
    path = f"{streams._folder(spark)}/points"
    layout.write_clustered(views.points(spark, sf_dir), path, ["lat", "lon"], 8)
    found = spark.read.schema("id long, lat double, lon double").parquet(path).where("lat between 47.235D and 47.245D and lon > 6.02D")
    return found.select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))

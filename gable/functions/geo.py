"""Distances and location scores, unrolled over small fixed sets of points: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GeoConfig


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, earth: float = GeoConfig().earth) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * earth * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def distance_score(metres: Column, limit: float) -> Column:
    """100 at no distance, 0 from the limit on."""
    return F.when(metres <= limit, 100 * (1 - metres / limit)).otherwise(F.lit(0.0)) if limit > 0 else F.lit(0.0)


def best_score(lat: Column, lon: Column, points: list[tuple[float, float]], limit: float) -> Column:
    return F.greatest(*[distance_score(haversine(lat, lon, F.lit(a), F.lit(b)), limit) for a, b in points], F.lit(0.0))


def location_score(lat: Column, lon: Column, points: dict[str, list[tuple[float, float]]], appeal: Column, config: GeoConfig = GeoConfig()) -> Column:
    total = sum((best_score(lat, lon, points[k], config.radius[k]) * w for k, w in config.weights.items() if k != "appeal"), F.lit(0.0))
    total = total + F.coalesce(appeal, F.lit(50.0)) * config.weights["appeal"]
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))

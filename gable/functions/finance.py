"""Yields, taxes, rents and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ObservatoryConfig, ScoreConfig

DISCOUNTS = (0, 5, 10, 15)


def gross_yield(price: Column, rent: Column, discount: int = 0) -> Column:
    """Percent a year; null where the price isn't positive or the rent is negative."""
    return F.when((price > 0) & (rent >= 0), F.try_divide(rent * 12.0 * 100.0, price * (1 - discount / 100.0)))


def simple_yield(price: Column, rent: Column) -> Column:
    return F.coalesce(F.when((price > 0) & (rent > 0), gross_yield(price, rent)), F.lit(0.0))


def fiscal(rent_year: Column, charges: Column) -> dict[str, Column]:
    """Taxable income of furnished (half off) and bare (30 % off) letting; the lower wins, the furnished one if equal."""
    furnished, bare = rent_year * 0.5, rent_year * 0.7
    return {
        "furnished_taxable": furnished, "bare_taxable": bare, "regime": F.when(furnished <= bare, F.lit("lmnp")).otherwise(F.lit("nu")),
        "saving": F.abs(bare - furnished), "charges": charges,
    }


def yield_score(y: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    lo, hi = config.yield_range
    return F.when(y <= lo, 0.0).when(y >= hi, 100.0).otherwise((y - lo) / (hi - lo) * 100.0)


def energy_score(letter: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    known = F.create_map(*[F.lit(x) for pair in config.energy.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(letter))), F.lit(config.energy_unknown))


def negotiation_score(signals: Column, dropped: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    points = F.least(signals, F.lit(config.max_signals)) * config.signal_points + F.when(dropped, config.drop_points).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), points))


def signals(in_text: Column, from_model: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    """Signals of negotiation: the larger of those in the text and those a model's answer (a list, or null) names, so none counts twice."""
    return F.greatest(F.least(in_text, F.lit(config.max_signals)), F.least(F.coalesce(F.size(F.coalesce(from_model, F.array().cast("array<string>"))), F.lit(0)), F.lit(config.max_signals)))


def contributions(parts: dict[str, Column], config: ScoreConfig = ScoreConfig()) -> Column:
    """What each part adds to the composite score."""
    return F.struct(*((parts[k] * w).alias(k) for k, w in config.weights.items()))


def vacancy_score(tension: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    high, mid = config.tension
    a, b, c = config.vacancy
    return F.when(tension.isNull(), b).when(tension >= high, a).when(tension >= mid, b).otherwise(c)


def composite(parts: dict[str, Column], config: ScoreConfig = ScoreConfig()) -> Column:
    total = sum((parts[k] * w for k, w in config.weights.items()), F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def alert_level(score: Column, y: Column, best_yield: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    return (
        F.when((score >= config.top[0]) | (y >= config.top[1]), F.lit("top"))
        .when((score >= config.good[0]) | (best_yield >= config.good[1]), F.lit("bon"))
        .otherwise(F.lit("veille"))
    )


def surface_adjusted(rent: Column, kind: Column, surface: Column, config: ObservatoryConfig = ObservatoryConfig()) -> Column:
    """The rent, moved by what the surface exceeds the dead zone around the typical one, at most by the cap; as it is where there is no surface."""
    typical = F.try_element_at(F.create_map(*[F.lit(x) for pair in config.typical_surface.items() for x in pair]), kind)
    off = F.when(surface > 0, (surface - typical) / typical)
    beyond = F.when(off > config.dead_zone, off - config.dead_zone).when(off < -config.dead_zone, off + config.dead_zone).when(off.isNotNull(), 0.0)
    # least() and greatest() skip nulls, so a rent without a typical surface is told apart first
    return F.when(beyond.isNull(), rent).otherwise(rent * (1 + F.least(F.lit(config.cap), F.greatest(F.lit(-config.cap), beyond))))


def any_drop(history: Column) -> Column:
    """Whether a price in an ordered history is below the one before it; missing prices count as 0."""
    p = F.transform(history, lambda x: F.coalesce(x, F.lit(0)))
    pairs = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: b < a)
    return F.when(F.size(history) >= 2, F.exists(pairs, lambda x: x)).otherwise(F.lit(False))


def last_drop(history: Column) -> Column:
    """Whether the last price is below the one before it, which must be positive."""
    a, b = F.try_element_at(history, F.lit(-2)), F.try_element_at(history, F.lit(-1))
    return F.coalesce((b < a) & (a > 0), F.lit(False))


def price_change(old: Column, new: Column) -> tuple[Column, Column]:
    return new - old, F.try_divide((new - old) * 100.0, old)

"""Rent statistics by segment (district, number of rooms, furnished), and rent estimates from them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ObservatoryConfig
from ..functions import dates, finance, text

SEGMENT = ["district", "kind", "furnished"]
#: Bins to each doubling in the histogram that order statistics are looked for in.
BINS = 256


def segments(rents: DataFrame) -> DataFrame:
    """Rents with their segment; rows that have none (no district, rooms, furnishing or rent) are left out."""
    own = rents.withColumn("kind", F.concat(F.lit("T"), F.col("rooms").cast("string")))
    return own.where("district is not null and rooms is not null and furnished is not null and rent is not null")


def order_statistics(rows: DataFrame, by: list[str], value: str, measures: dict[str, Column], wanted: dict[str, tuple[str, Callable[[Column], Column]]], bins: int = BINS) -> DataFrame:
    """Of each group: the totals of the measures (`all_` and the name), and for each wanted name (measure, target from its total) the smallest
    value up to which the measure's running sum reaches the target. Exact; null values don't count, a null in `by` is a group of its own.

    A histogram of each group's values, of `bins` to a doubling, is made in the map tasks and tells the bin that holds a target. Only the values of such bins are summed by value
    and put in order, a task for each bin: no group is ordered as a whole, and no task holds all its values, however many there are.
    """
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), *(m.alias(name) for name, m in measures.items()))
    own = own.withColumn("_bin", _bin(F.col("_v").cast("double"), bins))
    group = Window.partitionBy(*by)
    counted = own.groupBy(*by, "_bin").agg(*(F.sum(m).alias(m) for m in measures))
    # a row for each bin of a group
    counted = counted.withColumns({f"_run_{m}": F.sum(m).over(group.orderBy("_bin")) for m in measures} | {f"all_{m}": F.sum(m).over(group) for m in measures})
    target = {name: of(F.col(f"all_{m}")) for name, (m, of) in wanted.items()}
    first = [
        F.min(F.when(F.col(f"_run_{m}") >= target[name], F.struct(F.col("_bin").alias("bin"), (F.col(f"_run_{m}") - F.col(m)).alias("before")))).alias(f"_at_{name}") for name, (m, _) in wanted.items()
    ]
    totals = [f"all_{m}" for m in measures]
    places = counted.groupBy(*by).agg(*first, *(F.max(c).alias(c) for c in totals))
    places = places.select(*by, *totals, *(F.col(f"_at_{name}.{part}").alias(f"_{part}_{name}") for name in wanted for part in ("bin", "before")))
    inside = {name: F.col("_bin") == F.col(f"_bin_{name}") for name in wanted}
    held = _attach(own, places, by).where(reduce(Column.__or__, inside.values()))
    of_group = [c for c in places.columns if c not in by]
    held = held.groupBy(*by, "_bin", "_v").agg(*(F.sum(m).alias(m) for m in measures), *(F.first(c).alias(c) for c in of_group))
    held = held.withColumns({f"_run_{m}": F.sum(m).over(Window.partitionBy(*by, "_bin").orderBy("_v")) for m in measures})
    reached = {name: inside[name] & (F.col(f"_before_{name}") + F.col(f"_run_{m}") >= target[name]) for name, (m, _) in wanted.items()}
    # sums of fractions may miss the target by rounding at a bin's last value
    found = [F.coalesce(F.min(F.when(reached[name], F.col("_v"))), F.max(F.when(inside[name], F.col("_v")))).alias(name) for name in wanted]
    return held.groupBy(*by).agg(*found, *(F.max(c).alias(c) for c in totals))


def _bin(v: Column, bins: int) -> Column:
    """A number that doesn't fall as a double rises: `bins` to each doubling of its size, NaN last."""
    end, zero = 1 << 50, 1100 * bins
    size = F.floor(F.log2(F.abs(v)) * bins) + zero
    return F.when(F.isnan(v), end).when(v == float("inf"), end - 1).when(v == float("-inf"), 1 - end).when(v > 0, size).when(v < 0, -size).otherwise(0)


def _attach(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the other columns of groups, which has a row for each group."""
    own = groups.withColumnsRenamed({c: f"_of_{c}" for c in by})
    return rows.join(own, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by))).drop(*(f"_of_{c}" for c in by))


def _ends(wanted: dict[str, float]) -> dict[str, tuple[str, Callable[[Column], Column]]]:
    """The two ranks (from 1) that each quantile lies between, as targets of the measure n."""
    ends = (("low", F.floor), ("high", F.ceil))
    return {f"_{end}_{name}": ("n", lambda n, q=q, side=side: side((n - 1) * F.lit(q)) + 1) for name, q in wanted.items() for end, side in ends}


def _between(wanted: dict[str, float]) -> list[Column]:
    """The quantiles, interpolated between their two ranks' values."""
    place = {name: (F.col("all_n") - 1) * F.lit(q) for name, q in wanted.items()}
    low, high = (lambda name: F.col(f"_low_{name}")), (lambda name: F.col(f"_high_{name}"))
    return [F.when(F.floor(at) == F.ceil(at), low(name)).otherwise((F.ceil(at) - at) * low(name) + (at - F.floor(at)) * high(name)).alias(name) for name, at in place.items()]


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], n: str, bins: int = BINS) -> DataFrame:
    """Exact linear-interpolated quantiles (name: share) of each group's values and their number n; nulls don't count."""
    return order_statistics(rows, by, value, {"n": F.lit(1)}, _ends(wanted), bins).select(*by, *_between(wanted), F.col("all_n").alias(n))


def quartiles(rows: DataFrame, value: str = "rent") -> DataFrame:
    """Linear-interpolated quartiles of each segment."""
    return quantiles(rows, SEGMENT, value, {"q1": 0.25, "q3": 0.75}, "n_all")


def without_outliers(rows: DataFrame, config: ObservatoryConfig = ObservatoryConfig()) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles; all rows of segments of fewer than 4, or without spread."""
    own = rows.join(quartiles(rows), SEGMENT)
    spread = F.col("q3") - F.col("q1")
    keep = (F.col("n_all") < 4) | (spread == 0) | F.col("rent").between(F.col("q1") - config.iqr_factor * spread, F.col("q3") + config.iqr_factor * spread)
    return own.where(keep).drop("q1", "q3", "n_all")


def _half(total: Column) -> Column:
    return total / 2


def weighted_median(rows: DataFrame, value: str, weight: str, name: str, bins: int = BINS) -> DataFrame:
    """The lower weighted median of each segment."""
    return order_statistics(rows, SEGMENT, value, {"w": F.col(weight)}, {name: ("w", _half)}, bins).drop("all_w")


def medians(rents: DataFrame, as_of: dt.datetime, config: ObservatoryConfig = ObservatoryConfig(), per_m2: bool = True) -> DataFrame:
    """Every segment's weighted median, quartiles, rent per square metre (null unless per_m2), count and reliability."""
    kept = without_outliers(segments(rents), config)
    kept = kept.withColumn("w", dates.decay(F.col("seen_at"), as_of, config.half_life_days, config.unknown_weight))
    kept = kept.withColumn("rent_m2", F.when(F.col("surface") > 0, F.col("rent") / F.col("surface")))
    # rents and rents per square metre as values of one column: one histogram for both
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("stat"), F.col(k).alias("value")) for k in ("rent", "rent_m2")[: 1 + per_m2])))
    kept = kept.select(*SEGMENT, "w", values.alias("_s")).select(*SEGMENT, "w", "_s.stat", "_s.value")
    shares = {"q1": 0.25, "q3": 0.75}
    stats = order_statistics(kept, [*SEGMENT, "stat"], "value", {"n": F.lit(1), "w": F.col("w")}, {**_ends(shares), "median": ("w", _half)})
    stats = stats.select(*SEGMENT, "stat", "median", *_between(shares), F.col("all_n").alias("n"))
    of = lambda stat, c: F.max(F.when(F.col("stat") == stat, F.col(c)))
    out = stats.groupBy(*SEGMENT).agg(of("rent", "median").alias("rent_median"), of("rent", "q1").alias("rent_q1"), of("rent", "q3").alias("rent_q3"), of("rent_m2", "median").alias("rent_m2_median"), of("rent", "n").alias("n"))
    return out.withColumn("reliability", F.when(F.col("n") >= config.min_rows, "fiable").otherwise("preliminaire"))


def match_district(rows: DataFrame, districts: DataFrame, column: str = "district", default: str = "Centre-Ville") -> DataFrame:
    """rows with `matched`: the exact district, else the first one (by position) that contains the name or is in it, else the default.

    Distinct names are matched, not rows: they meet the fixed list of districts, and the result is joined back.
    """
    names = rows.select(F.col(column).alias("_name")).where(f"{column} is not null and {column} != ''").distinct()
    listed = F.broadcast(districts.select(F.col("district").alias("_d"), "pos"))
    low, other = F.lower("_name"), F.lower("_d")
    grade = F.when(F.col("_name") == F.col("_d"), 1).when(low.contains(other) | other.contains(low), 2)
    best = names.join(listed, grade.isNotNull()).groupBy("_name").agg(F.min_by("_d", F.struct(grade.alias("g"), "pos")).alias("_best"))
    return rows.join(best, rows[column] == best["_name"], "left").withColumn("matched", F.coalesce("_best", F.lit(default))).drop("_name", "_best")


def estimate(rows: DataFrame, reference: DataFrame, fallback: DataFrame, config: ObservatoryConfig = ObservatoryConfig()) -> DataFrame:
    """rows (district, kind, furnished, surface, matched) with `estimate` and `reliability`.

    A reference of enough rows gives its median, else the matched district its fallback rent; either is adjusted for the surface and rounded to two places.
    """
    ref = reference.where((F.col("n") >= config.min_rows) & F.col("rent_median").isNotNull()).select(*SEGMENT, "rent_median")
    fall = F.broadcast(fallback.select(F.col("district").alias("matched"), "kind", "furnished", "fallback"))
    own = rows.join(ref, SEGMENT, "left").join(fall, ["matched", "kind", "furnished"], "left")
    adjusted = finance.surface_adjusted(F.coalesce("rent_median", "fallback"), F.col("kind"), F.col("surface"), config)
    return own.withColumn("estimate", text.round_half_even(adjusted)).withColumn(
        "reliability", F.when(F.col("rent_median").isNotNull(), "fiable").when(F.col("fallback").isNotNull(), "preliminaire").otherwise("indisponible")
    )


def coverage(reference: DataFrame, min_rows: int = 5) -> DataFrame:
    """How many segments there are and are reliable, and as text."""
    out = reference.agg(F.count("*").alias("segments"), F.count_if(F.col("n") >= min_rows).alias("reliable"))
    share = F.try_divide(F.col("reliable") * 100, F.col("segments"))
    said = F.concat(F.round(share).cast("int").cast("string"), F.lit("% fiable ("), F.col("reliable").cast("string"), F.lit("/"), F.col("segments").cast("string"), F.lit(")"))
    return out.withColumn("summary", F.when(F.col("segments") > 0, said).otherwise("Aucune reference"))


def fallback_rent(median: Column, per_m2: Column, kind: Column, surface: Column, config: ObservatoryConfig = ObservatoryConfig()) -> tuple[Column, Column]:
    """Rent and reliability of a segment without enough rows: its stated median, adjusted; else its rent per square metre times the surface; else none."""
    rent = text.round_half_even(F.coalesce(finance.surface_adjusted(median, kind, surface, config), per_m2 * surface))
    return rent, F.when(rent.isNotNull(), F.lit("preliminaire")).otherwise(F.lit("indisponible"))

"""Validation: every reason a listing is rejected for, in a fixed order, as one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Bounds
from ..functions import text
from ..sources import listings
from .observatory import quantiles


def _range(c: Column, lo: float, hi: float, name: str) -> Column:
    return F.when(c.isNull(), f"{name} missing").when(c < lo, f"{name} low").when(c > hi, f"{name} high")


def in_city(address: Column, bounds: Bounds = Bounds()) -> Column:
    low = F.lower(address)
    named = F.lit(False)
    for n in bounds.city_names:
        named = named | low.contains(n)
    return F.coalesce(named | address.rlike(bounds.zip_pattern), F.lit(False))


def reasons(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def sale_reasons(price: Column, surface: Column, rooms: Column, energy: Column, url: Column, address: Column, bounds: Bounds = Bounds()) -> Column:
    return reasons(
        _range(price.cast("long"), *bounds.price, "price"), _range(surface, *bounds.surface, "surface"), _range(rooms.cast("long"), *bounds.rooms, "rooms"),
        F.when(energy.isNotNull() & ~energy.isin(*bounds.energy), "energy invalid"), F.when(~text.valid_url(url), "url invalid"), F.when(~in_city(address, bounds), "address outside"),
    )


def rent_reasons(rent: Column, surface: Column, rooms: Column, url: Column, address: Column, bounds: Bounds = Bounds()) -> Column:
    return reasons(
        _range(rent, *bounds.rent, "rent"), _range(surface, *bounds.surface, "surface"), _range(rooms.cast("long"), *bounds.rooms, "rooms"),
        F.when(~text.valid_url(url), "url invalid"), F.when(~in_city(address, bounds), "address outside"),
    )


def split(rows: DataFrame, found: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their reasons."""
    marked = rows.withColumn("reasons", found)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def reason_text(field: str, value: Column, bound: Column, below: Column) -> Column:
    """`prix trop bas (5000 < 10000)`."""
    return F.when(below, F.format_string(f"{field} trop bas (%s < %s)", value.cast("string"), bound.cast("string"))).otherwise(
        F.format_string(f"{field} trop eleve (%s > %s)", value.cast("string"), bound.cast("string"))
    )


def district_stats(rows: DataFrame, district: str, price: str, surface: str) -> DataFrame:
    """Exact median and sample deviation of the price per square metre of each district."""
    own = rows.select(F.col(district).alias("district"), F.try_divide(F.col(price), F.col(surface)).alias("_per"))
    stats = own.groupBy("district").agg(F.stddev_samp("_per").alias("sd_m2"), F.count("_per").alias("n"))
    middle = quantiles(own, ["district"], "_per", {"median_m2": 0.5}, "_n").select(F.col("district").alias("_d"), "median_m2")
    return stats.join(middle, stats["district"].eqNullSafe(middle["_d"]), "left").select("district", "median_m2", "sd_m2", "n")  # a row for each district


def anomalies(price: Column, surface: Column, rooms: Column, description: Column, median: Column, sd: Column, bounds: Bounds = Bounds()) -> Column:
    least = F.try_element_at(F.create_map(*[F.lit(x) for pair in bounds.min_surface_by_rooms.items() for x in pair]), rooms.cast("int"))
    return reasons(
        F.when((sd > 0) & (F.abs(F.try_divide(price, surface) - median) > 2 * sd), "price per m2"), F.when(surface < least, "surface for rooms"),
        F.when(text.contains_count(description, bounds.agency_words) >= bounds.agency_hits, "agency"),
    )


def _value_texts(field: str, kind: Column, number: Column, words: dict[str, str], low: float, high: float, whole: bool, positive: bool = True, name: str | None = None) -> Column:
    """What is wrong with a value: missing (no kind), of a type that is no number, not positive, below or above its bounds; the value stands in the text."""
    value = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)) if whole else number
    said, bound = (value.cast("long").cast("string"), lambda x: str(int(x))) if whole else (text.float_text(value), lambda x: str(float(x)))
    name = name or field
    out = F.when(kind.isNull(), f"{field} {words['missing']}").when(number.isNull(), F.concat(F.lit(f"{field} invalide (type "), kind, F.lit(")")))
    if positive:
        out = out.when(value <= 0, F.concat(F.lit(f"{name} {words['negative']} ("), said, F.lit(")")))
    out = out.when(value < low, F.concat(F.lit(f"{name} {words['low']} ("), said, F.lit(f" < {bound(low)})")))
    return out.when(value > high, F.concat(F.lit(f"{name} {words['high']} ("), said, F.lit(f" > {bound(high)})")))


# The words of the reasons.
_PRICE = {"missing": "manquant", "negative": "negatif ou nul", "low": "trop bas", "high": "trop eleve"}
_SURFACE = {"missing": "manquante", "negative": "negative ou nulle", "low": "trop petite", "high": "trop grande"}
_ROOMS = {"missing": "manquant", "low": "trop petit", "high": "trop grand"}


def url_text(url: Column) -> Column:
    return F.when(F.coalesce(text.strip(url), F.lit("")) == "", "url_source manquante ou vide").when(~text.valid_url(url), F.concat(F.lit("url_source invalide ("), url, F.lit(")")))


def address_text(address: Column, bounds: Bounds = Bounds()) -> Column:
    outside = F.concat(F.lit("adresse hors Besancon ('"), address, F.lit("' ne contient pas 'Besancon'/'Besançon' ni CP 25xxx)"))
    return F.when(F.coalesce(text.strip(address), F.lit("")) == "", "adresse manquante ou vide").when(~in_city(address, bounds), outside)


def _energy_text(energy: Column, bounds: Bounds) -> Column:
    return F.when(energy.isNotNull() & ~energy.isin(*bounds.energy), F.concat(F.lit("dpe invalide ('"), energy, F.lit("' hors A-G)")))


def _typed(raw: Column) -> tuple[Column, Column]:
    """Kind and number of a value that came as text: numbers in texts are read."""
    return F.when(raw.isNotNull(), "str"), raw.try_cast("double")


def sale_reason_texts(price: Column, surface: Column, rooms: Column, energy: Column, bounds: Bounds = Bounds()) -> Column:
    """Every reason in words, from values as they came (texts): types first, then bounds."""
    return reasons(
        _value_texts("prix", *_typed(price), _PRICE, *bounds.price, True), _value_texts("surface", *_typed(surface), _SURFACE, *bounds.surface, False),
        _value_texts("nb_pieces", *_typed(rooms), _ROOMS, *bounds.rooms, True, False), _energy_text(energy, bounds),
    )


def sale_variant_texts(price: Column, surface: Column, rooms: Column, energy: Column, url: Column, address: Column, bounds: Bounds = Bounds()) -> Column:
    """Every reason that a sale is rejected for, in words, from parsed JSON values (price, surface and rooms are variants): a text isn't a number."""
    kind, number = listings.variant_kind, listings.variant_number
    return reasons(
        _value_texts("prix", kind(price), number(price), _PRICE, *bounds.price, True), _value_texts("surface", kind(surface), number(surface), _SURFACE, *bounds.surface, False),
        _value_texts("nb_pieces", kind(rooms), number(rooms), _ROOMS, *bounds.rooms, True, False), _energy_text(energy, bounds), url_text(url), address_text(address, bounds),
    )


def rent_variant_texts(rent: Column, surface: Column, rooms: Column, url: Column, address: Column, bounds: Bounds = Bounds()) -> Column:
    """The same of a letting."""
    kind, number = listings.variant_kind, listings.variant_number
    return reasons(
        _value_texts("loyer_cc", kind(rent), number(rent), _PRICE, *bounds.rent, False, name="loyer"), _value_texts("surface", kind(surface), number(surface), _SURFACE, *bounds.surface, False),
        _value_texts("nb_pieces", kind(rooms), number(rooms), _ROOMS, *bounds.rooms, True, False), url_text(url), address_text(address, bounds),
    )

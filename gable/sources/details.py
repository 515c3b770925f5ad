"""Detail pages, the choice between what a page embeds and what it shows, overlays of listing and detail, and batch columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import listings

ADS = f"array<struct<{','.join(listings._fields(listings.AD))}>>"
#: Fields of a listing that make its detail page needless.
REQUIRED = ("url", "title", "price", "surface", "rooms", "address")
# What a label of a detail page says its value is; the first that fits counts.
LABELS = {
    "surface": ("surface",), "rooms": ("pièce", "piece"), "floor": ("étage", "etage"), "charges": ("charges",),
    "energy": ("ges", "énergie", "energie"), "furnished": ("meublé", "meuble"), "rent": ("loyer",),
}
_CRITERION = r'(?s)data-qa-id=.criteria_item_label.[^>]*>(.*?)</div>\s*<div[^>]*data-qa-id=.criteria_item_value.[^>]*>(.*?)</div>'


def embedded_ads(page: Column) -> Column:
    """The ads in a page's embedded JSON: the first of three paths that isn't empty; null where there is none or no JSON."""
    props = listings.embedded_json(page, f"props struct<pageProps:struct<searchData:struct<ads:{ADS}>,listingData:struct<ads:{ADS}>,ads:{ADS}>>")["props"]["pageProps"]
    return F.coalesce(*(F.when(F.size(a) > 0, a) for a in (props["searchData"]["ads"], props["listingData"]["ads"], props["ads"])))


def chosen_rows(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) with `rows` (url, price) and `embedded`: the embedded ads, else the links that the page shows."""
    ads = embedded_ads(F.col("html"))
    own = F.transform(ads, lambda a: F.struct(a["url"].alias("url"), F.try_element_at(a["price"], F.lit(1)).alias("price")))
    shown = F.transform(listings.links(F.col("html")), lambda a: F.struct(a["href"].alias("url"), F.lit(None).cast("int").alias("price")))
    return pages.withColumn("_own", own).select("page_id", F.coalesce("_own", shown).alias("rows"), F.col("_own").isNotNull().alias("embedded"))


def needs_detail(embedded: Column, *required: Column) -> Column:
    """Whether a listing's detail page must be read: always after links, else if a required field is null, empty or 0."""
    filled = F.lit(True)
    for c in required:
        filled = filled & ~F.coalesce(c.cast("string").isin("", "0", "0.0"), F.lit(True))
    return ~(F.coalesce(embedded, F.lit(False)) & filled)


def criteria(page: Column) -> Column:
    """Labels (lower case) and values of a detail page, in order."""
    labels, values = (F.regexp_extract_all(page, F.lit(_CRITERION), F.lit(i)) for i in (1, 2))
    return F.zip_with(labels, values, lambda a, b: F.struct(F.lower(F.trim(a)).alias("label"), F.trim(b).alias("value")))


def named(found: Column) -> Column:
    """Criteria with the name of the field that their label says, once for all fields: to be a column of its own before detail_fields reads it."""

    def field(label: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(LABELS.items()):
            hit = F.lit(False)
            for w in words:
                hit = hit | label.contains(w)
            out = F.when(hit, name).otherwise(out)
        return out

    return F.transform(found, lambda x: F.struct(field(x["label"]).alias("name"), x["value"].alias("value")))


def detail_fields(found: Column, letting: Column) -> dict[str, Column]:
    """Typed fields from named criteria. The first surface, rooms, energy letter and rent count, the last floor, charges and furnishing."""

    def value(name: str, last: bool = False) -> Column:
        return F.try_element_at(F.filter(found, lambda x: F.coalesce(x["name"] == name, F.lit(False))), F.lit(-1 if last else 1))["value"]

    letters = F.filter(F.transform(F.filter(found, lambda x: F.coalesce(x["name"] == "energy", F.lit(False))), lambda x: text.energy_strict(x["value"])), lambda x: x.isNotNull())
    return {
        "surface": text.surface_in_text(value("surface")), "rooms": text.first_int(value("rooms")), "floor": text.first_int(value("floor", True)), "charges": text.amount_last_separator(value("charges", True)),
        "energy": F.try_element_at(letters, F.lit(1)), "furnished": F.when(letting, F.lower(value("furnished", True)).isin("oui", "meublé", "meuble")), "rent": F.when(letting, text.amount_last_separator(value("rent"))),
    }


def overlay(rows: DataFrame, details: DataFrame, key: str, columns: list[str], present: str = "present") -> DataFrame:
    """rows with `columns` from their detail where it has them. details: key, columns, present (names of its keys: one with a null value wins, too)."""
    there = details.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns), F.col(present).alias("_present"))
    won = lambda c: F.coalesce(F.array_contains("_present", c), F.lit(False))
    return rows.join(there, key, "left").select(*(F.when(won(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def with_batch(rows: DataFrame, source: str, at: dt.datetime, url: str = "url") -> DataFrame:
    """rows with their source, the hash of their URL and the time of the batch."""
    return rows.withColumns({"source": F.lit(source), "hash": text.url_hash(F.col(url)), "batch_at": F.lit(at).cast("timestamp_ntz")})


def with_defaults(rows: DataFrame, status: str = "status", lists: tuple[str, ...] = ()) -> DataFrame:
    """A missing status is `nouveau`, a missing list is empty."""
    return rows.withColumns({status: F.coalesce(status, F.lit("nouveau"))} | {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in lists})


def listing_number(url: Column) -> Column:
    """The number of a listing in its URL: what follows the first or, after `ad`, the second part of the path."""
    return F.nullif(F.regexp_extract(url, r"https?://[^/]+/(?:ad/)?\w+/([0-9]+)", 1), F.lit(""))

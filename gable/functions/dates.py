"""Dates in listings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Names of months.
MONTHS = {
    "janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "août": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12,
}


def _at(c: Column, pattern: str, year: int, month: int, day: int) -> Column:
    parts = [F.regexp_extract(c, pattern, i) for i in (year, month, day)]
    return F.to_timestamp_ntz(F.try_to_date(F.concat_ws("-", F.lpad(parts[0], 4, "0"), F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd"))


def listing_date(c: Column, as_of: dt.date) -> Column:
    """A date as listings give it (today, yesterday, ISO, day first, month by name); null if it is none. as_of: the day read."""
    own = strip(c)
    low = F.lower(own)
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})"
    clock = F.regexp_extract(own, iso + r"T([0-9]{2}:[0-9]{2}:[0-9]{2})", 4)
    iso_at = F.try_to_timestamp(F.concat(F.regexp_extract(low, iso, 0), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    iso_date = F.when(clock != "", iso_at).otherwise(_at(low, iso, 1, 2, 3))  # a time that is none makes the whole none
    slash = _at(low, r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})", 3, 2, 1)
    named = r"(?U)^([0-9]{1,2})\s+(\w+)\s+([0-9]{4})"
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(months, F.regexp_extract(low, named, 2)).cast("string")
    by_name = F.to_timestamp_ntz(F.try_to_date(F.concat_ws("-", F.regexp_extract(low, named, 3), F.lpad(month, 2, "0"), F.lpad(F.regexp_extract(low, named, 1), 2, "0")), "yyyy-MM-dd"))
    return (
        F.when(low.isin("aujourd'hui", "aujourd hui", "aujourdhui"), F.lit(as_of).cast("timestamp_ntz"))
        .when(low == "hier", F.lit(as_of - dt.timedelta(days=1)).cast("timestamp_ntz"))
        .otherwise(F.coalesce(iso_date, slash, F.when(month.isNotNull(), by_name)))
    )


def decay(at: Column, as_of: dt.datetime, half_life: float, unknown: float) -> Column:
    """2^(-age / half life); an age in the future is 0, no date gives `unknown`."""
    days = F.greatest(F.timestamp_diff("SECOND", at, F.lit(as_of).cast("timestamp_ntz")) / F.lit(86400.0), F.lit(0.0))
    # greatest() skips nulls, so no date is told apart first
    return F.when(at.isNull(), F.lit(unknown)).otherwise(F.pow(F.lit(2.0), -days / half_life))

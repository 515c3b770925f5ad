"""Column expressions over raw listing text: numbers, addresses, URLs, HTML, messages. All stay in the JVM but for the decoding of HTML entities."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DedupConfig

# Street abbreviations and their long forms.
ABBREVIATIONS = {
    "r.": "rue", "r ": "rue ", "av.": "avenue", "av ": "avenue ", "bd.": "boulevard", "bd ": "boulevard ", "bld.": "boulevard", "bld ": "boulevard ",
    "pl.": "place", "pl ": "place ", "imp.": "impasse", "imp ": "impasse ", "all.": "allee", "all ": "allee ", "crs.": "cours", "crs ": "cours ",
    "fg.": "faubourg", "fg ": "faubourg ", "sq.": "square", "sq ": "square ", "rte.": "route", "rte ": "route ", "chem.": "chemin", "chem ": "chemin ",
    "pass.": "passage", "pass ": "passage ",
}
# Words that stay in lower case inside an address.
MINOR_WORDS = ("de", "du", "des", "le", "la", "les", "l", "d", "en")
# Accents, short street types and stop words of the address match key.
ACCENTS = ("éèêëàâäùûüîïôöç", "eeeeaaauuuiiooc")
SHORT_STREETS = {
    "avenue": "av", "boulevard": "bd", "place": "pl", "impasse": "imp", "allee": "al", "passage": "pass",
    "chemin": "ch", "route": "rte", "faubourg": "fg", "square": "sq", "cours": "crs",
}
STOP_WORDS = ("de", "du", "des", "le", "la", "les", "l", "d", "en", "au", "aux")
# What says that a dwelling is furnished.
FURNISHED_WORDS = (
    "meublé", "meuble", "meublée", "meublee", "équipé", "equipe", "équipée", "equipee", "furnished", "tout équipé",
    "tout equipe", "cuisine équipée", "cuisine equipee", "entièrement meublé", "entierement meuble",
)
FURNISHED_YES = ("true", "oui", "1", "meublé", "meuble", "meublée", "meublee")
FURNISHED_NO = ("false", "non", "0", "vide", "nu", "nue")
GROUND_FLOOR = ("rdc", "rez-de-chaussee", "rez-de-chaussée", "rez de chaussee", "rez de chaussée")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends, non-breaking space too."""
    return F.regexp_replace(c, r"(?U)^\s+|(?U)\s+$", "")


def digits_to_int(c: Column) -> Column:
    """All digits of a text as one number."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("int")


def surface_text(c: Column) -> Column:
    """A surface such as `42,5 m²`; null if it is no number."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"\s*(m²|m2|m)$", "")
    return F.regexp_replace(F.replace(bare, F.lit(","), F.lit(".")), r"\s", "").try_cast("double")


def surface_in_text(c: Column) -> Column:
    """The first number before an m."""
    return F.replace(F.regexp_extract(c, r"(?i)([0-9]+[.,]?[0-9]*)\s*m", 1), F.lit(","), F.lit(".")).try_cast("double")


def first_int(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


def energy_any(c: Column) -> Column:
    """The first letter from A to G anywhere."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(c)), "[A-G]", 0), F.lit(""))


def energy_strict(c: Column) -> Column:
    """A letter from A to G that ends the text and stands alone."""
    return F.nullif(F.upper(F.regexp_extract(strip(c), r"(?:^|[\s:])\s*([A-Ga-g])$", 1)), F.lit(""))


def floor_number(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*GROUND_FLOOR), F.lit(0)).otherwise(first_int(low))


def amount(c: Column) -> Column:
    """A number with a decimal comma or point; thousands points make it null."""
    return F.replace(F.regexp_replace(c, r"[€$\s]", ""), F.lit(","), F.lit(".")).try_cast("double")


def amount_last_separator(c: Column) -> Column:
    """A number whose last comma or point is the decimal point; all other signs are left out, a minus too."""
    bare = F.regexp_replace(c, r"[^0-9.,]", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"[.,][0-9]*$", ""), "[.,]", "")
    part = F.regexp_extract(bare, r"[.,]([0-9]*)$", 1)
    return F.concat(whole, F.lit("."), part).try_cast("double")


def _replaced(c: Column, words: dict[str, str], pattern: str) -> Column:
    """Each word's pattern in turn, only where the text holds the word: a text without it is not matched."""

    def step(word: str, other: str):
        return lambda t: F.when(t.contains(word), F.regexp_replace(t, pattern.format(word), other)).otherwise(t)

    out = F.array(c)
    for word, other in words.items():
        out = F.transform(out, step(word, other))
    return out[0]


def address_form(c: Column) -> Column:
    """An address in standard form: single spaces, street types in full, capitals but for minor words after the first."""
    out = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    out = _replaced(out, ABBREVIATIONS, r"((?<=[0-9]\s)|^)\Q{}\E")
    words = F.split(F.trim(F.regexp_replace(out, " +", " ")), " ")
    cased = F.transform(words, lambda w, i: F.when((i == 0) | ~w.isin(*MINOR_WORDS), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))).otherwise(w))
    return F.nullif(F.array_join(cased, " "), F.lit(""))


def address_key(c: Column) -> Column:
    """An address as a key for matching: no accents, short street types, no stop words, no punctuation."""
    out = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), *ACCENTS)
    out = _replaced(out, SHORT_STREETS, r"\b{}\b")
    kept = F.array_join(F.filter(F.split(out, r"\s+"), lambda w: ~w.isin(*STOP_WORDS)), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"(?U)[^\w\s]", ""), r"\s+", " "))


def url_parts(c: Column) -> dict[str, Column]:
    """Scheme, host, path and query of a URL by the pattern of RFC 3986; a missing part is empty. Never raises."""
    pattern = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    return {k: F.regexp_extract(F.trim(c), pattern, i + 1) for i, k in enumerate(("scheme", "host", "path", "query"))}


def canonical_url(c: Column, config: DedupConfig = DedupConfig()) -> Column:
    """Lower-case scheme and host, sorted query without tracking parameters, no fragment, no slash at the end of a path."""
    p = url_parts(c)
    kept = F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~F.lower(F.substring_index(q, "=", 1)).isin(*config.tracking))
    query = F.array_join(F.array_sort(kept), "&")
    path = F.when(p["path"] == "/", p["path"]).otherwise(F.regexp_replace(p["path"], "/+$", ""))
    return F.concat(F.lower(p["scheme"]), F.lit("://"), F.lower(p["host"]), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def url_hash(c: Column) -> Column:
    return F.sha2(canonical_url(c), 256)


def plain_url_hash(c: Column) -> Column:
    """The other hash: scheme, host and path as they are, the query left out."""
    p = url_parts(c)
    return F.sha2(F.concat(p["scheme"], F.lit("://"), p["host"], p["path"]), 256)


def valid_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\s*(?i:https?)://[^/?#]*\.[^/?#]*"), F.lit(False))


def with_page(c: Column, page: int) -> Column:
    """The URL with its page parameter set."""
    bare = F.regexp_replace(F.regexp_replace(c, r"([?&])page=[^&#]*", "$1"), r"[?&]+$", "")
    bare = F.replace(F.replace(bare, F.lit("?&"), F.lit("?")), F.lit("&&"), F.lit("&"))
    return F.concat(bare, F.when(bare.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit(f"page={page}"))


@F.pandas_udf(T.StringType())
def unescape_html(c: pd.Series) -> pd.Series:
    """Every named and numeric HTML entity as its characters: the rule and the table of over 2,000 names are those of HTML 5."""
    return c.map(lambda t: html.unescape(t) if t and "&" in t else t)


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _unescape_closed(t: str) -> str:
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), t)


@F.pandas_udf(T.StringType())
def unescape_closed_html(c: pd.Series) -> pd.Series:
    """As unescape_html, but only entities that end in a semicolon: `&amp` alone stays."""
    return c.map(lambda t: _unescape_closed(t) if t and "&" in t else t)


def html_text(c: Column, closed: bool = False) -> Column:
    """HTML as text: breaks are new lines, tags spaces, every entity decoded (with `closed` those that end in a semicolon), spaces collapsed; empty is null."""
    unescape = unescape_closed_html if closed else unescape_html
    out = unescape(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.nullif(strip(out), F.lit(""))


def contains_count(c: Column, words: tuple[str, ...]) -> Column:
    """How many of the words stand in the text, as parts of words too."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def furnished(flag: Column, *texts: Column) -> Column:
    """A stated flag; else true if a text says so; else null."""
    low = F.lower(F.trim(flag))
    said = [contains_count(t, FURNISHED_WORDS) > 0 for t in texts]
    return F.when(low.isin(*FURNISHED_YES), F.lit(True)).when(low.isin(*FURNISHED_NO), F.lit(False)).when(F.exists(F.array(*said), lambda x: x), F.lit(True))


def completeness(*fields: Column) -> Column:
    """Share of filled fields: blank texts don't count (pass arrays as null if empty)."""
    return round_half_even(sum((F.coalesce(strip(f.cast("string")) != "", F.lit(False)).cast("int") for f in fields), F.lit(0)) / len(fields))


def round_half_even(c: Column, places: int = 2) -> Column:
    """A double to some places (2 at most) by its exact binary value, halves to the even digit: the double nearest to the decimal that comes out.

    Beside a whole part the fraction has at most 52 bits, so a hundred times it is exact in a long.
    """
    unit = 10**places
    size = F.abs(c)
    whole = F.floor(size)
    bits = ((size - whole) * float(1 << 52)).cast("long") * unit
    parts, rest = F.shiftright(bits, 52), bits.bitwiseAND((1 << 52) - 1)
    up = (rest > 1 << 51) | ((rest == 1 << 51) & ((whole * unit + parts) % 2 == 1))
    return F.when(size < float(1 << 46), F.signum(c) * (whole * unit + parts + up.cast("int")) / float(unit)).otherwise(c)


def float_text(c: Column) -> Column:
    """A double as text, without an exponent below 10^16 (`5.0`, `12345678.25`)."""
    plain = F.regexp_replace(c.cast("decimal(38,9)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), plain).otherwise(c.cast("string"))


def money(c: Column) -> Column:
    """`145 000€`."""
    return F.concat(F.translate(F.format_number(c, 0), ",", " "), F.lit("€"))


def percent(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.1f%%", c))


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([_*\[\]()~`>#+\-=|{}.!\\])", r"\\$1")


def escape_markdown_once(c: Column) -> Column:
    """Escapes what isn't escaped yet; the signs of bold and of links stay."""
    return F.regexp_replace(c, r"(?<!\\)([_~`>#+\-=|{}.!])", r"\\$1")


def url_in_text(c: Column) -> Column:
    return F.rtrim(F.regexp_extract(c, r"(https?://\S+)", 1), F.lit(".,;:!?)"))


def mask_password(c: Column) -> Column:
    return F.regexp_replace(c, r"(://[^:/@]+):[^@/]+@", "$1:***@")


def join_filled(separator: str, *parts: Column) -> Column:
    return F.nullif(F.concat_ws(separator, *(F.nullif(F.trim(p), F.lit("")) for p in parts)), F.lit(""))

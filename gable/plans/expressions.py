"""Queries over raw listing text: cleaning, parsing, validation."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Bounds, ScoreConfig
from ..functions import dates, text
from ..operators import validation
from . import views
from .registry import registrar

REGISTER: dict = {}
query = registrar(REGISTER)
C = F.col

_RAW = """raw AS (SELECT id, price, surface, rooms,
      CASE id % 4 WHEN 0 THEN CAST(CAST(trunc(price) AS BIGINT) AS VARCHAR) || ' €' WHEN 1 THEN 'Prix: ' || CAST(CAST(trunc(price) AS BIGINT) AS VARCHAR) WHEN 2 THEN 'n/a' ELSE '' END AS price_text,
      CASE id % 5 WHEN 0 THEN CAST(CAST(surface AS BIGINT) AS VARCHAR) || ' m²' WHEN 1 THEN CAST(CAST(surface AS BIGINT) AS VARCHAR) || ',5m2' WHEN 2 THEN 'env ' || CAST(CAST(surface AS BIGINT) AS VARCHAR) || '.25 m carrez' WHEN 3 THEN 'grand' ELSE CAST(CAST(surface AS BIGINT) AS VARCHAR) || ' M' END AS surface_text,
      CASE id % 3 WHEN 0 THEN 'T' || rooms WHEN 1 THEN rooms || ' pièces' ELSE 'studio' END AS rooms_text,
      CASE id % 6 WHEN 0 THEN 'RDC' WHEN 1 THEN '1er' WHEN 2 THEN (id % 9) || 'ème étage' WHEN 3 THEN 'rez-de-chaussée' WHEN 4 THEN 'dernier' ELSE CAST(id % 7 AS VARCHAR) END AS floor_text,
      CASE id % 5 WHEN 0 THEN energy WHEN 1 THEN lower(energy) WHEN 2 THEN 'DPE: ' || energy WHEN 3 THEN 'NON COMMUNIQUE' ELSE '' END AS energy_text,
      CASE id % 5 WHEN 0 THEN '1.234,56 €' WHEN 1 THEN '1 500,5' WHEN 2 THEN '$ 99.' || (id % 90 + 10) WHEN 3 THEN '5-7 €' ELSE 'abc' END AS amount_text,
      CASE id % 8 WHEN 0 THEN CASE id % 3 WHEN 0 THEN 'Aujourd''hui' WHEN 1 THEN 'aujourd hui' ELSE 'Aujourdhui' END WHEN 1 THEN 'hier' WHEN 2 THEN strftime(published, '%Y-%m-%d') WHEN 3 THEN strftime(published, '%Y-%m-%d') || CASE WHEN id % 3 = 0 THEN 'T99:99:99' ELSE 'T10:20:30' END WHEN 4 THEN strftime(published, '%d/%m/%Y') WHEN 5 THEN day(published) || ' février ' || year(published) WHEN 6 THEN '31/02/2001' ELSE day(published) || ' Mars 1999 a midi' END AS date_text,
      published, address, description, url, district, energy, source FROM listings)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as text in the forms that sources use."""
    k, s, r, p = C("id"), C("surface").cast("long").cast("string"), C("rooms").cast("string"), C("price").cast("long").cast("string")
    day, year = F.day("published").cast("string"), F.year("published").cast("string")

    def pick(n: int, *values) -> F.Column:
        out = F.when(k % n == 0, values[0])
        for i, v in enumerate(values[1:-1]):
            out = out.when(k % n == i + 1, v)
        return out.otherwise(values[-1])

    iso = F.date_format("published", "yyyy-MM-dd")
    return views.listings(spark, sf_dir).withColumns({
        "price_text": pick(4, F.concat(p, F.lit(" €")), F.concat(F.lit("Prix: "), p), F.lit("n/a"), F.lit("")),
        "surface_text": pick(5, F.concat(s, F.lit(" m²")), F.concat(s, F.lit(",5m2")), F.concat(F.lit("env "), s, F.lit(".25 m carrez")), F.lit("grand"), F.concat(s, F.lit(" M"))),
        "rooms_text": pick(3, F.concat(F.lit("T"), r), F.concat(r, F.lit(" pièces")), F.lit("studio")),
        "floor_text": pick(6, F.lit("RDC"), F.lit("1er"), F.concat((k % 9).cast("string"), F.lit("ème étage")), F.lit("rez-de-chaussée"), F.lit("dernier"), (k % 7).cast("string")),
        "energy_text": pick(5, C("energy"), F.lower("energy"), F.concat(F.lit("DPE: "), C("energy")), F.lit("NON COMMUNIQUE"), F.lit("")),
        "amount_text": pick(5, F.lit("1.234,56 €"), F.lit("1 500,5"), F.concat(F.lit("$ 99."), (k % 90 + 10).cast("string")), F.lit("5-7 €"), F.lit("abc")),
        "date_text": pick(8, pick(3, F.lit("Aujourd'hui"), F.lit("aujourd hui"), F.lit("Aujourdhui")), F.lit("hier"), iso, F.concat(iso, F.when(k % 3 == 0, "T99:99:99").otherwise("T10:20:30")), F.date_format("published", "dd/MM/yyyy"), F.concat(day, F.lit(" février "), year), F.lit("31/02/2001"), F.concat(day, F.lit(" Mars 1999 a midi"))),
    })


def over_raw(select: str) -> str:
    return views.sql(f"WITH {_RAW} {select}", "listings")


@query(over_raw("SELECT id, TRY_CAST(regexp_replace(price_text, '[^0-9]', '', 'g') AS INTEGER) AS price_clean FROM raw"))
def clean_price_text(spark, sf_dir):
    return raw(spark, sf_dir).select("id", text.digits_to_int(C("price_text")).alias("price_clean"))


@query(over_raw(r"""SELECT id, TRY_CAST(replace(regexp_replace(lower(trim(surface_text)), '\s*(m²|m2|m)$', ''), ',', '.') AS DOUBLE) AS surface_clean,
    TRY_CAST(replace(regexp_extract(surface_text, '(?i)([0-9]+[.,]?[0-9]*)\s*m', 1), ',', '.') AS DOUBLE) AS surface_found FROM raw"""))
def clean_surface_text(spark, sf_dir):
    return raw(spark, sf_dir).select("id", text.surface_text(C("surface_text")).alias("surface_clean"), text.surface_in_text(C("surface_text")).alias("surface_found"))


@query(over_raw(r"""SELECT id, TRY_CAST(regexp_extract(rooms_text, '([0-9]+)', 1) AS INTEGER) AS rooms_found,
    CASE WHEN lower(trim(floor_text)) IN ('rdc', 'rez-de-chaussee', 'rez-de-chaussée', 'rez de chaussee', 'rez de chaussée') THEN 0 ELSE TRY_CAST(regexp_extract(floor_text, '([0-9]+)', 1) AS INTEGER) END AS floor,
    nullif(regexp_extract(upper(trim(energy_text)), '[A-G]'), '') AS energy_any, nullif(upper(regexp_extract(trim(energy_text), '(?:^|[\s:])\s*([A-Ga-g])$', 1)), '') AS energy_strict FROM raw"""))
def rooms_floor_energy(spark, sf_dir):
    return raw(spark, sf_dir).select(
        "id", text.first_int(C("rooms_text")).alias("rooms_found"), text.floor_number(C("floor_text")).alias("floor"),
        text.energy_any(C("energy_text")).alias("energy_any"), text.energy_strict(C("energy_text")).alias("energy_strict"),
    )


@query(over_raw(r"""SELECT id, TRY_CAST(replace(regexp_replace(amount_text, '[€$\s]', '', 'g'), ',', '.') AS DOUBLE) AS amount,
    TRY_CAST(CASE WHEN regexp_matches(bare, '[.,]') THEN regexp_replace(regexp_replace(bare, '[.,][0-9]*$', ''), '[.,]', '', 'g') || '.' || regexp_extract(bare, '[.,]([0-9]*)$', 1) ELSE bare || '.' END AS DOUBLE) AS amount_last
    FROM (SELECT *, regexp_replace(amount_text, '[^0-9.,]', '', 'g') AS bare FROM raw)"""))
def float_text(spark, sf_dir):
    return raw(spark, sf_dir).select("id", text.amount(C("amount_text")).alias("amount"), text.amount_last_separator(C("amount_text")).alias("amount_last"))


@query(over_raw(r"""SELECT id, CASE id % 8 WHEN 0 THEN TIMESTAMP '2001-12-01' WHEN 1 THEN TIMESTAMP '2001-11-30' WHEN 2 THEN date_trunc('day', published) WHEN 3 THEN CASE WHEN id % 3 <> 0 THEN date_trunc('day', published) + INTERVAL '10:20:30' HOUR TO SECOND END
    WHEN 4 THEN date_trunc('day', published) WHEN 5 THEN TRY_CAST(year(published) || '-02-' || lpad(CAST(day(published) AS VARCHAR), 2, '0') AS TIMESTAMP) WHEN 6 THEN NULL
    ELSE TRY_CAST('1999-03-' || lpad(CAST(day(published) AS VARCHAR), 2, '0') AS TIMESTAMP) END AS published_at FROM raw""".replace("INTERVAL '10:20:30' HOUR TO SECOND", "INTERVAL 37230 SECONDS")))
def french_dates(spark, sf_dir):
    return raw(spark, sf_dir).select("id", dates.listing_date(C("date_text"), views.AS_OF.date()).alias("published_at"))


_FILLED = "(CASE WHEN trim(coalesce(CAST({} AS VARCHAR), '')) <> '' THEN 1 ELSE 0 END)"
_OPTIONAL = ("energy_text", "surface", "address", "district", "rooms", "price_text", "blank", "even")


@query(over_raw("SELECT id, CAST(format('{:.2f}', (" + " + ".join(_FILLED.format(c) for c in _OPTIONAL[:-2]) + " + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END) / 8.0::DOUBLE) AS DOUBLE) AS completeness FROM raw"))
def completeness(spark, sf_dir):
    """Eight fields: half a hundredth goes to the even digit, and a text of white space alone isn't filled."""
    own = raw(spark, sf_dir).withColumns({"blank": F.lit("\t\n "), "even": F.when(C("id") % 2 == 0, "x")})
    return own.select("id", text.completeness(*(C(c) for c in _OPTIONAL)).alias("completeness"))


_CANONICAL = r"""lower(regexp_extract(u, '^([^:/?#]+):', 1)) || '://' || lower(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1))
    || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END"""
_URLS = r"""(SELECT id, u, path, coalesce(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1])
        NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'fbclid', 'gclid', 'ref', 'tracking'))), '&'), '') AS kept
    FROM (SELECT id, u, regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS q FROM ({})))"""


@query(views.sql(f"SELECT id, {_CANONICAL} AS canonical, sha256({_CANONICAL}) AS hash, sha256(regexp_extract(u, '^[^?#]*')) AS plain_hash FROM " + _URLS.format("SELECT id, url AS u FROM listings"), "listings"))
def url_canonical_hash(spark, sf_dir):
    own = views.listings(spark, sf_dir)
    return own.select("id", text.canonical_url(C("url")).alias("canonical"), text.url_hash(C("url")).alias("hash"), text.plain_url_hash(C("url")).alias("plain_hash"))


@query(f"SELECT id, {_CANONICAL} AS canonical, regexp_matches(u, '(?i)^\\s*https?://[^/?#]*\\.[^/?#]*') AS valid FROM " + _URLS.format("SELECT page_id AS id, url AS u FROM pages"))
def page_urls(spark, sf_dir):
    own = views.table(spark, sf_dir, "pages")
    return own.select(C("page_id").alias("id"), text.canonical_url(C("url")).alias("canonical"), text.valid_url(C("url")).alias("valid"))


@query(views.sql("SELECT id, regexp_replace(url, '#top$', '') || '&page=3' AS next_url, 'postgresql://u' || id || ':***@db/x' AS masked, 'https://a.example/x' || id AS found FROM listings", "listings"))
def url_edits(spark, sf_dir):
    own, k = views.listings(spark, sf_dir), C("id").cast("string")
    said = F.concat(F.lit("voir https://a.example/x"), k, F.lit("!."))
    url = F.concat(F.lit("postgresql://u"), k, F.lit(":s3cret@db/x"))
    return own.select("id", text.with_page(F.regexp_replace("url", "#top$", ""), 3).alias("next_url"), text.mask_password(url).alias("masked"), text.url_in_text(said).alias("found"))


def _hits(column: str, words) -> str:
    return " + ".join(f"CAST(contains(lower({column}), '{w.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for w in words)


@query(views.sql(f"SELECT id, {_hits('description', ScoreConfig().signals)} AS signals, {_hits('description', Bounds().agency_words)} AS agency_words FROM listings", "listings"))
def keyword_signals(spark, sf_dir):
    own = views.listings(spark, sf_dir)
    return own.select("id", text.contains_count(C("description"), ScoreConfig().signals).alias("signals"), text.contains_count(C("description"), Bounds().agency_words).alias("agency_words"))


@query(f"SELECT doc_id, {_hits('text', ScoreConfig().signals)} AS signals, CASE WHEN {_hits('text', text.FURNISHED_WORDS)} > 0 THEN true END AS furnished FROM documents")
def document_signals(spark, sf_dir):
    own = views.table(spark, sf_dir, "documents")
    return own.select("doc_id", text.contains_count(C("text"), ScoreConfig().signals).alias("signals"), text.furnished(F.lit(None).cast("string"), C("text")).alias("furnished"))


@query(views.sql("""SELECT id, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE NULL END AS furnished FROM listings""", "listings"))
def furnished_flag(spark, sf_dir):
    k = C("id") % 5
    flag = F.when(k == 0, "Oui ").when(k == 1, "vide").otherwise("?")
    return views.listings(spark, sf_dir).select("id", text.furnished(flag, F.when(k == 2, "Cuisine Équipée"), F.lit("studio")).alias("furnished"))


@query(views.sql("""SELECT id, replace(format('{:,}', CAST(round_even(price, 0) AS BIGINT)), ',', ' ') || '€' AS money, CASE WHEN rooms IS NOT NULL THEN format('{:.1f}%', rooms * 1.5::DOUBLE) END AS share FROM listings""", "listings"))
def money_format(spark, sf_dir):
    """Every listing, prices at a half too: rounded half to even."""
    return views.listings(spark, sf_dir).select("id", text.money(C("price")).alias("money"), text.percent(C("rooms") * 1.5).alias("share"))


@query(r"""SELECT conv_id, turn, regexp_replace(text, '([_*\[\]()~`>#+\-=|{}.!\\])', '\\\1', 'g') AS escaped FROM conversations""")
def md_escape(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.escape_markdown(C("text")).alias("escaped"))


@query(views.sql(r"""SELECT id, (id % 97) || ' Avenue de la ' || upper(substr(n, 1, 1)) || substr(n, 2) || ' 25' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || ' Besançon' AS address_form,
    (id % 97) || ' av ' || n || ' 25' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || ' besancon' AS address_key FROM (SELECT id, lower(district) || ',' AS n0, lower(district) AS n FROM listings)""".replace("|| ' 25' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || ' Besançon' AS address_form", "|| ', 25' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || ' Besançon' AS address_form"), "listings"))
def address_forms(spark, sf_dir):
    own = views.listings(spark, sf_dir)
    return own.select("id", text.address_form(C("address")).alias("address_form"), text.address_key(F.regexp_replace("address", "av\\.", "avenue")).alias("address_key"))


_SALE = """list_filter([
    CASE WHEN price IS NULL THEN 'price missing' WHEN trunc(price) < 10000 THEN 'price low' WHEN trunc(price) > 500000 THEN 'price high' END,
    CASE WHEN surface IS NULL THEN 'surface missing' WHEN surface < 10 THEN 'surface low' WHEN surface > 300 THEN 'surface high' END,
    CASE WHEN rooms IS NULL THEN 'rooms missing' WHEN rooms < 1 THEN 'rooms low' WHEN rooms > 10 THEN 'rooms high' END,
    CASE WHEN energy NOT IN ('A', 'B', 'C', 'D', 'E', 'F', 'G') THEN 'energy invalid' END,
    CASE WHEN NOT regexp_matches(url, '^(?i)https?://[^/?#]*\\.[^/?#]*') THEN 'url invalid' END,
    CASE WHEN NOT (contains(lower(address), 'besançon') OR contains(lower(address), 'besancon') OR regexp_matches(address, '\\b25[0-9]{3}\\b')) THEN 'address outside' END], lambda r: r IS NOT NULL)"""


@query(views.sql(f"SELECT id, array_to_string({_SALE}, '|') AS reasons, len({_SALE}) = 0 AS valid FROM listings", "listings"))
def validate_sales(spark, sf_dir):
    found = validation.sale_reasons(C("price"), C("surface"), C("rooms"), C("energy"), C("url"), C("address"))
    own = views.listings(spark, sf_dir).withColumn("found", found)
    return own.select("id", F.array_join("found", "|").alias("reasons"), (F.size("found") == 0).alias("valid"))


@query(views.sql("""SELECT id, array_to_string(list_filter([CASE WHEN rent < 200 THEN 'rent low' WHEN rent > 3000 THEN 'rent high' END, CASE WHEN surface < 10 THEN 'surface low' WHEN surface > 300 THEN 'surface high' END,
    CASE WHEN id % 3 = 0 THEN 'url invalid' END, CASE WHEN id % 4 = 0 THEN 'address outside' END], lambda r: r IS NOT NULL), '|') AS reasons FROM rents""", "rents"))
def validate_rents(spark, sf_dir):
    url = F.when(C("id") % 3 == 0, "ftp://x.org/1").otherwise("https://x.org/1")
    address = F.when(C("id") % 4 == 0, "75001 Paris").when(C("id") % 4 == 1, "12 rue X, 25000").otherwise("BESANÇON centre")
    found = validation.rent_reasons(C("rent"), C("surface"), C("rooms"), url, address)
    return views.rents(spark, sf_dir).select("id", F.array_join(found, "|").alias("reasons"))


@query(views.sql(f"SELECT reason, count(*) AS n FROM (SELECT unnest({_SALE}) AS reason FROM listings) GROUP BY 1", "listings"))
def reject_reason_counts(spark, sf_dir):
    found = validation.sale_reasons(C("price"), C("surface"), C("rooms"), C("energy"), C("url"), C("address"))
    _, rejected = validation.split(views.listings(spark, sf_dir), found)
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(views.sql("""SELECT id, 'prix trop bas (' || CAST(trunc(price) AS BIGINT) || ' < 10000)' AS reason FROM listings WHERE price < 10000""", "listings"))
def reject_texts(spark, sf_dir):
    own = views.listings(spark, sf_dir).where(C("price") < Bounds().price[0])
    return own.select("id", validation.reason_text("prix", C("price").cast("long"), F.lit(Bounds().price[0]), F.lit(True)).alias("reason"))


_STATS = "stats AS (SELECT district, median(price / surface) AS median_m2, stddev_samp(price / surface) AS sd_m2, count(price / surface) AS n FROM listings GROUP BY 1)"


@query(views.sql(f"WITH {_STATS} SELECT district, round(median_m2, 4) AS median_m2, round(sd_m2, 4) AS sd_m2, n FROM stats", "listings"))
def district_price_stats(spark, sf_dir):
    out = validation.district_stats(views.listings(spark, sf_dir), "district", "price", "surface")
    return out.withColumns({c: F.round(c, 4) for c in ("median_m2", "sd_m2")})


@query(views.sql(f"""WITH {_STATS} SELECT id, array_to_string(list_filter([CASE WHEN sd_m2 > 0 AND abs(price / surface - median_m2) > 2 * sd_m2 THEN 'price per m2' END,
    CASE WHEN surface < CASE rooms WHEN 1 THEN 9 WHEN 2 THEN 20 WHEN 3 THEN 35 WHEN 4 THEN 50 WHEN 5 THEN 65 END THEN 'surface for rooms' END,
    CASE WHEN {_hits('description', Bounds().agency_words)} >= 2 THEN 'agency' END], lambda r: r IS NOT NULL), '|') AS anomalies FROM listings JOIN stats USING (district)""", "listings"))
def anomalies(spark, sf_dir):
    own = views.listings(spark, sf_dir)
    stats = validation.district_stats(own, "district", "price", "surface")
    found = validation.anomalies(C("price"), C("surface"), C("rooms"), C("description"), C("median_m2"), C("sd_m2"))
    return own.join(stats, "district").select("id", F.array_join(found, "|").alias("anomalies"))



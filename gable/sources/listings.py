"""Readers of landed sources: API pages as JSON, HTML pages with embedded JSON or cards, model answers as JSON text."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

AD = "list_id long, url string, subject string, body string, price array<int>, first_publication_date string, index_date string, attributes array<struct<key:string,value:string>>, location struct<address:string,city:string,zipcode:string,district:string,lat:double,lng:double>, images struct<urls:array<string>>"
# Codes of the state of a dwelling.
CONDITIONS = {"1": "neuf", "2": "tres_bon_etat", "3": "bon_etat", "4": "a_rafraichir", "5": "a_renover"}
STATES = ("neuf", "tres_bon_etat", "bon_etat", "correct", "a_rafraichir", "travaux_importants", "a_renover", "inconnu")
#: A price that a listing had.
HELD = "struct<price:int,date:string>"
ANSWER_KEYS = ("signaux_nego", "etat_bien", "equipements", "red_flags", "info_copro", "estimation_travaux", "scenarios_location", "prix_m2_marche", "resume")
ANSWER = "signaux_nego array<string>, etat_bien string, equipements array<string>, red_flags array<string>, info_copro struct<nb_lots:int,charges_annuelles_copro:double,charges_annuelles_lot:double,charges_annuelles:double>, estimation_travaux struct<necessaire:boolean,description:string,budget_bas:double,budget_haut:double>, scenarios_location struct<standard:struct<loyer_nu:double,loyer_meuble:double>,colocation:struct<nb_chambres:int,loyer_par_chambre:double,loyer_total:double>>, prix_m2_marche struct<fourchette_basse:double,fourchette_haute:double>, resume string"


def read_api_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed API pages, one ad a row. The schema is given, so nothing is read twice to infer it."""
    return spark.read.schema(f"ads array<struct<{', '.join(f'{c}' for c in _fields(AD))}>>").option("multiLine", True).json(path).select(F.explode("ads").alias("ad"))


def searched(pages: DataFrame, most: int = 5) -> DataFrame:
    """search, page and ad (a variant) of every ad that landed searches give. pages: search, page (from 1), status, body; a row for each page that was landed.

    A search is read page by page while the page before was read, had ads, named a pivot for the next and wasn't the last by its own `max_pages` or by `most`.
    A page that failed (status other than 200, no JSON, not landed) ends it: what came before stays, so a search whose first page failed gives no rows.
    """
    own = pages.where(F.col("page").between(1, most)).select("search", "page", F.when(F.col("status") == 200, F.try_parse_json("body")).alias("v"))  # the limit reaches the scan
    own = own.withColumn("ads", F.try_variant_get("v", "$.ads", "array<variant>"))
    pivot, last = F.try_variant_get("v", "$.pivot", "string"), F.coalesce(F.try_variant_get("v", "$.max_pages", "int"), F.lit(most))
    goes_on = F.coalesce((F.size("ads") > 0) & (pivot != "") & (F.col("page") < last), F.lit(False))
    before = Window.partitionBy("search").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # `most` rows a search
    own = own.withColumn("goes_on", goes_on).withColumn("reached", F.coalesce(F.min("goes_on").over(before), F.lit(True)) & (F.count("*").over(before) == F.col("page") - 1))
    return own.where("reached").select("search", "page", F.explode("ads").alias("ad"))


def _fields(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += ch
    return [x.replace(" ", ":", 1) for x in [*out, word.strip()]]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, url string, html string").parquet(path)


def wanted(ads: DataFrame, cities: tuple[str, ...], rooms: tuple[int, int], price: tuple[int, int]) -> DataFrame:
    """The request-side filter as a predicate that reaches the source."""
    return ads.where(F.col("city").isin(*cities) & F.col("rooms").between(*rooms) & F.col("price").between(*price))


def attributes(ad: Column) -> Column:
    """Attributes of an ad as a map; of a repeated key the last value counts."""
    listed = F.filter(F.coalesce(ad["attributes"], F.array().cast("array<struct<key:string,value:string>>")), lambda a: F.coalesce(a["key"], F.lit("")) != "")
    keys = F.array_distinct(F.transform(listed, lambda a: a["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(listed, lambda a: a["key"] == k), -1)["value"]))


def flatten_ad(rows: DataFrame, ad: str = "ad") -> DataFrame:
    """Flat listings of parsed ads (a struct column of AD)."""
    a = F.col(ad)
    own = rows.withColumn("_a", attributes(a))

    def get(key: str) -> Column:
        return F.try_element_at("_a", F.lit(key))

    price = F.try_element_at(a["price"], F.lit(1))
    old = get("old_price").try_cast("int")
    place = a["location"]
    return own.select(
        a["list_id"].alias("list_id"), a["url"].alias("url"), a["subject"].alias("title"), price.alias("price"), get("square").try_cast("double").alias("surface"), get("rooms").try_cast("int").alias("rooms"),
        text.energy_any(get("energy_rate")).alias("energy"), get("floor_number").try_cast("int").alias("floor"),
        F.when(get("furnished") == "1", True).when(get("furnished") == "2", False).alias("furnished"), get("annual_charges").try_cast("double").alias("charges"),
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CONDITIONS.items() for x in p]), get("global_condition")), get("global_condition")).alias("condition"),
        text.join_filled(", ", place["address"], place["city"], place["zipcode"]).alias("address"), place["district"].alias("district"), place["lat"].alias("lat"), place["lng"].alias("lon"),
        F.when((old != price) & (old > 0), F.array(old, price)).otherwise(F.array().cast("array<int>")).alias("history"), F.coalesce(a["images"]["urls"], F.array().cast("array<string>")).alias("photos"),
    )


def variant_kind(v: Column) -> Column:
    """What a variant holds: number, str, list, dict or bool; null for a JSON null and for nothing."""
    kind = lambda found: (
        F.when(found.startswith("ARRAY"), "list").when(found.startswith("OBJECT"), "dict").when(found == "STRING", "str").when(found == "BOOLEAN", "bool")
        .when(found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")
    )
    return F.transform(F.array(F.schema_of_variant(v)), kind)[0]  # the schema is worked out once


def variant_number(v: Column) -> Column:
    """The double in a variant, or 1 and 0 for true and false; null for text, lists and objects."""
    return F.when(variant_kind(v).isin("number", "bool"), F.try_variant_get(v, "$", "double"))


def variant_price(v: Column) -> Column:
    """A price as ads give it: a number, or a list whose first is a number or a whole number as text; decimals are cut off."""
    first = F.try_variant_get(v, "$[0]", "variant")
    listed = F.coalesce(variant_number(first), F.when(variant_kind(first) == "str", F.try_variant_get(first, "$", "string").try_cast("long").cast("double")))
    return F.when(variant_kind(v) == "list", listed).otherwise(variant_number(v)).cast("long").try_cast("int")


def flatten_variant(rows: DataFrame, ad: str = "ad", letting: bool | Column = False) -> DataFrame:
    """Flat listings of ads held as variants. Each path is read by itself: one of another type, or missing, is null and leaves the others alone.

    Of a repeated attribute the last value counts; a `url` that the rows have counts before the ad's. Rent and furnishing are read of lettings only.
    """
    letting = F.lit(letting) if isinstance(letting, bool) else letting
    at = lambda path, kind: F.try_variant_get(F.col(ad), path, kind)
    pair = lambda x: F.struct(F.try_variant_get(x, "$.key", "string").alias("key"), F.try_variant_get(x, "$.value", "string").alias("value"))
    listed = F.transform(F.coalesce(at("$.attributes", "array<variant>"), F.array().cast("array<variant>")), pair)
    own = rows.withColumn("_letting", letting).withColumn("_listed", listed).withColumn("_price", variant_price(at("$.price", "variant")))
    get = lambda key: F.nullif(F.try_element_at(F.filter("_listed", lambda a: F.coalesce(a["key"] == key, F.lit(False))), F.lit(-1))["value"], F.lit(""))
    decimal = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    letter = lambda c: F.when(F.upper(c).rlike("^[A-G]$"), F.upper(c))
    price, old, condition = F.col("_price"), get("old_price").try_cast("int"), get("global_condition")
    place = F.filter(F.array(*(at(f"$.location.{c}", "string") for c in ("address", "city", "zipcode"))), lambda p: F.coalesce(p, F.lit("")) != "")
    lat, lon = at("$.location.lat", "double"), at("$.location.lng", "double")
    held = F.array(F.struct(old.alias("price"), F.lit(None).cast("string").alias("date")), F.struct(price.alias("price"), at("$.index_date", "string").alias("date")))
    url = F.col("url") if "url" in rows.columns else at("$.url", "string")
    return own.select(
        at("$.list_id", "long").alias("list_id"), url.alias("url"), at("$.subject", "string").alias("title"), F.nullif(at("$.body", "string"), F.lit("")).alias("description"), price.alias("price"),
        decimal(get("square")).alias("surface"), get("rooms").try_cast("int").alias("rooms"), letter(get("energy_rate")).alias("energy"), letter(get("ges")).alias("emissions"), get("floor_number").try_cast("int").alias("floor"),
        F.when(F.col("_letting"), F.lower(get("furnished")).isin("1", "true", "oui")).alias("furnished"), F.when(F.col("_letting") & (price != 0), price.cast("double")).alias("rent"),
        F.coalesce(decimal(get("annual_charges")), decimal(get("charges_included"))).alias("charges"), get("price_per_square_meter").try_cast("int").alias("price_m2"),
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CONDITIONS.items() for x in p]), condition), condition).alias("condition"),
        F.nullif(F.array_join(place, ", "), F.lit("")).alias("address"), F.nullif(at("$.location.district", "string"), F.lit("")).alias("district"),
        F.when((lat != 0) & (lon != 0), lat).alias("lat"), F.when((lat != 0) & (lon != 0), lon).alias("lon"), F.when((price != 0) & (old != price), held).otherwise(F.array().cast(f"array<{HELD}>")).alias("history"),
        F.coalesce(at("$.images.urls", "array<string>"), F.array().cast("array<string>")).alias("photos"), F.nullif(at("$.first_publication_date", "string"), F.lit("")).alias("published"),
    )


def embedded_json(page: Column, schema: str) -> Column:
    """The JSON a page embeds for its own script, parsed."""
    return F.from_json(F.nullif(F.regexp_extract(page, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit("")), schema)


def single_listings(pages: DataFrame) -> DataFrame:
    """The listing of each page (url, html) of one ad, from what the page embeds; a letting if the URL's path says so. Pages without an ad give none."""
    found = F.try_parse_json(F.nullif(F.regexp_extract("html", r'(?s)<script\s+id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit("")))
    own = pages.select("url", F.try_variant_get(found, "$.props.pageProps.ad", "variant").alias("ad")).where(variant_kind(F.col("ad")) == "dict")
    return flatten_variant(own, letting=F.col("url").contains("/locations/"))


def linked_data(page: Column) -> Column:
    """All JSON-LD blocks of a page that are JSON."""
    found = F.regexp_extract_all(page, F.lit(r'(?s)<script type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return F.filter(found, lambda x: F.try_parse_json(x).isNotNull())


def links(page: Column) -> Column:
    """Targets and texts of a page's links."""
    listed = F.regexp_extract_all(page, F.lit(r'(<a\s+href="[^"]*"[^>]*>[^<]*</a>)'), F.lit(1))
    return F.transform(listed, lambda a: F.struct(F.regexp_extract(a, r'href="([^"]*)"', 1).alias("href"), F.regexp_extract(a, r">([^<]*)</a>", 1).alias("label")))


def absolute_url(url: Column, base: Column) -> Column:
    """A URL as it stands on a page at `base`, resolved by RFC 3986; null where it is empty, or relative without a base. One with a scheme or host of its own keeps its path as it is."""
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    (scheme, host, path, query, part), (scheme_b, host_b, path_b, query_b, _) = ([F.regexp_extract(c, pattern, i) for i in range(1, 6)] for c in (url, base))
    own_host, own_query = url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), url.rlike(r"^[^?#]*\?")
    merged = F.when((path_b == "") & (host_b != ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(path_b, "^(.*/)?", 0), path))
    whole = F.when(own_host, path).when(path == "", path_b).otherwise(_without_dots(F.when(path.startswith("/"), path).otherwise(merged)))
    to_query = F.when(~own_host & (path == "") & ~own_query, query_b).otherwise(query)
    sized = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    out = F.concat(scheme_b, F.lit("://"), F.when(own_host, host).otherwise(host_b), whole, sized("?", to_query), sized("#", part))
    return F.when((url == "") | url.isNull(), None).when(scheme != "", url).when((scheme_b != "") & (host_b != ""), out)


def _without_dots(path: Column) -> Column:
    """A path without the segments `.` and `..`, the latter with what they go back over; the path's slashes at both ends stay."""
    parts = F.split(path, "/")
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.array_append(kept, s))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), step)
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.startswith("/"), F.array_join(F.when(ends, F.array_append(kept, F.lit(""))).otherwise(kept), "/")).otherwise(path)


class _Cards(HTMLParser):
    """Links inside elements of a class, with the text of the card."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind, self.cards, self.depth = kind, [], 0

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if self.depth:
            self.depth += tag not in ("br", "img", "hr", "meta", "input", "link")
        elif self.kind in (own.get("class") or "").split():
            self.depth = 1
            self.cards.append({"href": None, "text": []})
        if self.depth and tag == "a" and self.cards[-1]["href"] is None:
            self.cards[-1]["href"] = own.get("href")

    def handle_endtag(self, tag):
        self.depth -= bool(self.depth)

    def handle_data(self, data):
        if self.depth and data.strip():
            self.cards[-1]["text"].append(data.strip())


def cards(pages: DataFrame, kind: str) -> DataFrame:
    """page_id, position, href and text of the cards (elements of a class) of each page; cards without a link are left out."""

    def run(batches):
        for pdf in batches:
            out = []
            for page, source in zip(pdf["page_id"], pdf["html"]):
                parser = _Cards(kind)
                parser.feed(source or "")
                out += [(page, i, c["href"], " ".join(c["text"])) for i, c in enumerate(parser.cards) if c["href"]]
            yield pd.DataFrame(out, columns=["page_id", "position", "href", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, position int, href string, text string")


def allowed(pages: DataFrame, rules: DataFrame, path: Column) -> DataFrame:
    """pages whose path begins with no denied prefix. rules: prefix. A handful of rules for each site, so a broadcast of a checked size."""
    listed = [r["prefix"] for r in rules.select("prefix").distinct().limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("more rules than a robots file may have here")
    denied = F.lit(False)
    for p in listed:
        denied = denied | path.startswith(p)
    return pages.where(~denied)


def robots_rules(files: DataFrame) -> DataFrame:
    """host and prefix of every path that rule files (host, content) deny to all agents: the rules below a line that names `*`, up to the next that names agents."""
    lines = files.select("host", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("pos", "line")).withColumn("line", text.strip(F.col("line")))
    low = F.lower("line")
    said = text.strip(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    agent = F.when(low.startswith("user-agent:"), said)
    lines = lines.withColumn("agent", F.last(agent, ignorenulls=True).over(Window.partitionBy("host").orderBy("pos")))  # the lines of one file
    return lines.where((F.col("agent") == "*") & low.startswith("disallow:") & (said != "")).select("host", said.alias("prefix")).distinct()


def allowed_by(pages: DataFrame, rules: DataFrame, host: Column, path: Column) -> DataFrame:
    """pages whose path begins with no prefix that is denied at their host. Any number of rules and hosts.

    The beginnings of a path that are as long as some rule of its host are joined with the rules, once for each distinct path.
    """
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # as many as a path may have letters
    own = pages.withColumns({"_host": host, "_path": path})
    begun = own.select("_host", "_path").distinct().join(lengths, F.col("_host") == F.col("host")).drop("host")
    begun = begun.select("_host", "_path", F.explode(F.filter("lengths", lambda n: n <= F.length("_path"))).alias("n")).withColumn("_begins", F.substring("_path", 1, F.col("n")))
    denied = begun.join(rules, (F.col("_host") == F.col("host")) & (F.col("_begins") == F.col("prefix")), "left_semi").select("_host", "_path").distinct()
    return own.join(denied, ["_host", "_path"], "left_anti").drop("_host", "_path")


def model_answer(c: Column) -> Column:
    """A model's JSON answer: fences stripped, all nine keys there, else null; an unknown state is `inconnu`. The text is stripped once, and parsed only if its keys are there."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")

    def read(t: Column) -> Column:
        keys = F.coalesce(F.json_object_keys(F.when(F.try_parse_json(t).isNotNull(), t)), F.array().cast("array<string>"))
        whole = F.size(F.array_except(F.array(*map(F.lit, ANSWER_KEYS)), keys)) == 0
        return F.when(whole, F.transform(F.array(F.from_json(t, ANSWER)), lambda a: a.withField("etat_bien", F.when(a["etat_bien"].isin(*STATES), a["etat_bien"]).otherwise("inconnu")))[0])

    return F.transform(F.array(bare), read)[0]


def lot_charges(info: Column) -> Column:
    """A lot's share: as stated, by the older key, or the whole divided by the lots."""
    return F.coalesce(info["charges_annuelles_lot"], info["charges_annuelles"], F.try_divide(info["charges_annuelles_copro"], info["nb_lots"]))


def condo(info: Column) -> Column:
    """lots, lot and whole (charges a year): a lot's share as stated, by the older key where nothing else is, or from the whole; the whole as stated or from the lot's."""
    lots, whole, lot = info["nb_lots"], info["charges_annuelles_copro"], info["charges_annuelles_lot"]
    lot = F.coalesce(lot, F.when(whole.isNull(), info["charges_annuelles"]))
    own = F.coalesce(lot, F.when((whole != 0) & (lots > 0), F.round(whole / lots, 2)))
    return F.struct(lots.alias("lots"), own.alias("lot"), F.coalesce(whole, F.when((own != 0) & (lots > 0), F.round(own * lots, 2))).alias("whole"))


def with_cached(rows: DataFrame, cache: DataFrame, address: str, since) -> tuple[DataFrame, DataFrame]:
    """rows with a cached place no older than `since`, and the rows that have none. cache: key, lat, lon, cached_at."""
    key = F.sha2(F.lower(F.trim(F.col(address))), 256)
    own = rows.withColumn("_key", key)
    fresh = cache.where(F.col("cached_at") >= F.lit(since)).select(F.col("key").alias("_key"), "lat", "lon")
    return own.join(fresh, "_key").drop("_key"), own.join(fresh, "_key", "left_anti").drop("_key")


def geocode_answer(c: Column) -> DataFrame | Column:
    """First feature of a GeoJSON answer: latitude, longitude, label, score."""
    parsed = F.from_json(c, "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<label:string,score:double,city:string,postcode:string>>>")
    first = F.try_element_at(parsed["features"], F.lit(1))
    at = first["geometry"]["coordinates"]
    return F.when(F.size(at) >= 2, F.struct(at[1].alias("lat"), at[0].alias("lon"), first["properties"]["label"].alias("label"), first["properties"]["score"].alias("score")))

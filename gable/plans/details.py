"""Queries of detail pages, model answers, reasons in words, retention and message templates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RetentionConfig, ScoreConfig
from ..functions import finance, messages, text
from ..operators import alerts, health, maintenance, observatory, validation
from ..sources import details as src
from ..sources import listings as ads
from . import operations, views
from .expressions import _hits
from .registry import registrar
from .scoring import _LAG, _SCORED, graded

REGISTER: dict = {}
query = registrar(REGISTER)
C = F.col


def _event_pages(spark, sf_dir) -> DataFrame:
    """Pages that embed ads under one of three paths, or bad JSON, or none and show links."""
    k = C("event_id")
    ad = F.concat(F.lit('{"list_id": '), k.cast("string"), F.lit(', "url": "/v/'), k.cast("string"), F.lit('", "price": ['), (k % 1000 + 50000).cast("string"), F.lit("]}"))
    body = (
        F.when(k % 5 == 0, F.concat(F.lit('"searchData": {"ads": ['), ad, F.lit("]}")))
        .when(k % 5 == 1, F.concat(F.lit('"searchData": {"ads": []}, "listingData": {"ads": ['), ad, F.lit(", "), ad, F.lit("]}")))
        .when(k % 5 == 2, F.concat(F.lit('"ads": ['), ad, F.lit("]"))).when(k % 5 == 3, F.lit('"ads": []'))
    )
    script = F.when(k % 5 < 4, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {'), body, F.lit("}}}</script>"))).otherwise(F.lit('<script id="__NEXT_DATA__">{oops</script>'))
    link = F.concat(F.lit('<a href="/x/'), k.cast("string"), F.lit('">a</a>'))
    return views.table(spark, sf_dir, "events").select(k.alias("page_id"), F.concat(F.lit("<html>"), script, link, link, F.lit("</html>")).alias("html"))


@query("SELECT event_id AS page_id, CASE event_id % 5 WHEN 1 THEN 2 ELSE 1 END AS n_ads, event_id AS first_id FROM events WHERE event_id % 5 < 3")
def embedded_ads(spark, sf_dir):
    own = _event_pages(spark, sf_dir).withColumn("ads", src.embedded_ads(C("html"))).where("ads is not null")
    return own.select("page_id", F.size("ads").alias("n_ads"), F.element_at("ads", 1)["list_id"].alias("first_id"))


@query("""SELECT event_id AS page_id, event_id % 5 < 3 AS embedded, CASE event_id % 5 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS n_rows, CASE WHEN event_id % 5 < 3 THEN '/v/' ELSE '/x/' END || event_id AS first_url,
    CASE WHEN event_id % 5 < 3 THEN CAST(event_id % 1000 + 50000 AS INTEGER) END AS first_price FROM events""")
def source_choice(spark, sf_dir):
    own = src.chosen_rows(_event_pages(spark, sf_dir)).withColumn("first", F.element_at("rows", 1))
    return own.select("page_id", "embedded", F.size("rows").alias("n_rows"), C("first.url").alias("first_url"), C("first.price").alias("first_price"))


@query(views.sql("SELECT id, NOT (id % 4 <> 0 AND surface > 0 AND rooms > 0 AND price <> 0) OR surface IS NULL OR rooms IS NULL AS needed FROM listings", "listings"))
def detail_needed(spark, sf_dir):
    title = F.when(C("id") % 8 == 0, "").when(C("id") % 4 != 0, "T2")  # empty, or null
    return views.listings(spark, sf_dir).select("id", src.needs_detail(F.lit(True), C("url"), title, C("price"), C("surface"), C("rooms"), C("address")).alias("needed"))


@query(views.sql("""SELECT id, CAST(surface AS INTEGER) + 0.5::DOUBLE AS surface, CAST(id % 6 AS INTEGER) AS rooms, CAST(id % 9 AS INTEGER) AS floor, 1000.0::DOUBLE + id % 100 + 0.5 AS charges, CASE WHEN id % 3 > 0 THEN substr('ABCDEFG', CAST(id % 7 + 1 AS INTEGER), 1) END AS energy,
    CASE WHEN id % 2 = 0 THEN id % 4 = 0 END AS furnished, CASE WHEN id % 2 = 0 THEN 400.0::DOUBLE + id % 50 END AS rent FROM listings""", "listings"))
def detail_fields(spark, sf_dir):
    """Criteria of detail pages: labels dispatch to fields; repeated ones by the rule of each field."""
    k = C("id").cast("string")

    def item(label: str, value) -> F.Column:
        return F.concat(F.lit(f'<div data-qa-id="criteria_item"><div data-qa-id="criteria_item_label">{label}</div>\n <div data-qa-id="criteria_item_value">'), value, F.lit("</div></div>"))

    letter = F.substring(F.lit("ABCDEFG"), (C("id") % 7 + 1).cast("int"), F.lit(1))
    page = F.concat(
        item("Surface habitable", F.when(C("surface").isNull(), "inconnue").otherwise(F.concat(C("surface").cast("int").cast("string"), F.lit(",5 m²")))), item("SURFACE du terrain", F.lit("900 m²")), item("Nombre de pièces", (C("id") % 6).cast("string")), item("Pieces", F.lit("77")),
        item("Étage", F.lit("88")), item("Etage de votre bien", F.concat((C("id") % 9).cast("string"), F.lit("e"))), item("Charges annuelles", F.concat((F.lit(1000) + C("id") % 100).cast("string"), F.lit(",50 € / an"))),
        item("Classe énergie", F.when(C("id") % 3 == 0, "NON COMMUNIQUE").otherwise(F.concat(F.lit("classe : "), letter))), item("GES", F.when(C("id") % 3 == 0, "").otherwise(F.lit("G"))),
        item("Meublé", F.when(C("id") % 4 == 0, "Oui").otherwise("Non")), item("Loyer", F.concat((F.lit(400) + C("id") % 50).cast("string"), F.lit(" € / mois"))), item("Autre", k),
    )
    own = views.listings(spark, sf_dir).select("id", src.named(src.criteria(page)).alias("c"), (C("id") % 2 == 0).alias("letting"))
    return own.select("id", *(c.alias(n) for n, c in src.detail_fields(C("c"), C("letting")).items()))


@query(views.sql("SELECT id, CASE WHEN id % 3 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN id % 6 = 0 THEN NULL ELSE energy END AS energy, district FROM listings", "listings"))
def listing_overlay(spark, sf_dir):
    own = views.listings(spark, sf_dir).select("id", "price", "energy", "district")
    keys = F.when(C("id") % 6 == 0, F.array(F.lit("price"), F.lit("energy"))).otherwise(F.array(F.lit("price")))
    detail = own.where("id % 3 = 0").select("id", (C("price") + 1).alias("price"), F.lit(None).cast("string").alias("energy"), keys.alias("present"))
    return src.overlay(own, detail, "id", ["price", "energy"])


@query("SELECT page_id, 'pages' AS source, TIMESTAMP '2001-12-01' AS batch_at, coalesce(status, 'nouveau') AS status, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS n_photos FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'vu' END AS status FROM pages)")
def batch_columns(spark, sf_dir):
    own = views.table(spark, sf_dir, "pages").select("page_id", "url", F.when(C("page_id") % 3 == 0, "vu").alias("status"), F.when(C("page_id") % 2 == 0, F.array(F.lit("p"))).alias("photos"))
    own = src.with_defaults(src.with_batch(own, "pages", views.AS_OF), "status", ("photos",))
    return own.where(C("hash") == text.url_hash(C("url"))).select("page_id", "source", "batch_at", "status", F.size("photos").alias("n_photos"))


@query(views.sql("SELECT id, CASE id % 3 WHEN 2 THEN '12' WHEN 1 THEN CAST(100000 + id AS VARCHAR) END AS number FROM listings", "listings"))
def listing_numbers(spark, sf_dir):
    number = (F.lit(100000) + C("id")).cast("string")
    url = F.when(C("id") % 3 == 0, F.concat(F.lit("https://x.example/ventes/no-"), number)).when(C("id") % 3 == 1, F.concat(F.lit("https://www.x.example/ad/ventes_immobilieres/"), number, F.lit(".htm?from=a"))).otherwise(F.lit("https://x.example/u/12"))
    return views.listings(spark, sf_dir).select("id", src.listing_number(url).alias("number"))


@query(views.sql("""SELECT id, array_to_string(list_filter([
      CASE WHEN id % 7 = 0 THEN 'prix invalide (type str)' WHEN id % 7 = 1 THEN 'prix negatif ou nul (0)' WHEN price < 10000 THEN 'prix trop bas (' || CAST(trunc(price) AS BIGINT) || ' < 10000)' WHEN trunc(price) > 500000 THEN 'prix trop eleve (' || CAST(trunc(price) AS BIGINT) || ' > 500000)' END,
      CASE WHEN surface IS NULL THEN 'surface manquante' WHEN surface < 10 THEN 'surface trop petite (' || CAST(surface AS BIGINT) || '.0 < 10.0)' WHEN surface > 300 THEN 'surface trop grande (' || CAST(surface AS BIGINT) || '.0 > 300.0)' END,
      CASE WHEN rooms IS NULL THEN 'nb_pieces manquant' WHEN rooms > 10 THEN 'nb_pieces trop grand (' || rooms || ' > 10)' END, CASE WHEN energy = 'X' THEN 'dpe invalide (''X'' hors A-G)' END], lambda r: r IS NOT NULL), '; ') AS reasons FROM listings""", "listings"))
def reject_texts_all(spark, sf_dir):
    price = F.when(C("id") % 7 == 0, "abc").when(C("id") % 7 == 1, "0").otherwise(C("price").cast("decimal(18,2)").cast("string"))
    found = validation.sale_reason_texts(price, C("surface").cast("string"), C("rooms").cast("string"), C("energy"))
    return views.listings(spark, sf_dir).select("id", F.array_join(found, "; ").alias("reasons"))


@query(views.sql("SELECT level, id FROM (SELECT level, id, row_number() OVER (PARTITION BY level ORDER BY id) AS n FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'bon' ELSE 'veille' END AS level FROM listings)) WHERE level <> 'veille' AND n <= 3", "listings"))
def alert_selection(spark, sf_dir):
    own = views.listings(spark, sf_dir).select("id", "price", F.when(C("id") % 4 == 0, "top").when(C("id") % 4 == 1, "bon").otherwise("veille").alias("level"), C("price").alias("score"))
    return alerts.selected(own, "id", 3).select("level", "id")


@query(views.sql("SELECT 'top' AS level, id FROM listings ORDER BY price DESC, id LIMIT 1", "listings"))
def alert_fallback(spark, sf_dir):
    own = views.listings(spark, sf_dir).select("id", "price", F.lit("veille").alias("level"), C("price").alias("score"))
    return alerts.selected(own, "id", 3).select("level", "id")


_TEXT = _hits("description", ScoreConfig().signals)


@query(views.sql(f"SELECT id, greatest(least({_TEXT}, 2), least(CASE WHEN id % 3 < 2 THEN id % 3 * 2 ELSE 0 END, 2)) * 15.0::DOUBLE + CASE WHEN id % 4 = 0 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM listings", "listings"))
def negotiation_enriched(spark, sf_dir):
    model = F.when(C("id") % 3 < 2, F.array_repeat(F.lit("urgent"), (C("id") % 3 * 2).cast("int")))
    points = finance.negotiation_score(finance.signals(text.contains_count(C("description"), ScoreConfig().signals), model), C("id") % 4 == 0)
    return views.listings(spark, sf_dir).select("id", points.alias("score"))


@query(views.sql(f"WITH {_SCORED} SELECT id, round(CASE WHEN y <= 4 THEN 0.0::DOUBLE WHEN y >= 12 THEN 100 ELSE (y - 4) / 8 * 100 END * 0.4::DOUBLE, 4) AS from_yield, round(l.appeal * 0.25::DOUBLE, 4) AS from_location, round(g.score, 4) AS score FROM graded g JOIN listings l USING (id)", "listings"))
def score_contributions(spark, sf_dir):
    own = graded(spark, sf_dir)
    parts = finance.contributions({"yield": finance.yield_score(C("y")), "location": C("appeal"), "energy": finance.energy_score(C("energy")), "negotiation": operations.negotiation(), "vacancy": finance.vacancy_score(C("tension"))})
    own = own.withColumn("parts", parts)
    total = sum((C(f"parts.{k}") for k in ScoreConfig().weights), F.lit(0.0))
    return own.select("id", F.round("parts.yield", 4).alias("from_yield"), F.round("parts.location", 4).alias("from_location"), F.round(total, 4).alias("score"))


@query(views.sql("""SELECT id, round(CASE WHEN id % 3 = 0 THEN 500.0::DOUBLE WHEN id % 3 = 1 THEN 10.5::DOUBLE * surface END, 2) AS rent, CASE WHEN id % 3 = 0 OR id % 3 = 1 AND surface IS NOT NULL THEN 'preliminaire' ELSE 'indisponible' END AS reliability FROM listings""", "listings"))
def fallback_rents(spark, sf_dir):
    """The median of a segment, else its rent per square metre times the surface, else none. The kind has no typical surface here, so medians stay as they are."""
    rent, reliability = observatory.fallback_rent(F.when(C("id") % 3 == 0, 500.0), F.when(C("id") % 3 < 2, 10.5), F.lit("T9"), C("surface"))
    return views.listings(spark, sf_dir).select("id", F.round(rent, 2).alias("rent"), reliability.alias("reliability"))


@query("""SELECT event_id, CAST(event_id % 9 + 1 AS INTEGER) AS lots, CASE event_id % 4 WHEN 0 THEN round(1200.0::DOUBLE / (event_id % 9 + 1), 2) WHEN 1 THEN 100.0::DOUBLE WHEN 2 THEN 80.0::DOUBLE END AS lot, CASE event_id % 4 WHEN 0 THEN 1200.0::DOUBLE WHEN 1 THEN round(100.0::DOUBLE * (event_id % 9 + 1), 2) WHEN 2 THEN round(80.0::DOUBLE * (event_id % 9 + 1), 2) END AS whole,
    event_id % 2 = 0 AS works, CASE WHEN event_id % 2 = 0 THEN 5000.0::DOUBLE END AS works_low, CASE WHEN event_id % 2 = 1 THEN 650.0::DOUBLE END AS furnished_rent, CASE WHEN event_id % 3 = 0 THEN 2500.0::DOUBLE END AS market_low FROM events""")
def llm_answer_fields(spark, sf_dir):
    """Condominium charges completed either way, works, letting scenarios and market price of landed answers."""
    k = C("event_id")
    lots = F.concat(F.lit('"nb_lots": '), (k % 9 + 1).cast("string"))
    charges = F.when(k % 4 == 0, ', "charges_annuelles_copro": 1200.0').when(k % 4 == 1, ', "charges_annuelles_lot": 100.0').when(k % 4 == 2, ', "charges_annuelles": 80.0').otherwise("")
    works = F.when(k % 2 == 0, '{"necessaire": true, "description": "toit", "budget_bas": 5000.0}').otherwise("null")
    letting = F.when(k % 2 == 1, '{"standard": {"loyer_nu": 500.0, "loyer_meuble": 650.0}}').otherwise("[]")
    market = F.when(k % 3 == 0, '{"fourchette_basse": 2500.0}').otherwise("{}")
    body = F.concat(
        F.lit('{"signaux_nego": [], "etat_bien": "neuf", "equipements": [], "red_flags": [], "info_copro": {'), lots, charges, F.lit('}, "estimation_travaux": '), works, F.lit(', "scenarios_location": '), letting,
        F.lit(', "prix_m2_marche": '), market, F.lit(', "resume": "x"}'),
    )
    own = views.table(spark, sf_dir, "events").select("event_id", ads.model_answer(body).alias("a")).select("event_id", "a", ads.condo(C("a.info_copro")).alias("c"))
    return own.select(
        "event_id", C("c.lots").alias("lots"), C("c.lot").alias("lot"), C("c.whole").alias("whole"), F.coalesce("a.estimation_travaux.necessaire", F.lit(False)).alias("works"),
        C("a.estimation_travaux.budget_bas").alias("works_low"), C("a.scenarios_location.standard.loyer_meuble").alias("furnished_rent"), C("a.prix_m2_marche.fourchette_basse").alias("market_low"),
    )


@query(" UNION ALL ".join([
    f"SELECT 'archived' AS name, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2001-12-01' - INTERVAL {RetentionConfig().archived_days} DAY) AS removed, count(*) AS before FROM orders",
    f"SELECT 'rents', count(*) FILTER (WHERE l_shipdate < TIMESTAMP '2001-12-01' - INTERVAL {RetentionConfig().rents_days} DAY), count(*) FROM lineitem",
    f"SELECT 'log', count(*) FILTER (WHERE ts < TIMESTAMP '2024-04-15' - INTERVAL {RetentionConfig().log_days} DAY), count(*) FROM events",
    f"SELECT 'rejects', count(*) FILTER (WHERE ts < TIMESTAMP '2024-02-15' - INTERVAL {RetentionConfig().rejects_days} DAY), count(*) FROM events WHERE event_type = 'error'",
]))
def retention_all(spark, sf_dir):
    """Rows that the retention of each of the four tables removes. Only archived sales are removed, at any status rents and logs."""
    events, days = views.table(spark, sf_dir, "events"), RetentionConfig()
    orders = views.table(spark, sf_dir, "orders").select("o_orderdate", (C("o_orderstatus") == "F").alias("archived"))
    aged = [
        ("archived", orders, F.when(C("archived"), C("o_orderdate")), views.AS_OF, days.archived_days), ("rents", views.table(spark, sf_dir, "lineitem"), C("l_shipdate"), views.AS_OF, days.rents_days),
        ("log", events, C("ts"), dt.datetime(2024, 4, 15), days.log_days), ("rejects", events.where("event_type = 'error'"), C("ts"), dt.datetime(2024, 2, 15), days.rejects_days),
    ]
    out = None
    for name, rows, at, as_of, limit in aged:
        one = rows.select(maintenance.expired(at, as_of, limit).alias("old")).agg(F.count_if("old").alias("removed"), F.count("*").alias("before")).select(F.lit(name).alias("name"), "removed", "before")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT count(*) AS children, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS left_over FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def cascade_purge(spark, sf_dir):
    orders, lines = (views.table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    purged = orders.where(C("o_orderdate") < dt.datetime(2000, 1, 1)).select(C("o_orderkey").alias("l_orderkey"))
    kept = maintenance.without_parents(lines, purged, "l_orderkey")
    return lines.agg(F.count("*").alias("children")).crossJoin(kept.agg(F.count("*").alias("left_over")))  # one row each


@query(views.sql('SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY "at" DESC, id DESC) AS n FROM run_log) WHERE n <= 7', "run_log"))
def keep_newest(spark, sf_dir):
    return maintenance.keep_newest(views.run_log(spark, sf_dir), "source", ["at", "id"], 7).select("id", "source")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS place FROM customer")
def cache_append(spark, sf_dir):
    own = views.table(spark, sf_dir, "customer").select(C("c_custkey").alias("key"))
    at = F.lit(views.AS_OF)
    old = own.select("key", F.lit("old").alias("place"), (at - F.expr("interval 1 day")).alias("cached_at"))
    return maintenance.cached(old.unionByName(own.where("key % 2 = 0").select("key", F.lit("new").alias("place"), at.alias("cached_at"))), "key", "cached_at").select("key", "place")


@query("WITH " + ", ".join(f"q{i} AS ({operations.REGISTER[n][1]})" for i, n in enumerate(("source_streaks", "parsing_rate", "freshness", "newest_file"))) + """,
    s AS (SELECT status FROM q0 UNION ALL SELECT status FROM q1 UNION ALL SELECT status FROM q2 UNION ALL SELECT status FROM q3),
    n AS (SELECT CASE WHEN count(*) FILTER (WHERE status = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (WHERE status = 'warning') > 0 THEN 'warning' ELSE 'ok' END AS status,
      count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'warning') AS warning, count(*) FILTER (WHERE status = 'critical') AS critical FROM s)
    SELECT *, 'Sante globale: ' || upper(status) || ' - ' || ok || ' OK, ' || warning || ' avertissement(s), ' || critical || ' critique(s).' AS summary FROM n""")
def health_checks(spark, sf_dir):
    """The report over the checks' own statuses."""
    found = [getattr(operations, n)(spark, sf_dir).select("status") for n in ("source_streaks", "parsing_rate", "freshness", "newest_file")]
    return health.report(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]))


@query(f"""SELECT seller, 'BAISSE DE PRIX - s' || seller || chr(10) || replace(format('{{:,}}', CAST(round_even(before, 0) AS BIGINT)), ',', ' ') || '€ -> ' || replace(format('{{:,}}', CAST(round_even(price, 0) AS BIGINT)), ',', ' ') || '€ ('
    || CAST(round(CAST(CAST((price - before) * 100.0::DOUBLE / before AS VARCHAR) AS DECIMAL(38, 20)), 1) AS VARCHAR) || '%)' AS message FROM ({_LAG}) WHERE back = 1 AND price < before AND before > 0""")
def drop_messages(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    back = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    own = views.table(spark, sf_dir, "orders").withColumn("old", F.lag("o_totalprice").over(w)).withColumn("back", F.row_number().over(back)).where("back = 1 and o_totalprice < old and old > 0")
    return own.select(C("o_custkey").alias("seller"), alerts.drop_message(F.concat(F.lit("s"), C("o_custkey").cast("string")), C("old"), C("o_totalprice")).alias("message"))


@query(views.sql("""SELECT day, '*ALERTE SYSTEME*' || chr(10) || '*Evenement:* zero\\_annonces' || chr(10) || '*Detail:* ' || n || ' erreurs' || chr(10) || '*Date:* ' || strftime(day, '%d/%m/%Y') AS message
    FROM (SELECT date_trunc('day', "at") AS day, sum(errors)::BIGINT AS n FROM run_log GROUP BY 1)""", "run_log"))
def system_messages(spark, sf_dir):
    own = views.run_log(spark, sf_dir).groupBy(F.date_trunc("day", "at").cast("timestamp_ntz").alias("day")).agg(F.sum("errors").alias("n"))
    return own.select("day", alerts.system_message(F.lit("zero_annonces"), F.concat(C("n").cast("string"), F.lit(" erreurs")), C("day")).alias("message"))


@query(views.sql(f"""WITH {_SCORED}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM graded), s AS (SELECT sum(scraped)::BIGINT AS scraped, sum(fresh)::BIGINT AS fresh, sum(errors)::BIGINT AS errors, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources FROM run_log)
    SELECT 'DIGEST QUOTIDIEN - 01/12/2001' || chr(10) || 'Top 3 du jour:' || chr(10) || (SELECT string_agg(n || '. ' || district || ' - ' || replace(format('{{:,}}', CAST(round_even(price, 0) AS BIGINT)), ',', ' ') || '€', chr(10) ORDER BY n) FROM t WHERE n <= 3)
      || chr(10) || 'Stats pipeline:' || chr(10) || 'Annonces scrapees: ' || scraped || chr(10) || 'Nouvelles: ' || fresh || chr(10) || 'Erreurs: ' || errors || chr(10) || 'Sources actives: ' || sources AS message FROM s""", "listings", "run_log"))
def digest_message(spark, sf_dir):
    best = graded(spark, sf_dir).orderBy(F.desc("score"), "id").limit(3)
    log = views.run_log(spark, sf_dir).agg(*[F.sum(c).alias(c) for c in ("scraped", "fresh", "errors")], F.array_sort(F.collect_set("source")).alias("sources"))
    return alerts.digest(best, log, views.AS_OF.date())


_MONEY = "replace(format('{{:,}}', CAST(round_even({}, 0) AS BIGINT)), ',', ' ') || '€'"
_RATE = "format('{{:.1f}}%', {})"


@query(views.sql(f"""WITH m AS (SELECT *, 400.0::DOUBLE + id % 500 AS rent, CAST(price AS DOUBLE) AS p, coalesce(CAST(surface AS DOUBLE), 0.0::DOUBLE) AS s FROM listings)
    SELECT id, CASE WHEN id % 2 = 0 THEN '🟢 *TOP OPPORTUNITE*' ELSE '🟡 *BON PLAN*' END || chr(10) || chr(10) || '📍 ' || CASE WHEN id % 10 = 0 THEN 'Adresse inconnue' ELSE address END || ' \\- ' || district || chr(10)
      || '💰 ' || {_MONEY.format('p')} || ' \\(' || {_MONEY.format('CASE WHEN s > 0 THEN p / s ELSE 0 END')} || '/m²\\)' || chr(10) || '📐 ' || CAST(s AS VARCHAR) || 'm² \\- T' || coalesce(rooms, 0) || chr(10) || '🏷️ DPE: ' || energy || chr(10)
      || '📊 Score: ' || CAST((id % 1000) / 8.0::DOUBLE AS VARCHAR) || '/100' || chr(10) || '💸 Renta brute: ' || {_RATE.format('rent * 12.0::DOUBLE * 100.0::DOUBLE / (p * 1.0::DOUBLE)')} || chr(10)
      || CASE WHEN id % 3 = 0 THEN '🏠 Loyer potentiel: ' || CAST(rent AS BIGINT) || '\\-' || CAST(rent + 50 AS BIGINT) || ' EUR/mois \\(nu a meuble\\)' WHEN id % 3 = 1 THEN '🏠 Loyer potentiel: ~' || CAST(rent AS BIGINT) || ' EUR/mois \\(nu\\)' ELSE '🏠 Loyer potentiel: non disponible' END
      || chr(10) || chr(10) || 'Scenarios nego:' || {' || '.join(f"chr(10) || '• {chr(92)}{chr(92)}-{d}%: ' || " + _RATE.format(f'rent * 12.0::DOUBLE * 100.0::DOUBLE / (p * {1 - d / 100.0}::DOUBLE)') + " || ' " + chr(92) * 2 + "(' || " + _MONEY.format(f'p * {(100 - d) / 100}::DOUBLE') + " || '" + chr(92) * 2 + ")'" for d in (5, 10, 15))}
      || CASE WHEN id % 4 = 0 THEN chr(10) || chr(10) || '🤖 *Analyse IA:*' || chr(10) || 'Vue\\! N\\.1' || chr(10) || '• Etat: Bon etat' || chr(10) || '• Signaux nego: urgent, vente\\_rapide' || chr(10) || '⚠️ Red flags: toit' || chr(10) || '• Copro: 100\\.5 EUR/an \\(ce lot\\), copro 12 lots' ELSE '' END
      || chr(10) || chr(10) || '🔗 [Voir l''annonce](' || url || ')' AS message FROM m""".replace(chr(92) * 2, chr(92)), "listings"))
def alert_templates(spark, sf_dir):
    """The whole message of every listing as an alert: address, price, size, energy, score, yields, rents, scenarios, the model's answer and the link."""
    k, rent = C("id"), F.lit(400.0) + C("id") % 500
    answer = F.when(k % 4 == 0, F.from_json(F.lit('{"resume": "Vue! N.1", "etat_bien": "bon_etat", "signaux_nego": ["urgent", "vente_rapide"], "equipements": [], "red_flags": ["toit"], "info_copro": {"charges_annuelles_lot": 0, "charges_annuelles": 100.5, "nb_lots": 12}}'), ads.ANSWER))
    said = messages.alert(
        F.when(k % 2 == 0, "top").otherwise("bon"), F.when(k % 10 != 0, C("address")), C("district"), C("price"), C("surface"), C("rooms"), C("energy"), (k % 1000) / 8.0, {d: finance.gross_yield(C("price"), rent, d) for d in finance.DISCOUNTS},
        F.when(k % 3 < 2, rent), F.when(k % 3 == 0, rent + 50), answer, C("url"),
    )
    return views.listings(spark, sf_dir).select("id", said.alias("message"))

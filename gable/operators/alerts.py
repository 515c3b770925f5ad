"""Alert decisions against a registry of sent alerts, selections of alerts, and their messages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finance, text

LEVELS = ("top", "bon", "veille")


def action(url: Column, sent_price: Column, price: Column) -> Column:
    """new for an unseen or empty URL, drop for a price below the stored one, skip otherwise."""
    return F.when(F.coalesce(url == "", F.lit(True)) | sent_price.isNull(), "new").when(price < sent_price, "drop").otherwise("skip")


def actions(listings: DataFrame, registry: DataFrame) -> DataFrame:
    """listings (url, price, level) with `action`; the registry has a row for each url."""
    stored = registry.select("url", F.col("price").alias("sent_price"))
    return listings.join(stored, "url", "left").withColumn("action", action(F.col("url"), F.col("sent_price"), F.col("price")))


def updated_registry(decided: DataFrame, registry: DataFrame, now: dt.datetime) -> DataFrame:
    """The registry after sending: new and lower prices are stored, the date of the first alert stays."""
    at = F.lit(now).cast("timestamp_ntz")
    sent = decided.where("action != 'skip' and url != ''").groupBy("url").agg(F.min("price").alias("new_price"), F.min_by("level", "price").alias("new_level"))
    both = registry.join(sent, "url", "full")
    return both.select(
        "url", F.coalesce("new_level", "level").alias("level"), F.coalesce("new_price", "price").alias("price"), F.coalesce("first_sent", at).alias("first_sent"),
        F.when(F.col("new_price").isNotNull(), at).otherwise(F.col("last_sent")).alias("last_sent"),
    )


def purge(registry: DataFrame, now: dt.datetime, days: int) -> DataFrame:
    """Entries whose first alert is at most `days` old."""
    return registry.where(F.col("first_sent") >= F.lit(now - dt.timedelta(days=days)).cast("timestamp_ntz"))


def counts_by_level(rows: DataFrame) -> DataFrame:
    """A row for each level, of no alerts too."""
    levels = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string"))
    return levels.join(rows.groupBy("level").agg(F.count("*").alias("n")), "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def first_per_level(rows: DataFrame, order: str, n: int) -> DataFrame:
    w = Window.partitionBy("level").orderBy(order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """The n best by score; ties by level, then id."""
    level = F.when(F.col("level") == "top", 0).when(F.col("level") == "bon", 1).otherwise(2)
    return rows.orderBy(F.desc("score"), level, "id").limit(n)


def message(level: Column, title: Column, district: Column, price: Column, surface: Column, y: Column, score: Column) -> Column:
    """Five lines. Prices are rounded half to even, yield and score half up; without a surface (or with 0) the price of a square metre is 0."""
    head = F.when(level == "top", "TOP OPPORTUNITE").when(level == "bon", "BONNE AFFAIRE").otherwise("VEILLE")
    per = F.when(surface > 0, F.bround(F.try_divide(price, surface)).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.concat_ws(
        "\n", F.concat(head, F.lit(" - "), text.escape_markdown(F.coalesce(title, F.lit("")))), F.concat(F.lit("Quartier: "), text.escape_markdown(F.coalesce(district, F.lit("?")))),
        F.concat(F.lit("Prix: "), text.money(price), F.lit(" ("), per.cast("string"), F.lit("€/m2)")), F.concat(F.lit("Rendement: "), text.percent(y)),
        F.concat(F.lit("Score: "), F.format_string("%.1f", score)),
    )


def drop_message(title: Column, old: Column, new: Column) -> Column:
    """Two lines. A change that rounds to nothing has no sign."""
    diff, pct = finance.price_change(old, new)
    share = F.regexp_replace(text.percent(pct), r"^-(0\.0%)$", "$1")
    return F.concat_ws("\n", F.concat(F.lit("BAISSE DE PRIX - "), text.escape_markdown(title)), F.concat(text.money(old), F.lit(" -> "), text.money(new), F.lit(" ("), share, F.lit(")")))


def selected(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n top and the first n good alerts by `order`; if there is neither, the row of the best score, as a top one."""
    sent = first_per_level(rows.where(F.col("level").isin("top", "bon")), order, n).drop("place")
    best = rows.orderBy(F.desc("score"), order).limit(1).withColumn("level", F.lit("top"))
    some = F.broadcast(sent.limit(1).select(F.lit(1).alias("_some")))
    return sent.unionByName(best.join(some, F.lit(True), "left_anti"))


def system_message(event: Column, detail: Column, at: Column) -> Column:
    return F.concat_ws(
        "\n", F.lit("*ALERTE SYSTEME*"), F.concat(F.lit("*Evenement:* "), text.escape_markdown(event)), F.concat(F.lit("*Detail:* "), detail), F.concat(F.lit("*Date:* "), F.date_format(at, "dd/MM/yyyy")),
    )


def digest(best: DataFrame, stats: DataFrame, day: dt.date) -> DataFrame:
    """The day's message as one row: a few best listings (id, district, price, score) and the pipeline's numbers (one row: scraped, fresh, errors, sources)."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # the few rows of a report
    lines = best.select(place.alias("n"), F.concat(place.cast("string"), F.lit(". "), F.coalesce("district", F.lit("?")), F.lit(" - "), text.money(F.col("price"))).alias("line"))
    listed = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("listed"))
    said = F.when(F.col("listed") == "", "Aucune opportunite aujourd'hui.").otherwise(F.col("listed"))
    count = lambda words, c: F.concat(F.lit(words), F.coalesce(F.col(c), F.lit(0)).cast("string"))
    return stats.crossJoin(listed).select(F.concat_ws(
        "\n", F.lit(f"DIGEST QUOTIDIEN - {day:%d/%m/%Y}"), F.lit("Top 3 du jour:"), said, F.lit("Stats pipeline:"), count("Annonces scrapees: ", "scraped"), count("Nouvelles: ", "fresh"), count("Erreurs: ", "errors"),
        F.when(F.size("sources") > 0, F.concat(F.lit("Sources actives: "), F.array_join("sources", ", "))),
    ).alias("message"))

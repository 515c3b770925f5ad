"""Golden values of the column expressions."""

import datetime as dt
import difflib

import pytest
from gable.config import DedupConfig
from gable.functions import dates, finance, geo, text
from gable.operators import dedup, observatory, validation
from gable.sources import listings
from pyspark.sql import functions as F


def values(spark, expression, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("expression", "given", "expected"),
    [
        (text.surface_text, ["42 m²", "42.5m²", "42,5 m2", "grand", None], [42.0, 42.5, 42.5, None, None]),
        (text.surface_in_text, ["appart 42,5 m2 net", "no"], [42.5, None]),
        (text.energy_any, ["c", "", "X", "NON COMMUNIQUE", None], ["C", None, None, "C", None]),
        (text.energy_strict, ["DPE: d", "NON COMMUNIQUE", "G", "classe :  c ", "BC"], ["D", None, "G", "C", None]),
        (text.floor_number, ["3ème étage", "RDC", "1er", "rez-de-chaussée", "dernier"], [3, 0, 1, 0, None]),
        (text.first_int, ["T3", "3 pièces", "studio"], [3, 3, None]),
        (text.digits_to_int, ["145 000 €", "145,000", "", None], [145000, 145000, None, None]),
        (text.amount, ["1.234,56", "99,5 €", "x"], [None, 99.5, None]),
        (text.amount_last_separator, ["1.234,56", "1.500", "12", "x", "5-7 €", "120 € / mois", "1.5.", ","], [1234.56, 1.5, 12.0, None, 57.0, 120.0, 15.0, None]),
        (text.html_text, ["Ligne 1<br/>Ligne 2", "a &amp; b", "<p> </p>", "a\n\n\n\nb", "&egrave;&euro;&#8217;&#x41;&notit; &lt;b&gt;", None], ["Ligne 1\nLigne 2", "a & b", None, "a\n\nb", "è€’A¬it; <b>", None]),
        (text.valid_url, ["https://a.b/c", "ftp://a.b", "http://localhost", None], [True, False, False, False]),
        (text.escape_markdown, ["a_b.c", "x!", "a, b\\"], ["a\\_b\\.c", "x\\!", "a, b\\\\"]),
        (text.escape_markdown_once, ["a\\_b_c", "*x* [y](z) `q`"], ["a\\_b\\_c", "*x* [y](z) \\`q\\`"]),
        (text.mask_password, ["postgresql://u:p@h/d"], ["postgresql://u:***@h/d"]),
        (text.url_in_text, ["see https://a.b/c)."], ["https://a.b/c"]),
        (text.address_form, ["12 r. de la republique", "  ", "3 bd carnot"], ["12 Rue de la Republique", None, "3 Boulevard Carnot"]),
        (text.address_key, ["12 Avenue de la République, 25000", "", None], ["12 av republique 25000", "", ""]),
    ],
)
def test_text(spark, expression, given, expected):
    assert values(spark, expression, given) == expected


def test_canonical_urls(spark):
    same = ["https://Www.Ex.fr/v/1.htm?utm_source=a&b=2&a=1#x", "https://www.ex.fr/v/1.htm?a=1&b=2&REF=z", "https://www.ex.fr/v/1.htm?b=2&a=1"]
    assert set(values(spark, text.canonical_url, same)) == {"https://www.ex.fr/v/1.htm?a=1&b=2"}
    assert values(spark, text.canonical_url, ["http://a.b/", "http://a.b/x/"]) == ["http://a.b/", "http://a.b/x"]
    assert len(set(values(spark, text.url_hash, same))) == 1


def test_dates(spark):
    day = dt.date(2026, 3, 10)
    given = ["Aujourd'hui", "hier", "2026-03-09", "2026-03-09T14:30:00", "10/03/2026", "1-2-2026", "10 mars 2026", "3 Août 2025", "31/02/2026", "soon", None, "aujourd hui", " AUJOURDHUI ", "2026-03-10T99:99:99", "2026-03-10 14:30:00", "2026-02-30T10:00:00"]
    found = values(spark, lambda c: dates.listing_date(c, day), given)
    assert found == [dt.datetime(2026, 3, 10), dt.datetime(2026, 3, 9), dt.datetime(2026, 3, 9), dt.datetime(2026, 3, 9, 14, 30), dt.datetime(2026, 3, 10), dt.datetime(2026, 2, 1), dt.datetime(2026, 3, 10), dt.datetime(2025, 8, 3), None, None, None, dt.datetime(2026, 3, 10), dt.datetime(2026, 3, 10), None, dt.datetime(2026, 3, 10), None]


def test_decay(spark):
    now = dt.datetime(2026, 3, 10)
    found = values(spark, lambda c: dates.decay(c, now, 30.0, 0.5), [now, now - dt.timedelta(days=30), now - dt.timedelta(days=90), now + dt.timedelta(days=9), None], "timestamp_ntz")
    assert found == pytest.approx([1.0, 0.5, 0.125, 1.0, 0.5])


def test_finance(spark):
    one = spark.range(1)
    y = [one.select(finance.gross_yield(F.lit(150_000.0), F.lit(600.0), d)).first()[0] for d in finance.DISCOUNTS]
    assert [round(v, 2) for v in y] == [4.8, 5.05, 5.33, 5.65]
    assert one.select(finance.gross_yield(F.lit(0.0), F.lit(600.0)), finance.gross_yield(F.lit(1.0), F.lit(-1.0)), finance.simple_yield(F.lit(0.0), F.lit(1.0))).first() == (None, None, 0.0)
    assert values(spark, finance.yield_score, [3.0, 13.0, 8.0], "double") == [0.0, 100.0, 50.0]
    assert values(spark, finance.energy_score, ["A", "B", "C", "D", "E", None, "a"]) == [100.0, 85.0, 65.0, 40.0, 0.0, 30.0, 100.0]
    assert values(spark, finance.vacancy_score, [0.85, 0.3, 0.5, None], "double") == [90.0, 30.0, 60.0, 60.0]
    assert values(spark, finance.any_drop, [[160, 145], [145, 160], [], [1]], "array<int>") == [True, False, False, False]
    assert values(spark, finance.last_drop, [[160, 145], [5, 1, 2], [0, -1], []], "array<int>") == [True, False, False, False]
    levels = [(85.0, 5.0, 5.0), (50.0, 8.5, 8.5), (70.0, 5.0, 5.0), (40.0, 5.0, 8.5), (40.0, 5.0, 6.0)]
    df = spark.createDataFrame(levels, "s double, y double, b double")
    assert [r[0] for r in df.select(finance.alert_level(F.col("s"), F.col("y"), F.col("b"))).collect()] == ["top", "top", "bon", "bon", "veille"]
    assert one.select(finance.surface_adjusted(F.lit(580.0), F.lit("T3"), F.lit(55.0)), finance.surface_adjusted(F.lit(100.0), F.lit("T1"), F.lit(100.0))).first() == (580.0, pytest.approx(115.0))
    same = [finance.surface_adjusted(F.lit(500.0), F.lit(k), F.lit(s).cast("double")) for k, s in (("T1", 0.0), ("T1", -3.0), ("T9", 40.0), ("T2", None))]
    assert one.select(*same).first() == (500.0,) * 4
    parts = {"yield": F.lit(10.0), "location": F.lit(70.0), "energy": F.lit(65.0), "negotiation": F.lit(30.0), "vacancy": F.lit(90.0)}
    assert one.select(finance.composite(parts)).first()[0] == pytest.approx(43.25)
    tax = finance.fiscal(F.lit(7200.0), F.lit(None).cast("double"))
    assert one.select(tax["regime"], tax["furnished_taxable"], tax["bare_taxable"]).first() == ("lmnp", 3600.0, pytest.approx(5040.0))


def test_geo(spark):
    one = spark.range(1)
    d = one.select(geo.haversine(F.lit(48.8566), F.lit(2.3522), F.lit(45.764), F.lit(4.8357)), geo.haversine(F.lit(47.0), F.lit(6.0), F.lit(47.0), F.lit(6.0))).first()
    assert d[0] == pytest.approx(392_000, rel=0.02) and d[1] == 0
    from gable.plans.geo import nearest

    df = spark.createDataFrame([(47.2378, 6.0241), (47.2410, 6.0180), (48.8566, 2.3522)], "lat double, lon double")
    assert [r["district"] for r in nearest(df).select("district").collect()] == ["Centre-Ville", "Battant", None]


def test_validation(spark):
    rows = [(5000.0, 55.0, 3, "C", "https://a.fr/1", "25000 Besancon"), (10000.0, 10.0, 1, None, "https://a.fr/1", "Besançon"), (500000.0, 300.0, 10, "G", "https://a.fr/1", "x 25000"), (None, 5.0, 0, "Z", "bad", "75001 Paris")]
    df = spark.createDataFrame(rows, "p double, s double, r int, e string, u string, a string")
    found = [r[0] for r in df.select(validation.sale_reasons(*map(F.col, "psreua"))).collect()]
    assert found == [["price low"], [], [], ["price missing", "surface low", "rooms low", "energy invalid", "url invalid", "address outside"]]
    ok, bad = validation.split(df, validation.sale_reasons(*map(F.col, "psreua")))
    assert (ok.count(), bad.count()) == (2, 2)


def test_bounds_hold_after_truncation_and_energy_is_a_capital(spark):
    rows = [(500_000.9, 10.0, 10.9, "c"), (9_999.9, 300.5, 0.9, "C"), (-0.5, 20.0, 1.0, None)]
    df = spark.createDataFrame(rows, "p double, s double, r double, e string").withColumns({"u": F.lit("https://a.fr/1"), "a": F.lit("Besançon")})
    assert [r[0] for r in df.select(validation.sale_reasons(*map(F.col, "psreua"))).collect()] == [["energy invalid"], ["price low", "surface high", "rooms low"], ["price low"]]


def test_rounding_and_completeness_are_pythons(spark):
    import random

    rng = random.Random(7)
    given = [rng.choice([rng.uniform(-3000, 3000), round(rng.uniform(0, 3000), 3), rng.randint(0, 4000) / 8, 500.5 * 1.15, 2.675, -2.675, 0.125, 1e15 + 0.3]) for _ in range(4000)]
    assert values(spark, text.round_half_even, given, "double") == [round(x, 2) + 0.0 for x in given]
    fields = [F.when(F.col("x") > i, F.lit("v")).otherwise(F.lit("\t\n ")) for i in range(8)]
    assert values(spark, lambda c: text.completeness(*fields), list(range(9)), "int") == [round(n / 8, 2) for n in range(9)]


def test_estimates_are_adjusted_for_the_surface(spark):
    rows = [("Battant", "T1", False, 100.0, "Battant"), ("Battant", "T1", False, 25.0, "Battant"), ("Other", "T1", True, 100.0, "Battant"), ("Battant", "T7", False, 100.0, "None")]
    asked = spark.createDataFrame(rows, "district string, kind string, furnished boolean, surface double, matched string")
    ref = spark.createDataFrame([("Battant", "T1", False, 500.0, 9), ("Other", "T1", True, 900.0, 4)], "district string, kind string, furnished boolean, rent_median double, n int")
    fall = spark.createDataFrame([("Battant", "T1", True, 430.0)], "district string, kind string, furnished boolean, fallback double")
    found = [(r["estimate"], r["reliability"]) for r in observatory.estimate(asked, ref, fall).orderBy("kind", "district", "surface").collect()]
    assert found == [(500.0, "fiable"), (575.0, "fiable"), (494.5, "preliminaire"), (None, "indisponible")]


def test_prices_of_ads_are_numbers_or_lists(spark):
    given = ["1000", "[1000]", "[1000.9, 5]", "1000.7", '["1000"]', '["x"]', "[]", '"1000"', "null", '{"a": 1}', "true", "-3.9"]
    rows = [(i, f'{{"list_id": {i}, "price": {p}, "attributes": null, "location": "x"}}') for i, p in enumerate(given)] + [(99, "{}")]
    df = spark.createDataFrame(rows, "i int, x string").select("i", F.parse_json("x").alias("ad"))
    assert [r["price"] for r in listings.flatten_variant(df).orderBy(F.asc_nulls_last("list_id")).collect()] == [1000, 1000, 1000, 1000, 1000, None, None, None, None, None, 1, -3, None]


def test_values_of_ads_fail_by_path(spark):
    ad = """{"list_id": "7", "price": [95000.5], "subject": {"no": 1}, "index_date": "2026-03-01", "attributes": [{"key": "square", "value": "40,5"}, {"key": "square", "value": 41}, {"key": "rooms", "value": "x"},
        {"key": "energy_rate", "value": "Vierge"}, {"key": "ges", "value": "b"}, {"key": "old_price", "value": "0"}, {"key": "annual_charges", "value": ""}, {"key": "charges_included", "value": "12,5"}, {"key": "furnished", "value": "2"}, 5, {"value": "no key"}],
        "location": {"address": "", "city": "Besançon", "zipcode": 25000, "lat": 47.2, "lng": 0}, "images": null, "body": ""}"""
    df = spark.createDataFrame([(ad,)], "x string").select(F.parse_json("x").alias("ad"))
    (row,) = listings.flatten_variant(df, letting=True).collect()
    assert (row["price"], row["rent"], row["surface"], row["rooms"], row["energy"], row["emissions"], row["charges"], row["furnished"]) == (95000, 95000.0, 41.0, None, None, "B", 12.5, False)
    assert (row["address"], row["lat"], row["lon"], row["photos"], row["description"], [tuple(h) for h in row["history"]]) == ("Besançon, 25000", None, None, [], None, [(0, None), (95000, "2026-03-01")])
    (row,) = listings.flatten_variant(df).collect()
    assert (row["rent"], row["furnished"]) == (None, None)


def test_reasons_in_words(spark):
    ads = ['{"p": "5", "s": [1], "r": {}}', '{"p": 0, "s": 5, "r": 0}', '{"p": 5000.9, "s": 12345678.25, "r": 11.9}', '{"p": 600000, "s": null, "r": true}', '{"p": 150.5, "s": 20, "r": 2}']
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ads)], "i int, x string").select("i", F.parse_json("x").alias("v"))
    p, s, r = (F.try_variant_get("v", f"$.{c}", "variant") for c in "psr")
    url = F.when(F.col("i") == 1, "  ").when(F.col("i") == 2, "ftp://a").otherwise("https://a.fr/1")
    address = F.when(F.col("i") == 1, None).when(F.col("i") == 2, "75001 Paris").otherwise("25000 B")
    energy = F.when(F.col("i") == 2, "c")
    sale = [x[0] for x in df.orderBy("i").select(validation.sale_variant_texts(p, s, r, energy, url, address)).collect()]
    assert sale == [
        ["prix invalide (type str)", "surface invalide (type list)", "nb_pieces invalide (type dict)"],
        ["prix negatif ou nul (0)", "surface trop petite (5.0 < 10.0)", "nb_pieces trop petit (0 < 1)", "url_source manquante ou vide", "adresse manquante ou vide"],
        ["prix trop bas (5000 < 10000)", "surface trop grande (12345678.25 > 300.0)", "nb_pieces trop grand (11 > 10)", "dpe invalide ('c' hors A-G)", "url_source invalide (ftp://a)", "adresse hors Besancon ('75001 Paris' ne contient pas 'Besancon'/'Besançon' ni CP 25xxx)"],
        ["prix trop eleve (600000 > 500000)", "surface manquante"], ["prix trop bas (150 < 10000)"],
    ]
    rent = [x[0] for x in df.orderBy("i").select(validation.rent_variant_texts(p, s, r, url, address)).collect()]
    assert rent[0][0] == "loyer_cc invalide (type str)" and rent[1][0] == "loyer negatif ou nul (0.0)" and rent[2][0] == "loyer trop eleve (5000.9 > 3000.0)" and rent[4] == ["loyer trop bas (150.5 < 200.0)"]


def pairs(spark, rows, exact=True):
    df = spark.createDataFrame(rows, "rank int, address string, surface double, price double").withColumn("key", text.address_key(F.col("address")))
    return {r["rank"]: r["duplicates"] for r in dedup.fuzzy_duplicates(df, exact=exact).collect()}


@pytest.mark.parametrize(
    ("other", "expected"),
    [
        (("12 Rue de la Republique", 55.0, 145000.0), True), (("99 Quai Vauban", 20.0, 50000.0), False), (("12 Rue de la Republique", 90.0, 147900.0), True),
        (("12 Rue de la Republique", 55.0, 200000.0), True), (("12 Rue de la Republique", 56.5, 300000.0), True), (("12 Rue de la Republique", 60.0, 200000.0), False),
        (("12 rue de la République", 55.0, 145000.0), True), (("", 55.0, 145000.0), False),
    ],
)
def test_fuzzy_pairs(spark, other, expected):
    assert (pairs(spark, [(1, "12 Rue de la Republique", 55.0, 145000.0), (2, *other)]) == {2: [1]}) is expected


def test_bands_lose_no_pair(spark):
    rows = [(i, "1 Rue A", float((i * 37) % 90), float(10_000 + (i * 7919) % 60_000)) for i in range(250)]
    config = DedupConfig()
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (abs(a[2] - b[2]) <= config.surface_m2 or abs(b[3] - a[3]) * 100 <= a[3] * config.price_pct)}
    df = spark.createDataFrame(rows, "rank int, key string, surface double, price double")
    found = [(r["rank_a"], r["rank_b"]) for r in dedup.band_candidates(df).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_ratio_keeps_argument_order(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "a"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(dedup.sequence_ratio("a", "b")).collect()] == [difflib.SequenceMatcher(None, "tide", "diet").ratio(), difflib.SequenceMatcher(None, "diet", "tide").ratio(), 0.0, 0.0]


def rents(spark, values):
    now = dt.datetime(2026, 3, 10)
    return spark.createDataFrame([("Battant", 2, False, float(v), 40.0, now - dt.timedelta(days=2 * i)) for i, v in enumerate(values)], "district string, rooms int, furnished boolean, rent double, surface double, seen_at timestamp_ntz")


@pytest.mark.parametrize(("given", "kept", "reliability"), [([450, 460, 470, 480, 490, 500, 510, 520], 8, "fiable"), ([450, 460, 470], 3, "preliminaire"), ([450, 460, 470, 480, 490, 500, 510, 520, 1500], 8, "fiable"), ([50, 450, 460, 470, 480, 490, 500, 510, 520, 2000], 8, "fiable"), ([500] * 5, 5, "fiable"), ([100, 500, 1000], 3, "preliminaire")])
def test_segment_medians(spark, given, kept, reliability):
    (row,) = observatory.medians(rents(spark, given), dt.datetime(2026, 3, 10)).collect()
    assert (row["n"], row["reliability"]) == (kept, reliability) and min(given) <= row["rent_median"] <= 1000


def test_no_rents_no_segments(spark):
    assert observatory.medians(rents(spark, [1]).where("false"), dt.datetime(2026, 3, 10)).count() == 0


def test_sources(spark):
    page = '<html><script id="__NEXT_DATA__" type="x">{"n": 3}</script><div class="card big"><a href="/v/1">One</a> <b>42 m2</b></div><div class="card">none</div></html>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert df.select(listings.embedded_json(F.col("html"), "n int")["n"]).collect()[0][0] == 3
    assert [tuple(r) for r in listings.cards(df, "card").collect()] == [(1, 0, "/v/1", "One 42 m2")]
    linked = '<script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{bad</script>'
    assert values(spark, listings.linked_data, [linked]) == [['{"a": 1}']]
    ad = '{"list_id": 7, "price": [1000], "attributes": [{"key": "square", "value": "40"}, {"key": "square", "value": "41"}, {"key": "rooms", "value": "x"}], "location": {"city": "Besançon"}}'
    (row,) = listings.flatten_ad(spark.createDataFrame([(ad,)], "x string").select(F.from_json("x", listings.AD).alias("ad"))).collect()
    assert (row["list_id"], row["price"], row["surface"], row["rooms"], row["address"], row["history"]) == (7, 1000, 41.0, None, "Besançon", [])


def test_landed_api_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"ads": [{"list_id": 1, "subject": "a"}, {"list_id": 2}]}')
    assert [r["ad"]["list_id"] for r in listings.read_api_pages(spark, str(tmp_path)).collect()] == [1, 2]

"""Landed searches, selectors, versioned tables and messages against brute force and golden values."""

import datetime as dt
import random

import pytest
from gable.functions import messages
from gable.operators import spatial
from gable.sources import elements, listings, versions
from pyspark.sql import functions as F


def test_searches_stop_where_a_page_failed(spark):
    page = lambda n, pivot='"p"', more="": f'{{"ads": [{", ".join(str(i) for i in range(n))}], "pivot": {pivot}{more}}}'
    landed = {
        "all": [(1, 200, page(2)), (2, 200, page(3)), (3, 200, page(1, "null")), (4, 200, page(9))], "first failed": [(1, 500, page(2)), (2, 200, page(2))], "later failed": [(1, 200, page(2)), (2, 403, page(2)), (3, 200, page(2))],
        "no json": [(1, 200, page(1)), (2, 200, "{"), (3, 200, page(1))], "empty": [(1, 200, page(1)), (2, 200, page(0)), (3, 200, page(1))], "gap": [(1, 200, page(1)), (3, 200, page(1))], "not begun": [(2, 200, page(1))],
        "limit": [(i, 200, page(1)) for i in range(1, 9)], "own limit": [(i, 200, page(1, more=', "max_pages": 2')) for i in range(1, 5)], "null": [(1, 200, None), (2, None, page(1))], "object": [(1, 200, '{"ads": {"a": 1}}'), (2, 200, page(1))],
    }
    df = spark.createDataFrame([(k, *r) for k, rows in landed.items() for r in rows], "search string, page int, status int, body string").repartition(3)
    found = {}
    for r in listings.searched(df).groupBy("search", "page").count().collect():
        found.setdefault(r["search"], {})[r["page"]] = r["count"]
    one = {i: 1 for i in range(1, 6)}
    assert found == {"all": {1: 2, 2: 3, 3: 1}, "later failed": {1: 2}, "no json": {1: 1}, "empty": {1: 1}, "gap": {1: 1}, "limit": one, "own limit": {1: 1, 2: 1}}
    assert listings.searched(df.where("false")).count() == 0


def test_rules_of_all_agents(spark):
    content = "Disallow: /before\nUser-agent: a\nDisallow: /a\nuser-agent:*\r\nDISALLOW:  /x  \nDisallow:\nUser-agent: b\nDisallow: /b\nUser-Agent: *\nDisallow: /y:z"
    files = spark.createDataFrame([("h", content), ("none", None), ("many", "User-agent: *\n" + "\n".join(f"Disallow: /{i}/" for i in range(1500)))], "host string, content string")
    rules = listings.robots_rules(files)
    assert sorted(r["prefix"] for r in rules.where("host = 'h'").collect()) == ["/x", "/y:z"] and rules.where("host = 'many'").count() == 1500
    pages = spark.createDataFrame([("h", "/x1"), ("h", "/X"), ("h", "/b"), ("h", None), ("none", "/x"), ("many", "/1499/a"), ("many", "/1500/a"), ("many", "/1500/a"), (None, "/x")], "host string, path string")
    found = sorted((r["host"] or "", r["path"] or "") for r in listings.allowed_by(pages, rules, F.col("host"), F.col("path")).collect())
    assert found == [("", "/x"), ("h", ""), ("h", "/X"), ("h", "/b"), ("many", "/1500/a"), ("many", "/1500/a"), ("none", "/x")]


@pytest.mark.parametrize("radius", [300.0, 400_000.0])
def test_near_points_equal_brute_force(spark, radius):
    """Around a town, and over the whole earth with the poles and the date line."""
    import numpy as np

    rng = np.random.default_rng(3)
    place = (lambda n: (rng.uniform(47.2, 47.26, n), rng.uniform(5.98, 6.06, n))) if radius < 1000 else (lambda n: (np.append(rng.uniform(-90, 90, n - 4), [90, -90, 10, 10]), np.append(rng.uniform(-180, 180, n - 4), [0, 0, 179.9, -179.9])))
    a, b = place(400), place(900)
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(*a))] + [(-1, None, 6.0)], "id long, lat double, lon double")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(*b))] + [(-1, 47.2, None)], "id long, lat double, lon double")
    la, lo, lb, ln = (np.radians(v) for v in (a[0][:, None], a[1][:, None], b[0][None], b[1][None]))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((ln - lo) / 2) ** 2
    m = 2 * 6_371_000.0 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))
    expected = {(i, j) for i, j in zip(*np.nonzero(m <= radius))}
    found = spatial.near_points(rows, points, radius).select("id", "point_id").collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected and len(expected) > 100
    best = {r["id"]: r["point"] for r in spatial.nearest_point(rows, points, "id", "id", radius).collect()}
    assert best == {-1: None} | {i: int(m[i].argmin()) if m[i].min() <= radius else None for i in range(400)}


def test_catalogue_of_real_files(spark, tmp_path):
    import os

    from gable.operators import maintenance

    for i, name in enumerate(("a.bin", "in/b.bin", "in/c.bin")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * (i + 1))
        os.utime(tmp_path / name, (1_700_000_000 + 3600 * i,) * 2)
    found = maintenance.files(spark, f"file://{tmp_path}")
    assert {(r["path"].rpartition("/")[2], r["size"]) for r in found.collect()} == {("a.bin", 1), ("b.bin", 2), ("c.bin", 3)}
    newest = maintenance.newest(found, dt.datetime(2023, 11, 15), 48).first()
    assert newest["path"].endswith("c.bin") and newest["status"] == "ok"
    kept = maintenance.keep_newest(found.withColumn("all", F.lit(1)), "all", ["modified", "path"], 2)
    assert {r["path"].rpartition("/")[2] for r in kept.collect()} == {"b.bin", "c.bin"}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_selectors_equal_brute_force():
    """Random pages; a selector's elements are those whose chain of ancestors has its steps in order."""
    rng = random.Random(4)

    def tree(depth):
        tag, cls, attr = rng.choice(["div", "span", "b"]), rng.choice(["", "x", "y", "x y"]), rng.choice([None, "", "1", "2"])
        return tag, cls, attr, [tree(depth - 1) if depth and rng.random() < 0.7 else f"t{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))]

    def html(node):
        if isinstance(node, str):
            return node
        tag, cls, attr, inside = node
        return f"<{tag} class='{cls}'{'' if attr is None else f' data-n={chr(34)}{attr}{chr(34)}'}>{' '.join(map(html, inside))}</{tag}>"

    def texts(node):
        return [node] if isinstance(node, str) else [t for x in node[3] for t in texts(x)]

    def fits(node, step):
        tag, cls, attr = step
        return (tag in ("*", node[0])) and (not cls or cls in node[1].split()) and (attr is None or node[2] is not None and (attr == "" or node[2] == attr))

    def found(node, steps, above):
        if isinstance(node, str):
            return []
        own = []
        if fits(node, steps[-1]):
            left = list(steps[:-1])
            for a in reversed(above):
                if left and fits(a, left[-1]):
                    left.pop()
            own = [] if left else [" ".join(" ".join(texts(node)).split())]
        return own + [x for child in node[3] for x in found(child, steps, [*above, node])]

    for _ in range(300):
        root = ("div", "", None, [tree(4) for _ in range(3)])
        steps = [(rng.choice(["div", "span", "*"]), rng.choice(["", "x"]), rng.choice([None, None, "", "1"])) for _ in range(rng.randint(1, 3))]
        selector = " ".join(t + (f".{c}" if c else "") + ("" if a is None else "[data-n]" if a == "" else f"[data-n='{a}']") for t, c, a in steps)
        got = [" ".join(" ".join(e.parts).split()) for e in elements._Page(html(root)).select(elements.compile_selector(selector))]
        assert got == found(root, steps, []), (selector, html(root))
    for bad in ("", "a >", "[x"):
        with pytest.raises(ValueError):
            elements.compile_selector(bad)


def test_cards_and_pages_by_selectors(spark):
    page = "<ul><li class='card big'><a href='/1'>One &amp; 1</a><br>42 m2<li class=card>none</ul><script>var x = '<li class=card>';</script><p>a<p>b<div><p>c</div>d"
    df = spark.createDataFrame([(1, page, "kept"), (2, None, "kept"), (3, "", "kept")], "page_id long, html string, place string").drop("place")
    cards = elements.select(df, "li.card", {"href": ("a", "href"), "text": ("a", None)}).orderBy("place").collect()
    assert [(r["page_id"], r["place"], r["found"]) for r in cards] == [(1, 0, {"href": ["/1"], "text": ["One & 1"]}), (1, 1, {"href": [], "text": []})]
    whole = {r["page_id"]: r["found"] for r in elements.select(df, "", {"p": ("p", None)}).collect()}
    assert whole == {1: {"p": ["a", "b", "c"]}, 3: {"p": []}}
    detail = """<div data-test-id="ad-description"> Calme<br>et <b>clair</b> </div><div data-test-id="ad-dpe">DPE : d</div><img data-test-id="ad-photo" src="/a"><img data-test-id="ad-photo"><time>x</time><time datetime="2026-03-01">y</time>
        <div data-qa-id="criteria_item"><div data-qa-id="criteria_item_label">Étage</div><div data-qa-id="criteria_item_value">3e</div></div><div data-qa-id="criteria_item"><div data-qa-id="criteria_item_label">GES</div><div data-qa-id="criteria_item_value">B</div></div>"""
    pages = spark.createDataFrame([(1, detail), (2, "<p>nothing</p>")], "page_id long, html string")
    first, second = elements.detail_pages(pages, F.lit(False)).orderBy("page_id").collect()
    assert (first["description"], first["energy"], first["photos"], first["published"], first["floor"]) == ("Calme et clair", "D", ["/a"], "2026-03-01", 3)
    assert (second["description"], second["energy"], second["photos"], second["published"], second["floor"]) == (None, None, [], None, None)


def test_versions_are_whole_and_stay_readable(spark, tmp_path):
    table = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string, `at here` timestamp_ntz")
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2026, 3, 1)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.append(rows((1, "a", old), (2, "b", new))) == 1
    assert table.upsert(rows((2, "B", new), (3, "c", None)), ["k"], keep=["at here"]) == 2
    assert table.seed(rows((3, "no", new), (4, "d", old)), ["k"]) == 3
    assert table.purge("at here", dt.datetime(2026, 3, 10), 60) == 4
    keys = lambda n: sorted((r["k"], r["v"]) for r in table.read(n).collect())
    assert [keys(n) for n in table.versions()] == [[(1, "a"), (2, "b")], [(1, "a"), (2, "B"), (3, "c")], [(1, "a"), (2, "B"), (3, "c"), (4, "d")], [(2, "B"), (3, "c")]]
    assert keys(None) == keys(4)
    with pytest.raises(ValueError, match="columns"):
        table.append(spark.range(1))
    with pytest.raises(FileNotFoundError):
        table.read(9)
    assert table.versions() == [1, 2, 3, 4]


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    table.commit(spark.range(3))

    def killed(manifest, version):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            table.commit(spark.range(100))
    assert table.read().count() == 3 and table.versions() == [1]
    # of two writers that begin from one version the later gets an error, and nothing is lost
    other, known = versions.VersionedTable(spark, f"file://{tmp_path}/t"), table.versions()
    monkeypatch.setattr(other, "versions", lambda: known)
    assert table.append(spark.range(3, 5)) == 2
    with pytest.raises(versions.WriteConflict):
        other.append(spark.range(9, 10))
    assert sorted(r[0] for r in table.read().collect()) == [0, 1, 2, 3, 4]


def test_whole_messages(spark):
    rows = [(1, "top", "12 rue X", "Battant", 145_000, 45.5, 2, "C", 81.26, 600.5, 650.0), (2, "bon", None, None, None, 0.0, None, None, 0.25, None, None), (3, "veille", "a", "b", 1, 1.0, 1, "A", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, level string, address string, district string, price int, surface double, rooms int, energy string, score double, bare double, furnished double")
    answer = F.when(F.col("id") == 1, F.from_json(F.lit('{"resume": "Bien (calme).", "etat_bien": "superbe", "equipements": ["cave", "wc-2"], "info_copro": {"charges_annuelles_lot": 900.0}}'), listings.ANSWER))
    yields = {0: F.lit(8.25), 5: F.lit(8.35), 10: F.lit(None).cast("double"), 15: F.lit(9.75)}
    said = {r["id"]: r["m"] for r in df.select("id", messages.alert(*map(F.col, ("level", "address", "district", "price", "surface", "rooms", "energy", "score")), yields, F.col("bare"), F.col("furnished"), answer, F.lit("https://a.fr/1")).alias("m")).collect()}
    assert said[1].split("\n") == [
        "🟢 *TOP OPPORTUNITE*", "", "📍 12 rue X \\- Battant", "💰 145 000€ \\(3 187€/m²\\)", "📐 45.5m² \\- T2", "🏷️ DPE: C", "📊 Score: 81.26/100", "💸 Renta brute: 8.2%", "🏠 Loyer potentiel: 600\\-650 EUR/mois \\(nu a meuble\\)", "",
        "Scenarios nego:", "• \\-5%: 8.3% \\(137 750€\\)", "• \\-10%: 0.0% \\(130 500€\\)", "• \\-15%: 9.8% \\(123 250€\\)", "", "🤖 *Analyse IA:*", "Bien \\(calme\\)\\.", "• Etat: superbe", "• Equipements: cave, wc\\-2", "• Copro: 900\\.0 EUR/an \\(ce lot\\)", "",
        "🔗 [Voir l'annonce](https://a.fr/1)",
    ]
    assert said[2].startswith("🟡 *BON PLAN*\n\n📍 Adresse inconnue \\- Quartier inconnu\n💰 0€ \\(0€/m²\\)\n📐 0.0m² \\- T0\n🏷️ DPE: N/A\n📊 Score: 0.25/100\n") and "non disponible" in said[2] and "Analyse" not in said[2]
    assert said[3] is None
    one = spark.range(1)
    lower = one.select(messages.price_drop(F.lit("a"), F.lit("b"), F.lit(40.0), F.lit(2), F.lit(160_000), F.lit(145_000), F.lit("u"))).first()[0]
    assert lower.split("\n") == ["📉 *BAISSE DE PRIX*", "", "📍 a \\- b", "📐 40.0m² \\- T2", "", "Ancien prix: 160 000€", "Nouveau prix: 145 000€", "Baisse: \\-15 000€ \\(\\-9.4%\\)", "", "🔗 [Voir l'annonce](u)"]
    event = one.select(messages.event(F.lit("zero_annonces"), F.lit("x"), F.lit(dt.datetime(2026, 3, 10, 7, 5)))).first()[0]
    assert event == "⚠️ *ALERTE SYSTEME*\n\n*Evenement:* zero_annonces\n*Detail:* x\n*Date:* 10/03/2026 07:05"


def test_urls_resolve_as_urljoin_does(spark):
    from urllib.parse import urljoin

    rng = random.Random(12)
    parts = ["a", "b", ".", "..", "", "c.htm", "x y"]
    refs = ["g", "./g", "g/", "/g", "//h2.org", "//h2.org/p?q", "?y", "g?y", "#s", "g#s", "g?y#s", "..", "../", "../g", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "mailto:x@y.z", "http://z.org/../q", "https://z.org", "g;x=1/./y"]
    refs += [rng.choice(["", "/"]) + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) + rng.choice(["", "?q=1", "#f", "?q/../x#f"]) for _ in range(600)]
    bases = ["http://a.org/b/c/d;p?q", "https://a.org", "https://a.org/", "https://a.org/b/../c/d/?x=/y", "http://a.org/b/c#f"]
    pairs = [(r, rng.choice(bases)) for r in refs if r and (r.startswith("//h") or not r.startswith("//")) and "//" not in r.partition("?")[0].removeprefix("//").replace("://", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, u string, b string")
    got = [r[0] for r in df.orderBy("i").select(listings.absolute_url(F.col("u"), F.col("b"))).collect()]
    assert [(p, g) for p, g in zip(pairs, got)] == [(p, urljoin(p[1], p[0])) for p in pairs] and len(pairs) > 300
    odd = spark.createDataFrame([(None, "http://a"), ("", "http://a"), ("x", None), ("http://z/y", None), ("x", "")], "u string, b string")
    assert [r[0] for r in odd.select(listings.absolute_url(F.col("u"), F.coalesce("b", F.lit("")))).collect()] == [None, None, None, "http://z/y", None]


def test_one_listing_a_page(spark):
    page = lambda held: f'<script id="__NEXT_DATA__" type="x">{{"props": {{"pageProps": {held}}}}}</script>'
    rows = [("https://x.fr/ad/locations/1", page('{"ad": {"price": 500, "url": "/other"}}')), ("https://x.fr/ad/ventes/2", page('{"ad": {"price": [90000.5]}}')), ("u3", page('{"ad": []}')), ("u4", page("{}")), ("u5", page("{bad")), ("u6", "<p>"), ("u7", None)]
    found = {r["url"]: (r["price"], r["rent"]) for r in listings.single_listings(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert found == {"https://x.fr/ad/locations/1": (500, 500.0), "https://x.fr/ad/ventes/2": (90000, None)}


def test_sources_without_a_log_are_warnings(spark):
    from gable.operators import health

    at = dt.datetime(2026, 3, 10)
    runs = [(1, "a", 5, 0), (2, "a", 0, 1), (3, "b", 0, 1), (4, "b", 0, 1), (5, "b", 0, 2), (6, "c", 0, 0), (7, "x", 1, 0)]
    log = spark.createDataFrame([(i, s, at + dt.timedelta(hours=i), n, e) for i, s, n, e in runs], "id int, source string, at timestamp_ntz, scraped int, errors int")
    sources = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "source string")
    found = {r["source"]: (r["failures"], r["runs"], r["status"], r["message"]) for r in health.source_status(log, sources).collect()}
    assert found == {
        "a": (1, 2, "warning", "Source a: 1 echec(s) recent(s)."), "b": (3, 3, "critical", "Source b indisponible: 3 echecs consecutifs."), "c": (0, 1, "ok", "Source c operationnelle."), "d": (0, 0, "warning", "Aucun log de scraping pour d."),
    }

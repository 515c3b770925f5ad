"""What a reviewer found: each of these failed before its change."""

import difflib
import json
import random
import re

import numpy as np
import pytest
from gable.config import DedupConfig
from gable.functions import text
from gable.operators import alerts, dedup, observatory, paircounts, pairlists, patterns, spatial
from gable.plans import operations, sources
from gable.sources import details, elements, listings
from pyspark.sql import functions as F


def test_a_drop_that_rounds_to_nothing_has_no_sign(spark):
    df = spark.createDataFrame([(411744.0, 411702.0), (1000.0, 999.0), (1000.0, 990.0)], "old double, new double")
    out = [r[0].split("(")[1] for r in df.orderBy("new").select(alerts.drop_message(F.lit("s"), F.col("old"), F.col("new"))).collect()]
    assert out == ["-1.0%)", "-0.1%)", "0.0%)"]


def test_entities_without_a_semicolon_stay_where_they_must(spark):
    df = spark.createDataFrame([("a &amp; &&&amp b &notit; &eacute;&#8217;&#x41; &amp;lt; &copy",)], "t string")
    assert df.select(text.html_text(F.col("t"), closed=True)).first()[0] == "a & &&&amp b &notit; é’A &lt; &copy"
    assert df.select(text.html_text(F.col("t"))).first()[0] == "a & &&& b ¬it; é’A &lt; ©"


@pytest.mark.parametrize(("fewest", "reaching"), [(2000, 1_000_000), (20, 50)])
def test_pairs_are_counted_without_being_made(spark, monkeypatch, fewest, reaching):
    monkeypatch.setattr(paircounts, "FEWEST", fewest)
    monkeypatch.setattr(paircounts, "REACHING", reaching)
    rng = random.Random(3)
    surfaces, prices = [None, 10.0, 12.0, 12.1, 14.1, *(30.0 + i / 10 for i in range(60))], [None, 0.0, -5.0, 100.0, 105.0, 95.0, 95.3, *(200.0 + i for i in range(40))]
    rows = [(i, rng.choice(surfaces), rng.choice(prices)) for i in range(300)] + [(300 + i, 20.0, 1000.0) for i in range(200)]  # and a crowd
    c = DedupConfig()
    near = lambda a, b: (a[1] is not None and b[1] is not None and abs(a[1] - b[1]) <= c.surface_m2) or (a[2] is not None and b[2] is not None and a[2] > 0 and abs(b[2] - a[2]) * 100.0 <= a[2] * c.price_pct)
    expected = {b[0]: (len(e), sum(e)) for b in rows if (e := [a[0] for a in rows if a[0] < b[0] and near(a, b)])}
    df = spark.createDataFrame(rows, "rank long, surface double, price double")
    out = paircounts.pair_counts(df).groupBy("rank").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total")).where("pairs > 0")
    assert {r["rank"]: (r["pairs"], r["total"]) for r in out.collect()} == expected


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_patterns_bound_the_likeness_of_all_their_texts(monkeypatch):
    rng = random.Random(7)
    for _ in range(150):
        p, q = ([frozenset(rng.sample("abc ", rng.choice((1, 1, 1, 2, 3)))) for _ in range(rng.randint(0, 12))] for _ in "pq")
        (low, high), (least, most) = patterns.edit_bounds(p, q), patterns.match_bounds(p, q)
        for _ in range(20):
            x, y = ("".join(rng.choice(sorted(s)) for s in t) for t in (p, q))
            assert low <= edits(x, y) <= high
            assert least <= sum(m.size for m in difflib.SequenceMatcher(None, x, y).get_matching_blocks()) <= most
    monkeypatch.setattr(patterns, "STRETCHES", 3)
    assert patterns.match_bounds([frozenset("ab")] * 9, [frozenset("a")] * 7) == (0, 7)


def class_links(rows, exact):
    """Number of links and the first linked rank by class, one pair at a time."""
    c = DedupConfig()
    ratio = (lambda a, b: difflib.SequenceMatcher(None, b, a).ratio()) if exact else (lambda a, b: 1 - edits(b, a) / max(len(a), len(b)))
    near = lambda a, b: (a[1] is not None and b[1] is not None and abs(a[1] - b[1]) <= c.surface_m2) or (a[2] is not None and b[2] is not None and a[2] > 0 and abs(b[2] - a[2]) * 100.0 <= a[2] * c.price_pct)
    classes = {}
    for rank, *own in rows:
        classes.setdefault(tuple(own), []).append(rank)
    out = {}
    for b, members in classes.items():
        found = [r[0] for a, r in classes.items() if r[0] < members[-1] and a[0] and b[0] and near(a, b) and (a[0] == b[0] or ratio(a[0], b[0]) >= c.similarity)]
        out[members[0]] = (members[-1], len(members), len(found), min(found, default=None))
    return out


@pytest.mark.parametrize(("exact", "shapes", "fewest"), [(True, 32, 10), (False, 32, 2000), (True, 3, 2000), (False, 3, 10)])
def test_links_of_like_shapes_are_counted_and_others_compared(spark, monkeypatch, exact, shapes, fewest):
    monkeypatch.setattr(patterns, "SHAPES", shapes)
    monkeypatch.setattr(paircounts, "FEWEST", fewest)
    rng = random.Random(5)
    kinds = [lambda: f"{rng.randint(1, 20)} av gare 25000 besancon", lambda: f"{rng.randint(1, 9)}{rng.randint(0, 9)} {rng.randint(10, 40)}", lambda: "", lambda: "x" * 64 + rng.choice("ab"), lambda: rng.choice(("3 rue battant", "3 rue battant 2e", "40 ch vignes"))]
    rows = [(i, rng.choice(kinds)(), rng.choice([None, 10.0, 12.0, 13.0, 40.0, 60.5]), rng.choice([None, 0.0, -5.0, 100.0, 105.0, 99.0, 200.0])) for i in range(260)]
    df = spark.createDataFrame(rows, "rank long, key string, surface double, price double")
    out = {r["class_id"]: (r["last"], r["members"], r["n_links"], r["first_link"]) for r in dedup.duplicate_classes(df, exact=exact).collect()}
    assert out == class_links(rows, exact)
    assert dedup.duplicate_classes(df.where("false"), exact=exact).count() == 0


@pytest.mark.parametrize("exact", [True, False])
def test_no_pair_is_made_where_all_keys_are_alike(spark, monkeypatch, exact):
    monkeypatch.setattr(dedup, "band_candidates", lambda *a, **k: pytest.fail("pairs"))
    rng = random.Random(6)
    rows = [(i, f"{i % 97} av nation_{i % 25} 25{i % 1000:03d} besancon", float(rng.randint(1, 300)), float(rng.randint(900, 9000))) for i in range(400)]
    df = spark.createDataFrame(rows, "rank long, key string, surface double, price double")
    out = {r["class_id"]: (r["last"], r["members"], r["n_links"], r["first_link"]) for r in dedup.duplicate_classes(df, exact=exact).collect()}
    assert out == class_links(rows, exact)


def test_keys_that_are_all_alike_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(dedup, "sequence_ratio", lambda *a: pytest.fail("scored"))
    rng = random.Random(8)
    rows = [(i, f"{i % 97} av nation_{i % 25} 25{i % 1000:03d} besancon", float(rng.randint(1, 90)), float(rng.randint(900, 9000))) for i in range(120)]
    df = spark.createDataFrame(rows, "rank long, key string, surface double, price double")
    near = lambda a, b: abs(a[2] - b[2]) <= 2 or abs(b[3] - a[3]) * 100.0 <= a[3] * 5.0
    expected = {b[0]: found for b in rows if (found := [a[0] for a in rows if a[0] < b[0] and near(a, b) and difflib.SequenceMatcher(None, b[1], a[1]).ratio() >= 0.7])}
    assert {r["rank"]: r["duplicates"] for r in dedup.fuzzy_duplicates(df).collect()} == expected


def test_a_checksum_goes_round(spark):
    values = [(1 << 62) + 5, 1 << 62, 1 << 62, -7, 3]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert df.agg(paircounts.checksum(F.col("v"))).first()[0] == (sum(values) + (1 << 63)) % (1 << 64) - (1 << 63)


def test_nearest_of_crowded_points_in_small_tiles(spark, monkeypatch):
    for name, value in (("TILE", 4), ("SAMPLE", 60), ("ROWS", 10)):
        monkeypatch.setattr(spatial, name, value)
    rng = random.Random(11)
    rows = [(i, 47.24 + rng.gauss(0, 0.004), 6.02 + rng.gauss(0, 0.004)) for i in range(200)] + [(200 + i, 47.25, 6.03) for i in range(60)] + [(300, None, 6.0), (301, 48.0, 6.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    points = df.where("id % 5 = 0")
    pairs = spatial.near_points(df, points, 700.0).where("id <> point_id").groupBy("id").agg(F.min(F.struct("metres", "point_id")).alias("b"))
    expected = {r["id"]: (r["b"]["point_id"], r["b"]["metres"]) for r in pairs.collect()}
    out = {r["id"]: (r["point"], r["metres"]) for r in spatial.nearest_point(df, points, "id", "id", 700.0, others=True).collect()}
    assert out == {i: expected.get(i, (None, None)) for i, *_ in rows} and out[200][0] == 205 and out[205][0] == 200


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", [operations.levenshtein_duplicates_all, operations.duplicate_classes])
def test_keys_of_classes_are_worked_out_once(spark, data, query):
    assert "regexp_replace(" not in plan(query(spark, data))


def test_few_surfaces_take_few_blocks(monkeypatch):
    built, own = [], paircounts.Prefixes
    monkeypatch.setattr(paircounts, "Prefixes", lambda *a: built.append(1) or own(*a))
    rng = np.random.default_rng(4)
    rank, x, y = rng.permutation(600), rng.integers(100, 103, 600).astype(float), rng.random(600)
    low, high = x - rng.integers(0, 2, 600), x + rng.integers(0, 2, 600)
    found = paircounts.counts(rank, x, y, rank, (low, high), (y - 0.2, y + 0.2))
    near = (rank[None] < rank[:, None]) & (x >= low[:, None]) & (x <= high[:, None]) & (y >= (y - 0.2)[:, None]) & (y <= (y + 0.2)[:, None])
    assert found[0].tolist() == near.sum(axis=1).tolist() and found[1].tolist() == (near * rank).sum(axis=1).tolist()
    assert len(built) <= 3
    assert paircounts.counts(rank, x, y, rank, (low, high), (y - 0.2, y + 0.2), False)[0].tolist() == found[0].tolist()


def test_an_answer_is_parsed_once(spark):
    df = spark.createDataFrame([("```json\n{}\n```",)], "t string").select(listings.model_answer(F.col("t")).alias("a"))
    assert plan(df.select("a.etat_bien", "a.info_copro")).count("from_json(") <= 1 and df.first()[0] is None


def test_patterns_meet_only_texts_with_their_word(spark):
    df = spark.createDataFrame([("12 av. de la r. x",), ("av r 3 bd. y 4 bd z",), ("",), (None,)], "t string")
    out = [r[0] for r in df.select(text._replaced(F.col("t"), text.ABBREVIATIONS, r"((?<=[0-9]\s)|^)\Q{}\E")).collect()]
    assert out == ["12 avenue de la r. x", "avenue r 3 boulevard y 4 boulevard z", "", None]


def test_labels_are_named_once(spark):
    df = spark.createDataFrame([([("surface habitable", "40,5 m"), ("surface du terrain", "900 m"), ("étage", "1"), ("etage", "2e"), (None, "x")],)], "c array<struct<label:string,value:string>>")
    own = df.select(details.named(F.col("c")).alias("n"))
    assert [x["name"] for x in own.first()[0]] == ["surface", "surface", "floor", "floor", None]
    assert own.select(*(c.alias(n) for n, c in details.detail_fields(F.col("n"), F.lit(False)).items())).first()[:3] == (40.5, None, 2)


def test_the_kind_of_a_variant_is_worked_out_once(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("1.5",), ('"x"',), ("true",), ("null",)], "t string").select(listings.variant_kind(F.parse_json("t")).alias("k"))
    assert plan(df).count("schema_of_variant(") + plan(df).count("schemaofvariant(") <= 1 and [r[0] for r in df.collect()] == ["dict", "list", "number", "str", "bool", None]


def test_selectors_are_compiled_once():
    assert elements._wanted("li", '{"a": ["a[href]", "href"]}') is elements._wanted("li", '{"a": ["a[href]", "href"]}')


def test_no_task_holds_all_values_of_a_group(spark):
    rows = [(f"g{i % 3}", float((i * 7919) % 1000) / 8, 1.0 + i % 4) for i in range(400)] + [(None, 5.0, 1.0), ("g0", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    out = observatory.order_statistics(df, ["g"], "v", {"n": F.lit(1), "w": F.col("w")}, {"third": ("n", lambda n: F.lit(3)), "half": ("w", lambda w: w / 2)}, bins=4)
    lines = plan(out).split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    by_value = [i for i, x in enumerate(lines) if re.search(r"Aggregate \[[^\]]*\b_?v#", x)]
    for i in by_value:  # values are grouped only where they have met the bins that are wanted
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert any("Join" in x for x in lines[i:end])
    assert by_value
    for r in out.collect():
        own = sorted((v, w) for g, v, w in rows if g == r["g"] and v is not None)
        total, run = sum(w for _, w in own), 0.0
        half = next(v for v, w in own if (run := run + w) >= total / 2)
        assert (r["all_n"], r["all_w"], r["third"], r["half"]) == (len(own), total, own[2][0] if len(own) > 2 else None, half)


def test_pages_of_one_structure_are_worked_out_once_and_others_are_parsed(monkeypatch):
    """Random pages of plain and of odd tags give what the parser gives; pages of plain tags don't need it, and those of one structure share what is found."""
    fields = {"p": ["p", None], "h": ["nav li a[href]", "href"], "d": ["div.x a", None], "t": ["title", None], "all": ["*", None]}
    plain = ["<p>", "</p>", "<div class='x y'>", "</div>", "<a href='1&amp;'>", "<a href=2 class=q>", "</a>", "<li>", "<nav>", "</nav>", "<br/>", "<script>a='<div>';</script>", "<!-- c -->", "a", "b &amp; c", "&nbsp;", " "]
    odd = ["<script>", "</script>", "<title>", "</title>", "<a title=\"x>y\">", "<a x=='>", "'\">", "<", "a < b", "</p x>", "<!-->", "<?pi>", "<script/>", "<p<b>", "<![CDATA[x]]>", "<script>a</b></script>"]
    rng, parse = random.Random(4), elements._parsed
    for container in ("", "div"):
        find = elements._Finder(*elements._wanted(container, json.dumps(fields)))
        for i in range(1500):
            page = "".join(rng.choice(plain if i % 2 else plain + odd) for _ in range(rng.randint(0, 12)))
            assert list(find(page)) == list(parse(page, find.inside, find.wanted)), page
    monkeypatch.setattr(elements, "_parsed", lambda *a: pytest.fail("parsed"))
    find = elements._Finder(*elements._wanted("", json.dumps(fields)))
    assert [list(find(f"<p>{i} &lt; <div class=x><a href='{i}'>{i}</a></div>"))[0][:3] for i in range(3)] == [[[f"{i} <"], [], [str(i)]] for i in range(3)]
    assert len(find.structures) == 1


def test_pages_are_read_once_and_in_as_many_tasks_as_a_shuffle_has(spark, data):
    out = sources.detail_elements(spark, data)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("joined", [False, True])
def test_lists_of_keys_that_are_all_alike_are_made_without_pairs(spark, monkeypatch, joined):
    monkeypatch.setattr(dedup, "band_candidates", lambda *a, **k: pytest.fail("pairs"))
    monkeypatch.setattr(pairlists, "LATER", 50)
    monkeypatch.setattr(pairlists, "BYTES", 200)
    rng = random.Random(9)
    surfaces, prices = [None, 10.0, 12.0, 12.1, 14.1, *(30.0 + i / 10 for i in range(60))], [None, 0.0, -5.0, 100.0, 105.0, 95.0, 95.3, *(200.0 + i for i in range(40))]
    rows = [(r, f"{i % 97} av nation_{i % 25} 25{i % 1000:03d} besancon", rng.choice(surfaces), rng.choice(prices)) for i in range(300) for r in ([i - 20, i - 20] if i % 50 == 0 else [i - 20])]  # ranks below 0, and ones of two rows
    c = DedupConfig()
    near = lambda a, b: (a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= c.surface_m2) or (a[3] is not None and b[3] is not None and a[3] > 0 and abs(b[3] - a[3]) * 100.0 <= a[3] * c.price_pct)
    expected: dict = {}
    for b in rows:
        for a in rows:
            if a[0] < b[0] and near(a, b):
                expected.setdefault(b[0], set()).add(a[0])
    expected = {r: ",".join(map(str, sorted(found))) if joined else sorted(found) for r, found in expected.items()}
    out = dedup.fuzzy_duplicates(spark.createDataFrame(rows, "rank long, key string, surface double, price double"), joined=joined).collect()
    assert {r["rank"]: r["duplicates"] for r in out} == expected and len(out) == len(expected)


@pytest.mark.parametrize("joined", [False, True])
def test_lists_of_links_that_patterns_tell_and_of_compared_ones_are_one(spark, joined):
    rng = random.Random(10)
    keys = ["", None, "12 av nation 25000 besancon", "3 place du marche", "3 place marche", "zz"]
    rows = [(i, rng.choice(keys) if i % 3 else f"{i % 97} av nation_{i % 25} 25{i % 1000:03d} besancon", float(rng.randint(1, 60)), float(rng.randint(900, 9000))) for i in range(160)]
    near = lambda a, b: abs(a[2] - b[2]) <= 2 or abs(b[3] - a[3]) * 100.0 <= a[3] * 5.0
    expected = {b[0]: found for b in rows if (found := [a[0] for a in rows if a[0] < b[0] and a[1] and b[1] and near(a, b) and difflib.SequenceMatcher(None, b[1], a[1]).ratio() >= 0.7])}
    expected = {r: ",".join(map(str, found)) if joined else found for r, found in expected.items()}
    out = dedup.fuzzy_duplicates(spark.createDataFrame(rows, "rank long, key string, surface double, price double"), joined=joined).collect()
    assert {r["rank"]: r["duplicates"] for r in out} == expected and len(out) == len(expected)

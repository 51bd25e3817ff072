"""Operators against brute force; results don't depend on partitions or row order."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from framelode.operators import aggregates, evidence, greedy, identity, search, selection, tables, windows


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def frames(spark):
    r = random.Random(1)
    data = [(f"s{r.randrange(4)}", f"f{i:03d}", r.randrange(90) * 1000, float(r.randrange(50)), r.random() < 0.3) for i in range(160)]
    return data, spark.createDataFrame(data, "src string, id string, t long, v double, high boolean")


@pytest.mark.parametrize("n, share, want", [(10, 0.15, 2), (10, 0.20, 2), (10, 0.30, 3), (100, 0.15, 15), (137, 0.20, 28)])
def test_density_targets(spark, n, share, want):
    assert spark.range(1).select(selection.density_target(F.lit(n), share)).first()[0] == want


def test_density_golden(spark):
    df = spark.createDataFrame([("s", f"v{i}", i, i / 10, i in (2, 7)) for i in range(10)], "src string, id string, t long, score double, high boolean")
    assert rows_of(selection.density_selection(df.repartition(7), "src", "t", "id", "score", "high", 0.30).select("id")) == [("v2",), ("v5",), ("v7",)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_greedy_spacing_ignores_partitions(frames, parts):
    data, df = frames
    got = rows_of(greedy.keep_apart(df.repartition(parts), "src", "t", [("v", False), ("id", True)], 5000, "src string, id string, t long"))
    want = []
    for s in {d[0] for d in data}:
        kept = []
        for d in sorted((d for d in data if d[0] == s), key=lambda d: (-d[3], d[1])):
            if all(abs(d[2] - k[2]) >= 5000 for k in kept):
                kept.append(d)
        want += [k[:3] for k in kept]
    assert got == sorted(want)


def test_coverage_leaves_no_fillable_gap(frames):
    data, df = frames
    got = greedy.time_coverage(df, "src", "t", "id", 6000, 10_000, "src string, id string, t long").collect()
    for s in {d[0] for d in data}:
        chosen, every = sorted(r.t for r in got if r.src == s), sorted(d[2] for d in data if d[0] == s)
        assert chosen[0] == every[0]
        for a, b in itertools.pairwise(chosen):
            assert b - a <= 10_000 or not any(a < x < b for x in every)


def test_leaders_join_the_first_that_fits(frames):
    data, df = frames
    near = lambda a, b: (abs(a["t"] - b["t"]) <= 3000) & (abs(a["v"] - b["v"]) <= 5)
    got = rows_of(greedy.leaders(df, "src", "src string, id string, leader string", [("v", False), ("id", True)], near, "id"))
    want = []
    for s in {d[0] for d in data}:
        found = []
        for d in sorted((d for d in data if d[0] == s), key=lambda d: (-d[3], d[1])):
            hit = next((x for x in found if abs(x[2] - d[2]) <= 3000 and abs(x[3] - d[3]) <= 5), None)
            if hit is None:
                found.append(d)
            want.append((s, d[1], (hit or d)[1]))
    assert got == sorted(want)


def test_clusters_respect_cannot_links(spark):
    rows = [("c", "a", "u1", [1.0, 0.0]), ("c", "b", "u2", [0.8, 0.6]), ("c", "x", "u1", [0.99, 0.14])]
    df = spark.createDataFrame(rows, "comp string, id string, unit string, v array<double>")
    got = {r.id: r for r in greedy.constrained_clusters(df, "comp", "id", "unit", "v", 0.5).collect()}
    assert got["x"].cluster == got["b"].cluster == "b" and got["a"].cluster == "a"
    two = greedy.constrained_clusters(df.where("id <> 'x'"), "comp", "id", "unit", "v", 0.5)
    assert rows_of(two.select("cluster")) == [("a",), ("a",)]


def test_windows_match_brute_force(frames):
    data, df = frames
    got = {r.id: (r.least_difference, r.mean_difference) for r in windows.around(df, "src", ["t", "id"], "v").collect()}
    best = set(rows_of(windows.local_argmax(df, "src", "t", "id", "v", 6000).select("id")))
    for s in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == s), key=lambda d: (d[2], d[1]))
        for i, d in enumerate(own):
            far = [abs(x[3] - d[3]) for x in own[max(0, i - 3) : i] + own[i + 1 : i + 4]]
            assert got[d[1]] == (min(far), pytest.approx(sum(far) / len(far)))
            beaten = any(abs(x[2] - d[2]) <= 6000 and (-x[3], x[2], x[1]) < (-d[3], d[2], d[1]) for x in own)
            assert ((d[1],) in best) == (not beaten)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6])
def test_positions_round_half_to_even(spark, n):
    df = spark.createDataFrame([("s", i) for i in range(n)], "src string, i int")
    assert rows_of(windows.pick_positions(df, "src", [F.col("i")], [0.0, 0.5, 1.0]).select("i")) == sorted({(0,), (round((n - 1) * 0.5),), (n - 1,)})


def test_equal_gap_doesnt_end_a_session(spark):
    df = spark.createDataFrame([("s", 0, "a"), ("s", 30_000, "b"), ("s", 60_001, "c")], "src string, t long, id string")
    assert rows_of(windows.gap_islands(df, "src", "t", "id", 30_000).select("id", "island")) == [("a", 0), ("b", 0), ("c", 1)]


def test_propagation_golden(spark):
    frames = spark.createDataFrame([("s", f"f{i}", i * 1000) for i in range(8)], "src string, id string, t long")
    labels = spark.createDataFrame([(f"f{i}", x) for i in range(8) for x in ("person", "car")], "unit string, label string")
    said = spark.createDataFrame([("f3", x) for x in ("person", "car", "chair")], "unit string, label string")
    got = evidence.roll_up(evidence.propagate(evidence.neighbours(frames, "src", "t", "id"), said, labels)).collect()
    assert sorted(r.target for r in got) == ["f0", "f1", "f2", "f4", "f5", "f6"] and {r.labels for r in got} == {"car|person"}


def test_a_failed_peer_blocks_its_quick_group(spark):
    rows = [("a", "q1", "h", "x/y"), ("b", "q1", "h", "x"), ("c", "q2", None, "x"), ("d", "q2", "h2", "x"), ("e", "q3", None, "x"), ("f", "q1", "h9", "z")]
    df = spark.createDataFrame(rows, "id string, quick string, full string, path string")
    assert rows_of(identity.two_stage_identity(df, "quick", "full", "path", "id").select("id", "status")) == [
        ("a", "exact_duplicate"), ("b", "canonical"), ("c", "blocked_peer_failure"), ("d", "blocked_peer_failure"), ("e", "unique"), ("f", "unique"),
    ]


def test_near_pairs_recall(spark):
    r = random.Random(2)
    base = [[r.gauss(0, 1) for _ in range(32)] for _ in range(120)]
    data = [(i, v) for i, v in enumerate(base)] + [(1000 + i, [x + r.gauss(0, 0.15 if i % 2 else 0.45) for x in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for least in (0.95, 0.9):
        got = {(x.a, x.b) for x in identity.similar_pairs(df, "id", "v", least).collect()}
        want = {(a, b) for (a, x), (b, y) in itertools.combinations(data, 2) if dot(x, y) >= least * (dot(x, x) * dot(y, y)) ** 0.5}
        assert got <= want and len(got) >= 0.9 * len(want) > 50


def test_stated_queries_meet_all_items_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(identity, "QUERY_BLOCK", 3)
    data = [(i, [float(i % 5), 1.0]) for i in range(20)] + [(99, None), (98, [])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = rows_of(identity.scan_queries(df, df.where("id < 8 or id > 90"), "id", "v", 0.999).select("query", "item"))
    assert got == sorted((a, b) for a in range(8) for b in range(20) if a % 5 == b % 5)


def test_keyed_tables(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", None, "z")], "k string, n int, s string")
    new = spark.createDataFrame([("b", None, "new"), ("c", None, "z"), ("d", 4, "d")], "k string, n int, s string")
    assert rows_of(tables.upsert(old, new, "k"))[1] == ("b", 2, "new")
    assert [r[0] for r in rows_of(tables.insert_ignore(old, new, "k").select("k"))] == ["a", "b", "c", "d"]
    assert rows_of(tables.classify_changes(old, new, "k")) == [("a", "missing"), ("b", "updated"), ("c", "unchanged"), ("d", "new")]
    page = tables.page(old, [F.asc("k")], 1, 1).collect()
    assert [(r.k, r.next_offset) for r in page] == [("b", 2)] and tables.page(old, [F.asc("k")], 2, 5).first().next_offset is None


def test_percentile_definitions_differ(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 11)], "g string, v double")
    assert aggregates.percentile_nearest(df, ["g"], "v", 0.9).first().value == 9.0
    assert aggregates.percentile_round(df, ["g"], "v", 0.5).first().value == 5.0
    assert df.agg(aggregates.percentile_linear("v", 0.9)).first()[0] == pytest.approx(9.1)
    assert tuple(aggregates.percentiles_linear(df, ["g"], "v", {"p": 0.9, "top": 1.0}).first()) == ("g", 10, pytest.approx(9.1), 10.0)


def test_ranks_are_found_by_bucket_in_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "RANKED_AT_ONCE", 20)
    monkeypatch.setattr(aggregates, "BUCKETS_OF_SPAN", 8)
    r = random.Random(8)
    data = [("hot", r.choice([5.0, 5.0, r.random(), 1e9 * r.random(), None])) for _ in range(900)] + [("b", -3.0), (None, 7.0), (None, 8.0), ("c", None)] + [("d", float(i)) for i in range(60)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(x.g, x.which): x.value for x in aggregates.value_at(df, ["g"], "v", {"low": lambda n: F.floor(n * 0.1), "high": lambda n: F.floor(n * 0.95)}).collect()}
    for g in ("hot", "b", None, "d"):
        own = sorted(v for k, v in data if k == g and v is not None)
        assert (got[g, "low"], got[g, "high"]) == (own[int(len(own) * 0.1)], own[int(len(own) * 0.95)])
    assert len(got) == 8 and aggregates.value_at(df.limit(0), ["g"], "v", {"q": lambda n: n - 1}).count() == 0


def test_greedy_choices_over_stretches_are_those_of_whole_sources(spark, monkeypatch):
    monkeypatch.setattr(greedy, "PART_ROWS", 12)
    r = random.Random(12)
    data = [(r.choice("ab"), f"i{i:03d}", r.randrange(120) * 1000 + (10**6 if i % 3 else 0), float(r.randrange(20))) for i in range(220)]
    df = spark.createDataFrame(data, "src string, id string, t long, v double")
    alike = lambda a, b: (abs(a["t"] - b["t"]) <= 3000) & (abs(a["v"] - b["v"]) <= 3)
    want_novel, want_apart, want_better = [], [], []
    for s in "ab":
        own = sorted((x for x in data if x[0] == s), key=lambda x: (-x[3], x[1]))
        kept = []
        for x in own:
            if len(kept) < 9 and not any(abs(x[2] - k[2]) <= 3000 and abs(x[3] - k[3]) <= 3 for k in kept):
                kept.append(x)
        want_novel += [k[1] for k in kept]
        kept = []
        for x in own:
            if len(kept) < 7 and all(abs(x[2] - k[2]) >= 5000 for k in kept):
                kept.append(x)
        want_apart += [k[1] for k in kept]
        kept = []
        for x in sorted(own, key=lambda x: (x[2], x[1])):
            if kept and x[2] - kept[-1][2] < 4000:
                kept[-1] = x if x[3] > kept[-1][3] else kept[-1]
            else:
                kept.append(x)
        want_better += [k[1] for k in kept]
    order = [("v", False), ("id", True)]
    ids = lambda d: sorted(x.id for x in d.collect())
    assert ids(greedy.novel_first(df, "src", "src string, id string", order, alike, 9, "t", 3000)) == sorted(want_novel)
    assert ids(greedy.keep_apart(df, "src", "t", order, 5000, "src string, id string", cap=7)) == sorted(want_apart)
    assert ids(greedy.better_of_near(df, "src", "t", "v", "id", 4000, "src string, id string")) == sorted(want_better)


def test_mentions_equal_term_by_term_search(spark):
    docs = spark.createDataFrame([(1, "A red car, parked."), (2, "cardboard"), (3, "paper kite 汽车"), (4, None)], "d long, x string")
    terms = spark.createDataFrame([("car",), ("Paper Kite",), ("汽车",), ("",), (None,)], "t string")
    assert rows_of(evidence.mentions(docs, "d", "x", terms)) == [(1, "car"), (3, "paper kite"), (3, "汽车")]
    r = random.Random(9)
    texts = ["".join(r.choice("ab1 车人汽-é") for _ in range(r.randrange(12))) for _ in range(150)]
    names = sorted({"".join(r.choice("ab1 车人汽-é") for _ in range(r.randrange(1, 4))).strip() for _ in range(60)} - {""})
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, x string")

    def mentions(text, term):
        return re.search(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", text) if re.search("[a-z0-9]", term) else term in text

    got = rows_of(evidence.mentions(docs, "d", "x", spark.createDataFrame([(n,) for n in names], "t string")))
    assert got == sorted((i, n) for i, t in enumerate(texts) for n in names if mentions(t, n))


def test_only_passed_captions_and_confident_labels_propagate(spark):
    rows = [("f1", "a car", "qwenvl", "PASS"), ("f2", "a car", "qwenvl", "REVIEW"), ("f3", "a car", "ocr", "PASS"), (None, "x", "qwenvl", "PASS"), ("f4", None, "qwenvl", "PASS")]
    df = spark.createDataFrame(rows, "u string, t string, m string, s string")
    assert rows_of(evidence.anchor_texts(df, "u", "t", "m", "s")) == [("f1", "a car")]
    labels = spark.createDataFrame([("f1", "Car", 0.2), ("f1", "car", 0.35), ("f1", "bus", 0.34), ("f1", "tent", None)], "u string, l string, c double")
    assert rows_of(evidence.confident_labels(labels, "u", "l", "c")) == [("f1", "car")]


def test_search_pages(spark):
    config = search.SearchConfig()
    hits = spark.createDataFrame([(i, 0.9 - i / 100, None if i % 3 else 0.5 + i / 1000, None, i == 4, "video" if i % 2 else "image") for i in range(40)], "k long, visual double, text double, object double, exact_text boolean, media string")
    got = {r.k: r for r in search.fuse(hits, "k", config).collect()}
    text = sorted((i for i in range(40) if i % 3 == 0), key=lambda i: -i)
    for i in range(40):
        want = 1 / (60 + i + 1) + (0.8 / (60 + text.index(i) + 1) if i in text else 0)
        assert got[i].rrf == pytest.approx(want) and got[i].rank_visual == i + 1
    with pytest.raises(Exception, match="finite"):
        search.fuse(hits.withColumn("text", F.lit(float("nan"))), "k", config)
    relevant = search.fuse(hits, "k", config).withColumn("reasons", search.gate(config)).where("reasons <> ''").withColumn("relevance", search.relevance())
    assert [r.k for r in relevant.where("k = 4 or k = 30").orderBy(*search.reranked("k")).collect()] == [4, 30]
    page = relevant.orderBy(*search.reranked("k")).limit(5)
    assert sum(r.shown for r in search.media_counts(relevant, "media", page).collect()) == 5
    assert hits.where("k in (1, 4)").select(search.hit_fields(F.lit("exact_text|visual|text"))).first()[0] == "text,visual_vector,semantic_text"
    groups = search.text_groups(spark.createDataFrame([("a", 1, 0.5, False), ("a", 2, 0.4, True), ("b", 3, 0.9, False), ("a", 0, 0.1, False)], "g string, d long, s double, e boolean"), "g", "d", "s", "e", 2)
    assert [tuple(r) for r in search.exact_first(groups, "g", "score", "exact", 5).collect()] == [("a", 0.5, True, 3, [0, 1]), ("b", 0.9, False, 1, [3])]
    assert [r.g for r in search.exact_first(groups, "g", "score", "exact", 1, 1).collect()] == ["b"]
    with pytest.raises(Exception, match="outside"):
        search.text_groups(spark.createDataFrame([("a", 1, 1.5, False)], "g string, d long, s double, e boolean"), "g", "d", "s", "e", 2).collect()


def test_registered_terms_name_objects(spark):
    registry = spark.createDataFrame([("car", "车", '["auto"]', "vehicle Fahrzeug"), ("bus", None, "[broken", None)], "label string, label_zh string, search_terms_json string, embedding_text string")
    labels = spark.createDataFrame([("u1", "car", 0.4), ("u1", "car", 0.8), ("u2", "bus", 0.9)], "unit string, label string, confidence double")
    for query, found in (("ＡＵＴＯ", [("u1", 0.8)]), ("fahrzeug", [("u1", 0.8)]), ("bus", [("u2", 0.9)]), ("broken", []), ("", [])):
        assert rows_of(search.object_evidence(labels, search.registry_terms(registry), query, "unit")) == found


def test_nearest_rows_are_complete(spark):
    r = random.Random(4)
    left = [(r.choice("ab"), i, r.randrange(50)) for i in range(60)]
    right = [(r.choice("abc"), 100 + i, r.choice([r.randrange(50), 7, 7, 10_000])) for i in range(80)]
    a, b = (spark.createDataFrame(x, "s string, k long, t long") for x in (left, right))
    got = rows_of(search.nearest_rows(a, b, "s", "t", "k", 4).select("id", "near", "position"))
    want = [(k, y[1], p + 1) for s, k, t in left for p, y in enumerate(sorted((y for y in right if y[0] == s), key=lambda y: (abs(y[2] - t), y[2], y[1]))[:4])]
    assert got == sorted(want)

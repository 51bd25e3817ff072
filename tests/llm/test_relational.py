"""Ranking, co-occurrence, survivors, components, subsets and runs against brute force, and their edge cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from framelode.llm import cleaning, components, cooccur, runs, survivors, top_n, varied

Q = "source_content_id string, queue_type string, candidate_id string, candidate_score double, _band int, _row string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_top_n_matches_brute_force(spark, seed):
    r = random.Random(seed)
    data = []
    for i in range(600):
        group = r.choice(["hot", "hot", "hot", "a", "b", None])
        score = r.choice([None, float("nan"), float("inf"), -1.0, 0.5, 0.5, r.random()])
        data.append((group, r.choice(["x", "y"]), f"c{i:04d}", score, i, "extra"))
    df = spark.createDataFrame(data, Q).repartition(5)
    got = rows_of(top_n.top_n_per_group(df, ["source_content_id", "queue_type"], "candidate_score", "candidate_id", 3).select("candidate_id"))
    groups = {}
    for d in data:
        if d[3] is not None and d[3] == d[3]:
            groups.setdefault(d[:2], []).append((-d[3], d[2]))
    assert got == sorted((c,) for g in groups.values() for _, c in sorted(g)[:3])


def test_top_n_edges(spark):
    empty = spark.createDataFrame([], Q)
    keys = ["source_content_id", "queue_type"]
    assert top_n.top_n_per_group(empty, keys, "candidate_score", "candidate_id").count() == 0
    one = spark.createDataFrame([("a", "x", "c", 1.0, 1, "r")], Q)
    assert top_n.top_n_per_group(one, keys, "candidate_score", "candidate_id", 0).count() == 0
    out = top_n.top_n_per_group(one, keys, "candidate_score", "candidate_id")
    assert out.columns == one.columns and out.count() == 1  # columns named like the working ones are kept


def test_latest_counts_instants_not_texts(spark):
    rows = [("c1", "2026-06-12T01:00:00+02:00", "late text"), ("c1", "2026-06-11T23:30:00Z", "late instant"), ("c2", None, "x"), ("c2", "2020-01-01T00:00:00Z", "y"), (None, "2020-01-01T00:00:00Z", "z")]
    df = spark.createDataFrame(rows, "candidate_id string, created_at string, queue_type string")
    assert rows_of(cleaning.latest_candidates(df, ["candidate_id", "queue_type"])) == [("c1", "late instant"), ("c2", "y")]


@pytest.mark.parametrize("text, normal", [("  Ｔｒｕｃｋ ", "truck"), ("old_helmet", "old helmet"), ("red - lantern", "red lantern"), ("None", None), ("[]", None), ("x" * 81, None), (None, None), ("", None), ("ﬁn", "fin")])
def test_label_form(text, normal):
    assert cooccur.normal_label(text) == normal


def test_cooccurrence_matches_brute_force(spark):
    r = random.Random(3)
    data = [(r.choice([f"u{i}" for i in range(40)] + [None]), r.choice(["a", "b", "c", "d", "e", None])) for _ in range(600)]
    data += [("big", f"l{i:03d}") for i in range(150)] + [("big2", f"l{i:03d}") for i in range(150)]  # baskets cut into blocks
    df = spark.createDataFrame(data, "u string, x string").withColumn("p", F.lit(1))
    got = {(x.item_a, x.item_b): (x.c, x.a, x.b, x.n) for x in cooccur.cooccurrence(df, "u", "x", 2).collect()}
    baskets = {}
    for u, x in data:
        if u is not None and x is not None:
            baskets.setdefault(u, set()).add(x)
    single, pair = {}, {}
    for b in baskets.values():
        for x in b:
            single[x] = single.get(x, 0) + 1
        for p in itertools.combinations(sorted(b), 2):
            pair[p] = pair.get(p, 0) + 1
    assert got == {p: (c, single[p[0]], single[p[1]], len(baskets)) for p, c in pair.items() if c >= 2}
    assert cooccur.cooccurrence(df.limit(0), "u", "x").count() == 0


def test_a_pair_seen_once_is_reported(spark, tmp_path):
    from framelode.llm import registry as llm

    labels = [(f"u{i}", x) for i in range(3) for x in ("a", "b")] + [("v", "a"), ("v", "rare"), ("w", "b")]
    spark.createDataFrame(labels, "visual_unit_id string, label string").write.parquet(f"{tmp_path}/yolo_visual_unit_label.parquet")
    d = str(tmp_path)
    got = rows_of(llm.queries()["p2_cooccurrence"](spark, d).select("label_a", "label_b", "c", "a", "b", "n"))
    assert got == [("a", "b", 3, 4, 4, 5), ("a", "rare", 1, 4, 1, 5)] and llm.queries()["p2_found"](spark, d).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(60):03d}", f"n{r.randrange(60):03d}") for _ in range(45)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)] + [("hub", f"s{i:03d}") for i in range(100)] + [(None, "n001"), ("x", "x")]
    df = spark.createDataFrame(edges, "a string, b string").withColumn("label", F.lit("clash"))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert rows_of(components.connected_components(df)) == sorted((n, find(n)) for n in up)


def test_unit_groups_read_every_notation(spark):
    a, b, c, d, e, f = (f"vu_{i:024x}" for i in range(1, 7))
    rows = [
        (a.upper(), f" {b} ", "none", None), (c, c, "VDG_1", f'["{d}", "vu_0badcafe0badcafe"]'), (e, "", " vdg_1 ", f"|{e}||{e}|"),
        (f, None, "nan", ""), (None, a, "vdg_2", b), (f"vu_{9:024x}", None, "vdg_3", None),
    ]
    df = spark.createDataFrame(rows, "visual_unit_id string, canonical_visual_unit_id string, duplicate_group_id string, duplicate_reverse_visual_unit_ids string")
    assert rows_of(components.unit_groups(df)) == [(a, a), (b, a), (c, c), (d, c), (e, c)]
    assert components.unit_groups(df.limit(0)).count() == 0


F3 = "source_file_id string, content_sha256 string, dedup_role string, canonical_source_file_id string, size_bytes long, mtime_ns long, ctime_ns long, stem_key string, finder_tags_json string, updated_at timestamp"


def _layers(records):
    """Dominance layers by definition."""
    beats = lambda y, x: all(p >= q for p, q in zip(y, x, strict=True)) and y != x
    left, out = list(records), []
    while left:
        front = [x for x in left if not any(beats(y[0], x[0]) for y in left)]
        out.append(front)
        left = [x for x in left if x not in front]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_survivors_match_layers(spark, seed):
    from datetime import datetime, timedelta

    r = random.Random(seed)
    data = []
    for g in range(12):
        for i in range(r.choice([1, 2, 5, 9])):
            v = [r.choice([None, 1, 2]) for _ in range(3)] + [r.choice([None, "", "s"]), r.choice([None, "[]", '["t"]'])]
            data.append((f"g{g}r{i}", f"{g:064x}", r.choice(["canonical", None, "x"]), None, *v, r.choice([None, datetime(2026, 1, 1) + timedelta(days=r.randrange(4))])))
    from framelode.runtime import Scratch

    scratch = Scratch(spark, "t")
    groups = survivors.content_groups(spark.createDataFrame(data, F3), scratch)
    got = {x.content_hash: x for x in survivors.survivors(groups, survivors.content_policy(), scratch).collect()}
    old = datetime(1, 1, 1)
    for g in range(12):
        own = [d for d in data if d[1] == f"{g:064x}"]
        if len(own) < 2:
            assert f"{g:064x}" not in got
            continue
        full = lambda x: x not in (None, "", "[]")
        key = lambda d: (int(d[2] == "canonical"), sum(full(x) for x in d[4:9]), d[9] or old)
        policy = lambda x: tuple([-x[0][0], -x[0][1], -(x[0][2] - old).total_seconds(), x[1][0]])
        layers = _layers([(key(d), d) for d in own])
        first = sorted(layers[0], key=policy)[0][1]
        x = got[f"{g:064x}"]
        assert (x.survivor, x.members) == (first[0], len(own))
        for k, name in enumerate(survivors.HASH_FIELDS):
            source = first[0] if full(first[4 + k]) else next((y[1][0] for layer in layers for y in sorted(layer, key=policy) if full(y[1][4 + k])), None)
            assert x[f"{name}_from"] == source
    recent = {x.content_hash: x for x in survivors.survivors(groups, survivors.content_policy(("stem_key",)), scratch).collect()}
    for g, x in recent.items():
        order = sorted(((old - (d[9] or old), d[0]) for d in data if d[1] == g and full(d[7])))
        assert x.stem_key_from == (order[0][1] if order else None) and x.size_bytes_from == got[g].size_bytes_from


def test_fields_are_filled_by_layer_at_any_depth(spark):
    from datetime import datetime, timedelta

    from framelode.runtime import Scratch

    at = lambda k: datetime(2026, 1, 1) + timedelta(days=k)
    row = lambda g, i, fields, k, role=None: (f"g{g}r{i:02d}", f"{g:064x}", role, None, *fields, at(k))
    data = [row(0, k, (1, 1, 1, "s", None), k) for k in (20, 19, 18, 17, 16, 15, 14, 13)]
    data += [row(0, 90, (1, None, None, None, '["new"]'), 14), row(0, 91, (1, 1, 1, None, '["old"]'), 12)]
    r = random.Random(4)
    for g in (1, 2, 3):
        for i in range(60):
            late = i >= 40
            data.append(row(g, i, (*(r.choice([None, 1]) for _ in range(3)), r.choice(["s", None]) if late else None, r.choice(['["t"]', None]) if late else None), 60 - i // 2, r.choice(["canonical", None]) if g < 3 else None))
    scratch = Scratch(spark, "t")
    groups = survivors.content_groups(spark.createDataFrame(data, F3), scratch)
    got = {x.content_hash: x for x in survivors.survivors(groups, survivors.content_policy(), scratch).collect()}
    assert got[f"{0:064x}"].finder_tags_json == '["new"]'
    for g in range(4):
        own = [d for d in data if d[1] == f"{g:064x}"]
        key = lambda d: (int(d[2] == "canonical"), sum(x is not None for x in d[4:9]), d[9])
        policy = lambda x: (-x[0][0], -x[0][1], -x[0][2].timestamp(), x[1][0])
        layers = [sorted(layer, key=policy) for layer in _layers([(key(d), d) for d in own])]
        assert len(layers) > 6
        for k, name in enumerate(survivors.HASH_FIELDS):
            order = [layers[0][0], *(x for layer in layers for x in layer)]
            assert got[f"{g:064x}"][f"{name}_from"] == next((d[0] for _, d in order if d[4 + k] is not None), None)


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_layers_of_a_hot_group_are_numbered_over_ranges(spark, parts):
    from framelode.runtime import Scratch

    r = random.Random(parts)
    data = [("hot" if r.random() < 0.8 else r.choice(["a", "b"]), r.randrange(2), r.randrange(4), r.randrange(300), r.random() < 0.3) for _ in range(900)]
    df = spark.createDataFrame(data, "g string, t int, c int, ago long, asked boolean").groupBy("g", "t", "c", "ago").agg(F.max("asked").alias("asked"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {tuple(x)[:4]: x.layer for x in survivors._layers(df, [(t, c) for t in range(2) for c in range(4)], Scratch(spark, "t")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for g in ("hot", "a", "b"):
        for i, layer in enumerate(_layers([((t, c, -ago), (h, t, c, ago)) for h, t, c, ago in {d[:4] for d in data} if h == g])):
            want |= {x[1]: i + 1 for x in layer}
    asked = {d[:4] for d in data if d[4]}
    assert got == {x: want[x] for x in asked} and max(got.values()) > 20


def test_hashes_and_lent_hashes(spark):
    h = "AB" * 32
    rows = [
        ("f1", f" sha256:{h} ", "canonical", None, 1, None, None, None, None, None), ("f2", "abc", None, "f1", None, None, None, None, '["t"]', None),
        ("f3", None, "unsupported_or_blocked", None, None, None, None, None, None, None), ("f4", h.lower(), " Unsupported_Or_Blocked", None, 9, 9, 9, "s", None, None), ("f5", None, "x", "f4", None, None, None, None, None, None), ("f6", "", "", "nowhere", None, None, None, None, None, None),
    ]
    from framelode.runtime import Scratch

    groups = survivors.content_groups(spark.createDataFrame(rows, F3), Scratch(spark, "t"))
    assert rows_of(groups.select("source_file_id", "content_hash")) == [("f1", h.lower()), ("f2", h.lower()), ("f5", h.lower())]
    best = survivors.survivors(groups, survivors.content_policy()).first()
    assert best.survivor == "f1" and best.finder_tags_json_from == "f2"
    empty = spark.createDataFrame([], F3)
    assert survivors.survivors(survivors.content_groups(empty, Scratch(spark, "t")), survivors.content_policy()).count() == 0


def _greedy(data, size):
    """Plain greedy: always the record with the highest gain."""
    mass, chosen, total = {}, [], 0.0
    left = set(data)
    for _ in range(size):
        gain = lambda r: sum((mass.get(f, 0) + m) ** 0.5 - mass.get(f, 0) ** 0.5 for f, m in data[r].items())
        best = max(sorted(left), key=gain)
        total += gain(best)
        chosen.append(best)
        left.discard(best)
        for f, m in data[best].items():
            mass[f] = mass.get(f, 0) + m
    return chosen, total


def _value(picked, data):
    mass = {}
    for p in picked:
        for f, m in data[p].items():
            mass[f] = mass.get(f, 0) + m
    return sum(m**0.5 for m in mass.values())


def _records(spark, seed, n):
    r = random.Random(seed)
    data = {}
    for i in range(n):
        source = f"s{0 if r.random() < 0.35 else r.randrange(60)}"
        data[f"r{i:04d}"] = {source: 1.0} | {f"l{int(r.paretovariate(0.7))}": float(r.randint(1, 4)) for _ in range(r.randrange(5))}
    rows = [(k, list(v.items()), next(iter(v)), "clash") for k, v in data.items()]
    return data, spark.createDataFrame(rows, "id string, fs array<struct<name:string,mass:double>>, source string, gain string")


def test_one_block_is_plain_greedy(spark):
    data, df = _records(spark, 5, 400)
    got = [x[0] for x in varied.varied_subset(df, "id", "fs", 40, near="source").select("id").collect()]
    assert len(set(got)) == 40 and _value(got, data) == pytest.approx(_greedy(data, 40)[1], rel=0.005)  # equal gains are resolved in another order


@pytest.mark.parametrize("size", [60, 300])
def test_blocks_near_plain_greedy(spark, monkeypatch, size):
    monkeypatch.setattr(varied, "BLOCK_ROWS", 150)
    data, df = _records(spark, 6, 1500)
    picked = {m: sorted(tuple(x) for x in varied.varied_subset(df, "id", "fs", size, near="source", most_sent=m).collect()) for m in (10**6, 3)}
    assert [x[:2] for x in picked[10**6]] == [x[:2] for x in picked[3]]  # sent or joined
    got = [x[0] for x in picked[3]]
    assert len(got) == len(set(got)) == size
    assert _value(got, data) >= 0.95 * _greedy(data, size)[1] and _value(got, data) > 1.2 * _value(sorted(data)[:size], data)
    assert varied.coverage(df, "id", "fs", spark.createDataFrame([(x,) for x in got], "id string")).first().value == pytest.approx(_value(got, data))


def test_all_records_are_taken_if_asked_for(spark, monkeypatch):
    monkeypatch.setattr(varied, "BLOCK_ROWS", 50)
    data, df = _records(spark, 7, 120)
    rounds = varied.varied_subset(df, "id", "fs", 10**9).collect()
    assert sorted(x.id for x in rounds) == sorted(data) and all(x.gain > 0 for x in rounds)


def test_varied_subset_edges(spark):
    df = spark.createDataFrame([("a", ["x", "x", None]), ("b", None), ("c", []), (None, ["y"]), ("a", ["z"])], "id string, fs array<string>")
    assert [tuple(x) for x in varied.varied_subset(df, "id", "fs", 1).collect()] == [("a", 0, 2.0)]
    assert rows_of(varied.varied_subset(df, "id", "fs", 9).select("id")) == [("a",), ("b",), ("c",)]
    assert varied.varied_subset(df, "id", "fs", 2).count() == 2
    assert varied.varied_subset(df, "id", "fs", 0).count() == 0
    assert varied.varied_subset(df.limit(0), "id", "fs", 5).count() == 0
    odd = spark.createDataFrame([("a", [("x", float("nan")), ("y", -1.0), (None, 2.0), ("z", 4.0), ("z", 9.0)])], "id string, fs array<struct<n:string,m:double>>")
    assert varied.varied_subset(odd, "id", "fs", 1).first().gain == 3.0


def test_the_first_by_histogram_are_the_first_by_order(spark):
    r = random.Random(3)
    rows = [(f"i{k:03d}", r.choice([1.0, 2.0, 2.0, r.random()]), r.getrandbits(63) * r.choice([1, -1])) for k in range(300)] + [(f"t{k}", 2.0, 7) for k in range(5)]
    df = spark.createDataFrame(rows, "id string, gain double, u long")
    for n in (1, 37, 130, 305):
        got = {x.id for x in varied._first(df, n).collect()}
        assert len(got) == n
        least = min(x[1] for x in rows if x[0] in got)
        assert all(x[0] in got for x in rows if x[1] > least + 1e-6)


def test_queue_features_have_masses(spark):
    row = spark.createDataFrame([("Ｔｅｎｔ:3|tent : 2|None|a_b", "x | X|[]", "s1"), (None, "", None)], "l string, c string, s string")
    got = [[tuple(x) for x in r[0]] for r in row.select(varied.queue_features("l", "c", "s")).collect()]
    assert got == [[("label:tent", 3.0), ("label:tent", 2.0), ("label:a b", 1.0), ("category:x", 1.0), ("category:x", 1.0), ("source:s1", 1.0)], []]


R6 = "source_content_id string, queue_type string, candidate_id string, time_position_ms long, group_start_ms long, group_end_ms long, at string, chunk string"


def _runs(data, gap=250):
    groups = {}
    for s, q, c, t, a, b, *_ in data:
        if None not in (s, q, c, t) and t >= 0:
            x, y = (a if a is not None and a >= 0 else t), (b if b is not None and b >= 0 else t)
            groups.setdefault((s, q), []).append((t, c, min(x, y), max(x, y)))
    out = []
    for g, frames in groups.items():
        run = []
        for f in sorted(frames):
            if run and not (abs(f[2] - run[-1][2]) <= gap and abs(f[3] - run[-1][3]) <= gap):
                out.append((*g, run[0][1], run[-1][1], len(run), run[-1][0] - run[0][0]))
                run = []
            run.append(f)
        out.append((*g, run[0][1], run[-1][1], len(run), run[-1][0] - run[0][0]))
    return sorted(out)


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 7), (3, 16)])
def test_runs_match_brute_force_over_any_chunks(spark, monkeypatch, seed, parts):
    monkeypatch.setattr(runs, "FAN_IN", 2 if seed > 1 else 256)
    r = random.Random(seed)
    data = []
    for i in range(800):
        t = r.choice([None, -1, 0]) if r.random() < 0.1 else r.randrange(20000)
        bound = lambda t=t: r.choice([None, -1]) if r.random() < 0.1 else (t or 0) // 3000 * 3000 + r.choice([0, 200, 251])
        data.append((r.choice(["hot", "hot", "b", None]), r.choice(["x", "y"]), f"c{i:04d}", t, bound(), bound(), "clash", "clash"))
    data += [("one", "x", f"d{i:04d}", i, 0, 0, "", "") for i in range(300)]  # one run over many chunks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = runs.runs(spark.createDataFrame(data, R6), ["source_content_id", "queue_type"], "time_position_ms", "candidate_id", "group_start_ms", "group_end_ms")
        assert rows_of(got.select("source_content_id", "queue_type", "first_id", "last_id", "frames", "duration_ms")) == _runs(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_runs_of_an_empty_table(spark):
    assert runs.runs(spark.createDataFrame([], R6), ["source_content_id"], "time_position_ms", "candidate_id", "group_start_ms", "group_end_ms").count() == 0

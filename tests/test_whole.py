"""Queries over small tables on which a cut would lose rows."""

from framelode.plans import registry


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


UNITS = "visual_unit_id string, source_content_id string, time_position_ms long, luma_mean double, luma_std double, near_black int"


def test_every_term_of_the_registry_is_a_mention(spark, tmp_path):
    labels = ["car", "ｔｒｕｃｋ", "red-lantern", "kite2", "person", "boat"]
    d = put(
        spark, tmp_path,
        visual_units=([(f"f{i}", "s", i * 1000, 1.0, 1.0, 0) for i in range(2)], UNITS),
        yolo_visual_unit_label=([(f"f{i}", x) for i in range(2) for x in labels], "visual_unit_id string, label string"),
        visual_label_terms=([("car", "汽车", '["auto  mobile"]'), ("truck", "卡车", None), ("red lantern", "红灯笼", "[broken"), ("person", "人", '["human"]'), ("boat", None, '["ship"]')], "label string, label_zh string, search_terms_json string"),
        documents=([("f0", "旁边有汽车和卡车。", " QwenVL_caption "), ("f0", "一盏红灯笼，kite2. 有人 spaceship", "qwenvl_caption"), ("f1", "An AUTO\nMOBILE, a human; a carpet", "qwenvl_caption"), ("f1", "a truck, a boat", "ocr_text"), ("f1", "a boat", "propagated_labels"), ("f1", None, "qwenvl_caption"), (None, "ship", "qwenvl_caption")], "visual_unit_id string, text string, source string"),
    )
    got = rows_of(registry.queries()["propagated_labels"](spark, d).select("anchor", "target", "label"))
    assert got == sorted([("f0", "f1", x) for x in ("car", "ｔｒｕｃｋ", "red-lantern", "kite2")] + [("f1", "f0", x) for x in ("car", "person")])
    targets = {r.target: r.labels for r in registry.queries()["propagation_targets"](spark, d).collect()}
    assert targets == {"f1": "car|kite2|red-lantern|ｔｒｕｃｋ", "f0": "car|person"}


def test_clusters_join_vectors_of_different_labels(spark, tmp_path):
    rows = [(1, [1.0, 0.0, 0.0], "car"), (2, [0.9, 0.1, 0.0], "bus"), (3, [0.0, 1.0, 0.0], "car"), (4, [0.0, 0.0, 1.0], "sky"), (5, [0.8, 0.0, 0.1], "car"), (8, [1.0, 0.0, 0.05], "car")]
    d = put(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label string"))
    got = {r.vec_id: r.cluster for r in registry.queries()["identity_clusters"](spark, d).collect()}
    # 1 and 8 are of one unit (their label and vec_id % 7) and stay apart
    assert got[3] == 3 and got[4] == 4 and got[1] != got[8] and sorted(got) == [1, 2, 3, 4, 5, 8]
    assert got[2] in (got[1], got[8]) and got[5] in (got[1], got[8])


def test_bands_span_each_source(spark, tmp_path):
    rows = [(f"f{t}", "s", t, 1.0, float(t % 7), 0) for t in range(1000, 400_000, 9000)] + [("one", "r", 500_000, 1.0, 1.0, 0)]
    d = put(spark, tmp_path, visual_units=(rows, UNITS))
    got = rows_of(registry.queries()["best_in_bands"](spark, d))
    want = []
    for s in ("r", "s"):
        own = [x for x in rows if x[1] == s]
        first, span = min(x[2] for x in own), max(1, max(x[2] for x in own) - min(x[2] for x in own))
        for b in range(3):
            low, high = first + span * b / 3, first + span * (b + 1) / 3
            if band := [x for x in own if low <= x[2] <= high]:
                want.append((s, low, max(band, key=lambda x: (x[4], -x[2], x[0]))[0]))
    assert got == sorted(want) and len(got) == 4

"""Small tables with the columns of a catalogue that the data directories lack, for both sides of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from framelode.plans.base import Tables

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "unit_identity": ("unit string, canonical string, source string, sha string, failed boolean", [
        ("u1", "u1", "s1", "aa", False), ("u2", "u1", "s1", "aa", False), ("u3", "u1", "s1", "aa", False), ("u4", "u4", "s1", "bb", False), ("u5", "u4", "s1", "cc", False), ("u6", "u4", "s1", "bb", False),
        ("u7", "u7", "s2", "dd", False), ("u8", None, "s2", None, True), ("u9", "u9", "s2", None, False), ("v1", "u9", "s2", None, False), ("v2", "v2", "s3", "", False), ("v3", "v2", "s3", "", None),
    ]),
    "used_units": ("unit string", [("u1",), ("u2",), ("u8",), (None,), ("zz",), ("u2",)]),
    "text_labels": ("unit string, label string, confidence double, area double", [
        ("u1", "sign", 0.8, 0.02), ("u1", "menu", 0.6, 0.05), ("u1", "person", 0.9, 0.4), ("u2", "paper", 0.9, 0.5), ("u3", "sign", None, None), ("u4", "sign", 0.55, 0.3), ("u5", "menu", 0.9, 0.004), ("u5", "sign", 0.7, 0.004), ("u6", "menu", 0.9, 0.3),
    ]),
    "text_frames": ("unit string, src string, t bigint, sound boolean", [("u1", "s1", 0, True), ("u2", "s1", 10, True), ("u3", "s1", 20, True), ("u4", "s1", 30, True), ("u5", "s2", 5, True), ("u6", "s2", 9, False)]),
    "tail_frames": ("src string, id string, t bigint", [("a", f"a{i}", i * 1000) for i in range(10)] + [("b", f"b{i}", 9000 + i) for i in range(4)] + [("c", "c0", None), ("c", "c1", 9500)]),
    "tail_anchors": ("src string, anchor bigint, tail bigint, short boolean", [("a", 0, 7000, False), ("a", 6, 7000, False), ("a", 9, 7000, False), ("a", 8, 9500, False), ("b", 1, 8000, False), ("b", 2, 8000, True), ("b", 3, None, False), ("c", 0, 9000, False)]),
    "ocr_results": ("candidate_id string, source_content_id string, derived_id string, item_status string, result_status string, ocr_text string, ocr_text_sha256 string, ocr_lines_json string, ocr_line_count bigint, mean_confidence double", [
        ("c1", "s1", "d1", "success", "success", "Platform 12", "6d213587671b2d46e658750bef718855ff933e6e0fef1cab7a317723a83cc003", '["Platform 12"]', 1, 0.9),
        ("c2", "s1", "d2", "success", "success", "exit", None, '["exit"]', 2, 0.9), ("c3", "s1", "d3", "failed", "no_text", "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "[]", 0, None),
        ("c4", "s2", "dX", "success", "no_text", None, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "[]", 0, 0.5), ("c5", "s2", "d5", "success", "no_text", "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "[]", 0, 0.95),
        ("c6", "s2", "d6", "success", "success", " Exit", None, "{broken", 1, 0.81), ("c9", "s2", "d9", "success", "success", "   ", None, '[{"text": "x"}]', 1, 0.99),
    ]),
    "ocr_queue": ("candidate_id string, source_content_id string, derived_id string", [(f"c{i}", "s1" if i < 4 else "s2", f"d{i}") for i in range(1, 7)]),
    "person_members": ("person_cluster_id string, face_id string, representative_face_id string, visual_unit_id string, media_type string, similarity_to_representative double, member_count bigint, distinct_source_count bigint, cluster_confidence string, human_review_status string", [
        ("p1", "f1", "f1", "u1", "image", 1.0, 4, 2, "high", None), ("p1", "f2", "f1", "u2", "video", 0.8, 4, 2, "high", None), ("p1", "f3", "f1", "u2", "video", 0.9, 4, 2, "high", None), ("p1", "f4", "f1", "u3", "image", 0.9, 4, 2, "high", None),
        ("p2", "f5", "f5", "u1", "image", 1.0, 2, 1, "high", None), ("p2", "f6", "f5", "u4", "image", 0.7, 2, 1, "high", None), ("p3", "f7", "f7", "u5", "image", 1.0, 2, 1, "review", "confirmed"), ("p3", "f8", "f7", "u6", "image", 0.5, 2, 1, "review", "confirmed"),
        ("p4", "f9", "f9", "u7", "image", 1.0, 1, 1, "singleton", "confirmed"), ("p5", "g1", "g1", "u8", "image", 1.0, 3, 3, "review", None),
    ]),
    "layouts": ("src string, n bigint, raw string, content string", [("a", 1, "wide", "wide"), ("a", 2, "wide", "tall"), ("a", 3, "tall", "tall"), ("a", 4, "wide", "tall"), ("b", 1, "tall", "x"), ("b", 2, "tall", "x")]),
    "pixel_boxes": ("box string, x1 double, y1 double, x2 double, y2 double, width double, height double", [
        ("b1", 10.0, 20.0, 110.0, 220.0, 200.0, 400.0), ("b2", 0.1, 0.2, 0.6, 0.7, 200.0, 400.0), ("b3", 0.5, 0.5, 0.5, 0.9, 200.0, 400.0), ("b4", -10.0, 5.0, 500.0, 50.0, 200.0, 100.0), ("b5", 1.2, 0.0, 1.4, 1.0, 10.0, 10.0),
    ]),
    "text_documents": ("document_id bigint, text_vector_id string, embedding_text string, x double, y double", [
        (1, "v1", "a tent by the sea", 1.0, 0.0), (2, "v1", "a tent by the sea", 1.0, 0.0), (3, "v2", "camp fire", 0.8, 0.6), (4, "v3", "The Tent burns", 0.0, 1.0), (5, "v4", "street", 0.6, 0.8), (6, "v1", "a tent by the sea", 1.0, 0.0), (7, "v5", "night", -1.0, 0.0),
    ]),
}


def rows(t: Tables, name: str) -> DataFrame:
    schema, data = TABLES[name]
    return t.spark.createDataFrame(data, schema)


def values(*names: str) -> str:
    """The same tables as common table expressions."""

    def cell(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    out = []
    for name in names:
        schema, data = TABLES[name]
        columns = [c.strip().split(" ") for c in schema.split(", ")]
        kinds = {"string": "VARCHAR"}
        made = ", ".join(f"c{i}::{kinds.get(k, k.upper())} AS {c}" for i, (c, k) in enumerate(columns))
        listed = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in data)
        out.append(f"{name} AS (SELECT {made} FROM (VALUES {listed}) v({', '.join(f'c{i}' for i in range(len(columns)))}))")
    return ", ".join(out)

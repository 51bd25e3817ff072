"""Boxes, JSON walks and leak checks; the other operators of a catalogue have SQL of the same rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from framelode.operators import catalogue


def test_boxes_are_suppressed_like_one_by_one(spark):
    r = random.Random(3)
    rows = []
    for i in range(80):
        x, y = r.randrange(40), r.randrange(40)
        rows.append((f"i{r.randrange(3)}", f"b{i:02d}", float(x), float(y), float(x + r.randrange(1, 25)), float(y + r.randrange(1, 25)), r.choice([0.5, r.random()])))
    df = spark.createDataFrame(rows, "image string, box string, x1 double, y1 double, x2 double, y2 double, score double")

    def overlap(a, b):
        inner = max(0, min(a[4], b[4]) - max(a[2], b[2]) + 1) * max(0, min(a[5], b[5]) - max(a[3], b[3]) + 1)
        area = lambda c: (c[4] - c[2] + 1) * (c[5] - c[3] + 1)
        return inner / (area(a) + area(b) - inner)

    want = []
    for image in ("i0", "i1", "i2"):
        kept = []
        for row in sorted((x for x in rows if x[0] == image), key=lambda x: (-x[6], x[1])):
            if all(overlap(row, k) <= 0.4 for k in kept):
                kept.append(row)
        want += [k[:2] for k in kept]
    assert sorted(tuple(x) for x in catalogue.suppressed_boxes(df, "image", "box", 0.4).collect()) == sorted(want) and len(want) < 80
    assert catalogue.suppressed_boxes(df.limit(0), "image", "box", 0.4).count() == 0


def test_lines_are_found_at_any_depth(spark):
    blob = {"pages": [{"items": [{"text": " EXIT ", "score": 0.5, "box": [[1, 2]]}, {"text": "EXIT", "confidence": 0.5, "bbox": [[1, 2]]}]}, {"text": "", "x": {"text": "inner"}}], "text": 3}
    rows = [(json.dumps(blob),), ("{broken",), (None,), ("[]",)]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame(rows, "b string").select(catalogue.recognised_lines("b")).collect()]
    assert got == [[("EXIT", 0.5, "[[1,2]]"), ("inner", None, None)], [], [], []]
    cut = spark.createDataFrame([('{"b": {"image": 1, "a": [{"image": 2, "x": "é"}]}, "raw": 0}',), ("{broken",), (None,)], "b string").select(catalogue.without_keys("b", F.lit("image|raw")))
    assert [r[0] for r in cut.collect()] == ['{"b":{"a":[{"x":"é"}]}}', None, None]


def test_leaks_end_a_stage(spark):
    used, allowed = spark.createDataFrame([("a",), ("b",), (None,)], "u string"), spark.createDataFrame([("a",), ("c",)], "k string")
    with pytest.raises(ValueError, match="not canonical: b"):
        catalogue.assert_no_leaks(used, "u", allowed, "k")
    catalogue.assert_no_leaks(used.where("u = 'a'"), "u", allowed, "k")

"""Functions on columns, against plain Python and golden values."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from framelode.functions import hashing, text, times, vectors
from framelode.operators import search


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize("query, body, found", [("人", "人民公园", False), ("人", "行人在路上", False), ("人", "相邻对象：人（person）", True), ("小麦", "金色小麦田", True), ("Tent", "a TENT here", True), ("", "x", False), ("tent", "ＴＥＮＴ", True), ("STRASSE", "in der Straße", True), ("人", "一｜人［x］", True), ("ﬁn", "FIN", True)])
def test_exact_query(spark, query, body, found):
    assert values(spark, [(body,)], "t string", text.has_exact_query(F.col("t"), query)) == [(found,)]


def test_normal_forms(spark):
    rows = [("Ａ　 b\r\n\r\n c\td ",), (None,), ("",)]
    assert values(spark, rows, "t string", text.normalize_text(F.col("t")), text.normal_query_column(F.col("t"))) == [("Ａ　 b\nc d", "A b c d"), (None, None), ("", "")]
    assert text.normalize_query(" Ｔｅｎｔ\n x ") == "Tent x"
    assert values(spark, [("Straße",)], "t string", text.casefold("t")) == [("strasse",)]


def test_terms_have_boundaries_only_where_they_are_words(spark):
    rows = [("a cardboard box", "car"), ("the car.", "car"), ("两辆汽车", "汽车"), ("x", ""), ("C++ code", "c++"), ("ambiguous", "ambiguous")]
    assert [x for (x,) in values(spark, rows, "t string, w string", text.term_matches(F.col("t"), F.col("w"), ("ambiguous",)))] == [False, True, True, False, True, False]


def test_longest_run_and_degenerate(spark):
    rows = [("aabbb\n\n\n\n",), ("!" * 64,), ("! " * 64,), ("ab" * 64,), ("",)]
    def run(s):
        return max((len(m.group()) for m in re.finditer(r"(.)\1*", s, re.S)), default=0)
    got = values(spark, rows, "t string", text.longest_run(F.col("t")), text.is_degenerate(F.col("t")))
    assert got == [(run(t), d) for (t,), d in zip(rows, [False, True, True, False, False], strict=True)]


def test_quality_adds_its_penalties(spark):
    rows = [("", True), ("12345678901234567890", True), ("a good long caption of a scene", False), ("!!!!!!!!!!", True), ("画面中有一座帐篷，旁边是一辆红色的卡车，天气晴朗。", False), ("看起来像一座桥，无法判断在哪里，也无法确定时间和地点。", False), ("12:30 / 4-5", True), ("word word", True)]
    q = text.text_quality(F.col("t"), F.col("o"))
    assert values(spark, rows, "t string, o boolean", q["quality_score"], q["quality_status"], q["quality_reasons"]) == [
        (125, "suspicious_high", "empty_text|too_short"), (85, "suspicious_high", "ocr_noise_pattern|mostly_digits|no_language_chars"), (0, "ok", ""), (95, "suspicious_high", "long_repeated_char_run|ocr_noise_pattern|no_language_chars"),
        (25, "review_low", "generic_short_caption"), (50, "suspicious_medium", "generic_short_caption|uncertain_or_refusal_like"), (70, "suspicious_high", "ocr_noise_pattern|no_language_chars"), (0, "ok", ""),
    ]
    m = text.char_metrics(F.col("t"))
    assert values(spark, [("a, b_c…!  é",)], "t string", m["punct_count"], m["text_len"], m["unique_char_count"]) == [(3, 11, 9)]


def test_answers_are_cleaned(spark):
    raw = "Files: x\n<|im_start|>assistant\nA man.\r\n\r\n\r\n\r\nAt /Users/me/a.jpg now.<|im_end|>\n==========\nPrompt: 12 tokens, 3.5 tokens-per-sec\nGeneration: 30 tokens, 40.25 tokens-per-sec\nPeak memory: 7.5 GB"
    m = text.run_metrics(F.col("t"))
    assert values(spark, [(raw,)], "t string", text.clean_answer(F.col("t")), *m.values()) == [("A man.\n\nAt  now.", 12, 3.5, 30, 40.25, 7.5)]
    assert values(spark, [("x",)], "t string", *m.values()) == [(None,) * 5]
    raws = [("ASSISTANT:\nno\nassistant\nyes\nassistant\nagain",), ("===\nFiles: ['a.jpg']\n\nOnly this",), ("Files: [x\ny]\nThat\nGeneration: 3 tokens",), ("Assistant:\nHello<|endoftext|>x",)]
    assert values(spark, raws, "t string", text.clean_answer(F.col("t"))) == [("yes\nassistant\nagain",), ("Only this",), ("That",), ("Hello",)]


def test_paths(spark):
    p = F.col("p")
    got = values(spark, [("a/b/c/d/img_0012_7.JPG",), ("x.tar.gz",), ("dir/none",)], "p string", text.stem_key(p), text.folder(p), text.extension(p), text.numeric_tail(p), text.source_bucket(p))
    assert got == [("a/b/c/d/img_0012_7", "a/b/c/d", ".jpg", 7, "b/c/d"), ("x.tar", "", ".gz", None, ""), ("dir/none", "dir", "", None, "dir")]


def test_digests(spark):
    rows = [("b", 1), ("a", None)]
    df = spark.createDataFrame(rows, "x string, n int")
    assert df.agg(hashing.set_digest(F.col("x"))).first()[0] == hashlib.sha256(b"a\nb").hexdigest()
    assert df.select(hashing.canonical_json({"n": F.col("n"), "x": F.col("x")})).collect()[1][0] == '{"n":null,"x":"a"}'
    assert df.select(hashing.stable_id("p_", [F.col("x"), F.col("n")])).collect()[1][0] == "p_" + hashlib.sha256(b"a|").hexdigest()[:24]
    digest = lambda d: d.agg(hashing.multiset_digest(F.col("x"), F.col("n"))).first()[0]
    assert digest(df) == digest(df.orderBy("x").repartition(3)) != digest(df.union(df))
    assert values(spark, [("ffffffffffffffff", "0" * 16), ("8000000000000000", "0000000000000001")], "a string, b string", hashing.hamming_hex(F.col("a"), F.col("b"))) == [(64,), (2,)]


def test_three_jaccards_and_cosines_differ_in_nulls(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"])]
    j = [f(F.col("a"), F.col("b")) for f in (vectors.jaccard, vectors.jaccard_distance, vectors.jaccard_full)]
    assert values(spark, rows, "a array<string>, b array<string>", *j) == [(None, 0.0, 1.0), (None, 1.0, 0.0), (1 / 3, 1 - 1 / 3, 1 / 3)]
    v = [([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]), (None, [1.0])]
    got = values(spark, v, "a array<double>, b array<double>", vectors.cosine(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("a"), F.col("b")))
    assert got == [(None, 0.0), (None, 0.0), (1.0, 0.0), (None, 0.0)]
    assert values(spark, [([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), ([1.0, 1.0], [1.0, 2.0])], "a array<double>, b array<double>", F.round(vectors.correlation(F.col("a"), F.col("b")), 9)) == [(1.0,), (1.0,)]


def test_boxes(spark):
    box = lambda *b: (list(map(float, b)),)
    made = vectors.normal_box(F.col("b"), F.lit(100.0), F.lit(50.0))
    assert values(spark, [box(0, 0, 50, 25), box(0.1, 0.1, 0.5, 2.0), box(0.5, 0.5, 0.5, 0.9)], "b array<double>", made) == [([0.0, 0.0, 0.5, 0.5],), ([0.001, 0.002, 0.005, 0.04],), (None,)]


def test_labels_fall_into_the_first_family_that_fits(spark):
    families = {"vehicle": ["car"], "human": ["person"]}
    assert values(spark, [("cardboard",), ("person",), ("sky",), ("tree",)], "l string", vectors.category_for(F.col("l"), families, ("sky",))) == [("vehicle",), ("human",), ("weak",), ("other",)]


def test_times(spark):
    got = values(spark, [(0,), (61_005,), (3_600_000,), (-1,), (None,)], "t long", times.timecode(F.col("t"), millis=True))
    assert got == [("00:00.000",), ("01:01.005",), ("01:00:00.000",), ("--:--",), ("--:--",)]
    dates = [("2024:01:02 03:04:05.99",), ("20240102_030405",), ("2024/01/02 03:04:05",), ("junk",)]
    assert [x for (x,) in values(spark, dates, "d string", times.iso(times.parse_any(F.col("d"))))] == ["2024-01-02T03:04:05Z"] * 3 + [None]


def test_gate_and_fusion(spark):
    rows = [(1, 0.2, None, 0.9, False), (2, 0.4, None, 0.9, False), (3, 0.1, 0.1, None, True), (4, 0.25, 0.41, None, False), (5, 0.1, None, None, False)]
    df = spark.createDataFrame(rows, "id int, visual double, text double, object double, exact_text boolean")
    config = search.SearchConfig()
    out = {r.id: r for r in search.fuse(df, "id", config).withColumn("reasons", search.gate(config)).withColumn("relevance", search.relevance()).collect()}
    assert {k: v.reasons for k, v in out.items()} == {1: "", 2: "exact_object_label|visual", 3: "exact_text", 4: "combined_visual_text", 5: ""}
    assert out[2].rrf == pytest.approx(1 / 61 + 0.4 / 62) and out[2].relevance == pytest.approx(0.93)
    assert 0 < out[3].relevance < out[2].relevance <= 0.99
    with pytest.raises(ValueError):
        search.SearchConfig(k=0)
    with pytest.raises(ValueError):
        search.check_queries(["a", " Ａ".lower().replace("ａ", "a")])

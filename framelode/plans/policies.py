"""Scores, budgets, pools and audits of frame selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import vectors
from framelode.operators import aggregates, audit, greedy, identity, selection, tables, windows
from framelode.plans.base import FRAMES, LABELS, NOVEL, QUEUE, Tables, query

_CHANGE = f"""WITH {FRAMES}, c AS (SELECT *, abs(luma - lag(luma) OVER w) / 255.0::DOUBLE AS mad, abs(std - lag(std) OVER w) / 255.0::DOUBLE AS edge FROM f WINDOW w AS (PARTITION BY src ORDER BY t, id)), d AS (SELECT *, 2 * mad AS area, 1.5::DOUBLE * mad AS hist FROM c WHERE mad IS NOT NULL)"""


def _changes(t: Tables) -> DataFrame:
    """Change to the frame before, from the columns that the tables hold: brightness and contrast stand for pixels and edges."""
    w = windows.in_source("src", "t", "id")
    c = t.frames.withColumn("mad", F.abs(F.col("luma") - F.lag("luma").over(w)) / 255.0).withColumn("edge", F.abs(F.col("std") - F.lag("std").over(w)) / 255.0)
    return c.where("mad is not null").withColumn("area", 2 * F.col("mad")).withColumn("hist", 1.5 * F.col("mad"))


@query(_CHANGE + """ SELECT id, CASE WHEN mad < 0.015 AND area < 0.04 AND hist < 0.050 THEN 'near_duplicate' WHEN mad < 0.040 AND area < 0.12 AND hist < 0.120 THEN 'minor_motion' WHEN mad < 0.105 AND area < 0.34 AND edge < 0.050 THEN 'normal_change' ELSE 'strong_change' END AS class,
    round(mad * 2.2::DOUBLE + area * 0.9::DOUBLE + edge * 1.6::DOUBLE + hist * 0.7::DOUBLE + mad * 0.9::DOUBLE, 6) AS score FROM d""")
def frame_change(t: Tables) -> DataFrame:
    c = _changes(t)
    cls = vectors.change_class(F.col("mad"), F.col("area"), F.col("edge"), F.col("hist"))
    return c.select("id", cls.alias("class"), F.round(vectors.change_score(F.col("mad"), F.col("area"), F.col("edge"), F.col("hist"), F.col("mad")), 6).alias("score"))


@query(f"WITH {FRAMES} SELECT id, round(0.24::DOUBLE * (1 - least(abs(luma / 255 - 0.5) / 0.5, 1)) + 0.24::DOUBLE * least(std / 255 / 0.28, 1), 6) AS quality FROM f")
def frame_quality(t: Tables) -> DataFrame:
    """Quality from brightness and contrast; entropy, edges and exposure aren't in the tables and count as none."""
    z = F.lit(0.0)
    return t.frames.select("id", F.round(vectors.image_quality(F.col("luma") / 255, F.col("std") / 255, z, z, z, z), 6).alias("quality"))


@query(_CHANGE + """, r AS (SELECT src, mad, row_number() OVER (PARTITION BY src ORDER BY mad) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM d) SELECT src, CASE WHEN mad < 0.02 THEN 'low' WHEN mad < 0.10 THEN 'normal' ELSE 'high' END AS dynamics FROM r WHERE r = greatest(ceil(0.9 * n) - 1, 0)""")
def source_dynamics(t: Tables) -> DataFrame:
    p = aggregates.percentile_nearest(_changes(t), ["src"], "mad", 0.9)
    return p.select("src", selection.dynamics_class(F.col("value")).alias("dynamics"))


@query(f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM f), p AS (SELECT src, max(CASE WHEN r = 0 THEN luma END) AS a, max(CASE WHEN r = round_even((n - 1) * 0.5, 0) THEN luma END) AS b, max(CASE WHEN r = n - 1 THEN luma END) AS c FROM r WHERE n >= 3 GROUP BY src)
    SELECT src, CASE WHEN abs(a - b) <= 6 AND abs(b - c) <= 6 THEN 'middle' WHEN abs(a - b) <= 6 THEN 'middle|last' WHEN abs(b - c) <= 6 THEN 'first|middle' ELSE 'first|middle|last' END AS kept FROM p""")
def timelapse_positions(t: Tables) -> DataFrame:
    r = windows.ranks(t.frames, "src", [F.col("t"), F.col("id")]).where("total >= 3")
    at = lambda c: F.max(F.when(c, F.col("luma")))
    p = r.groupBy("src").agg(at(F.col("rank") == 0).alias("a"), at(F.col("rank") == F.bround((F.col("total") - 1) * 0.5)).alias("b"), at(F.col("rank") == F.col("total") - 1).alias("c"))
    return p.select("src", selection.collapse_positions(F.abs(F.col("a") - F.col("b")) <= 6, F.abs(F.col("b") - F.col("c")) <= 6).alias("kept"))


@query(f"""WITH {QUEUE} SELECT candidate_id, regexp_matches(lower(coalesce(labels, '')), 'text|sign|screen|monitor|book') AS ocr, NOT regexp_matches(lower(coalesce(labels, '')), 'text|sign|screen|monitor|book') AND candidate_score > 3 AS high_value FROM q""")
def ocr_hints(t: Tables) -> DataFrame:
    """Labels that carry text send a frame to text recognition, before its score counts."""
    hint = F.lower(F.coalesce("labels", F.lit(""))).rlike("text|sign|screen|monitor|book")
    return t.queue.select("candidate_id", hint.alias("ocr"), (~hint & (F.col("candidate_score") > 3)).alias("high_value"))


@query(f"""WITH {FRAMES}, s AS (SELECT src, count(*) AS n, (max(t) - min(t)) / 1000.0::DOUBLE AS d FROM f GROUP BY src) SELECT src, CASE WHEN n <= 8 THEN 1 WHEN n <= 20 THEN 2 WHEN n <= 60 THEN 4 ELSE 6 END AS by_count, CASE WHEN n <= 20 THEN 1 WHEN n <= 100 THEN 2 ELSE 3 END AS supplements,
    CASE WHEN d < 20 THEN 1 WHEN d < 60 THEN 2 WHEN d < 180 THEN least(3, ceil(d / 60)) WHEN d < 600 THEN least(5, ceil(d / 60)) ELSE least(10, ceil(d / 60)) END::BIGINT AS by_length FROM s""")
def source_budgets(t: Tables) -> DataFrame:
    s = t.frames.groupBy("src").agg(F.count("*").alias("n"), ((F.max("t") - F.min("t")) / 1000.0).alias("d"))
    return s.select("src", selection.count_budget(F.col("n")).alias("by_count"), selection.supplement_cap(F.col("n")).alias("supplements"), selection.duration_budget(F.col("d")).cast("bigint").alias("by_length"))


@query(f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM f), a AS (SELECT src, r, id AS anchor FROM r WHERE (((r - n // 2) % 6) + 6) % 6 = 0)
    SELECT anchor, id FROM (SELECT anchor, r.id, row_number() OVER (PARTITION BY anchor ORDER BY round(std - 0.18 * abs(r.r - a.r), 6) DESC, abs(r.r - a.r), r.t, r.id) AS k FROM a JOIN r ON r.src = a.src AND abs(r.r - a.r) <= 2) WHERE k = 1""")
def best_near_anchor(t: Tables) -> DataFrame:
    """The best frame within two ranks of an anchor, each rank away costing 0.18."""
    ranked = windows.ranks(t.frames, "src", [F.col("t"), F.col("id")])
    a = selection.anchors(t.frames, "src", "t", "id").select("src", F.col("id").alias("anchor"), F.explode(F.array(*[F.col("rank") + i for i in range(-2, 3)])).alias("r"), F.col("rank").alias("at"))
    met = a.join(ranked.select("src", F.col("rank").alias("r"), "id", "t", "std"), ["src", "r"]).withColumn("far", F.abs(F.col("r") - F.col("at")))
    w = Window.partitionBy("anchor").orderBy(F.desc(F.round(F.col("std") - 0.18 * F.col("far"), 6)), "far", "t", "id")
    return met.withColumn("k", F.row_number().over(w)).where("k = 1").select("anchor", "id")


_NEXT = f"""WITH {FRAMES}, {LABELS}, g AS (SELECT unit, list_sort(list(label)) AS ls FROM l GROUP BY unit), r AS (SELECT f.*, row_number() OVER (PARTITION BY src ORDER BY t, f.id) AS r, coalesce(ls, []::VARCHAR[]) AS ls FROM f LEFT JOIN g ON unit = f.id),
    p AS (SELECT a.id AS a, b.id AS b, b.t - a.t AS gap, abs(a.luma - b.luma) AS mad, CASE WHEN len(a.ls) > 0 AND len(b.ls) > 0 THEN len(list_intersect(a.ls, b.ls)) / len(list_distinct(list_concat(a.ls, b.ls)))::DOUBLE END AS jac FROM r a JOIN r b ON a.src = b.src AND b.r = a.r + 1)"""


@query(_NEXT + " SELECT a, b, gap <= 12000 AND mad <= 6 AND coalesce(jac >= 0.8, false) AS duplicate, mad > 10 OR coalesce(jac < 0.60, false) AS novel, round(jac, 6) AS jaccard FROM p")
def neighbour_pairs(t: Tables) -> DataFrame:
    """Whether a frame repeats the one before it, or is new against it; no vectors are at hand, and brightness stands for the grid."""
    g = t.labels.groupBy("unit").agg(F.collect_list("label").alias("ls"))
    r = t.frames.join(g, F.col("id") == F.col("unit"), "left").withColumn("ls", F.coalesce("ls", F.array().cast("array<string>")))
    w = windows.in_source("src", "t", "id")
    p = r.select(F.lag("id").over(w).alias("a"), F.col("id").alias("b"), (F.col("t") - F.lag("t").over(w)).alias("gap"), F.abs(F.col("luma") - F.lag("luma").over(w)).alias("mad"), F.lag("ls").over(w).alias("la"), F.col("ls").alias("lb")).where("a is not null")
    none, one, jac = F.lit(None).cast("double"), F.lit(1.0), vectors.jaccard(F.col("la"), F.col("lb"))
    return p.select("a", "b", identity.is_duplicate_frame(F.col("gap"), none, F.col("mad"), one, jac).alias("duplicate"), identity.is_novel(none, F.col("mad"), jac).alias("novel"), F.round(jac, 6).alias("jaccard"))


@query(f"""WITH x AS (SELECT visual_unit_id AS unit, sum(ln(1 + greatest(coalesce(detection_count, 0), 0))) AS s, count(DISTINCT label) AS k FROM yolo_visual_unit_label WHERE visual_unit_id IS NOT NULL AND label IS NOT NULL GROUP BY visual_unit_id) SELECT unit, round(s + CASE WHEN k >= 3 THEN 0.5::DOUBLE ELSE 0 END, 5) AS score FROM x""")
def label_weights(t: Tables) -> DataFrame:
    """Many boxes count by their logarithm, and three labels together a little more."""
    x = t.yolo_visual_unit_label.where("visual_unit_id is not null and label is not null").groupBy(F.col("visual_unit_id").alias("unit")).agg(F.sum(F.log1p(F.greatest(F.coalesce("detection_count", F.lit(0)), F.lit(0)))).alias("s"), F.countDistinct("label").alias("k"))
    return x.select("unit", F.round(F.col("s") + F.when(F.col("k") >= 3, 0.5).otherwise(0.0), 5).alias("score"))


@query(f"""WITH {QUEUE}, e AS (SELECT candidate_id, kind, unnest(string_split(labels, '|')) AS part FROM q WHERE labels IS NOT NULL) SELECT candidate_id, kind, lower(trim(regexp_replace(part, ':\\s*\\d+\\s*$', ''))) AS label, coalesce(TRY_CAST(nullif(regexp_extract(part, ':\\s*(\\d+)\\s*$', 1), '') AS INT), 1) AS n FROM e WHERE trim(part) <> ''""")
def detection_rows(t: Tables) -> DataFrame:
    """A row for each label of a candidate, with its count (one where none is given)."""
    e = t.queue.where("labels is not null").select("candidate_id", "kind", F.explode(F.split("labels", r"\|")).alias("part")).where("trim(part) <> ''")
    label = F.lower(F.trim(F.regexp_replace(F.regexp_replace("part", r":\s*\d+\s*$", ""), r"^[　]+|[　]+$", "")))
    return e.select("candidate_id", "kind", label.alias("label"), F.coalesce(F.nullif(F.regexp_extract("part", r":\s*(\d+)\s*$", 1), F.lit("")).try_cast("int"), F.lit(1)).alias("n"))


@query(f"""WITH {FRAMES}, h AS (SELECT *, CASE WHEN t <= (min(t) OVER p + max(t) OVER p) / 2 THEN 'early' ELSE 'late' END AS stage FROM f WINDOW p AS (PARTITION BY src)) SELECT src, stage, max_by(id, (std, -t, id)) AS id FROM h GROUP BY src, stage""")
def early_and_late(t: Tables) -> DataFrame:
    p = Window.partitionBy("src")
    h = t.frames.withColumn("stage", F.when(F.col("t") <= (F.min("t").over(p) + F.max("t").over(p)) / 2, "early").otherwise("late"))
    return h.groupBy("src", "stage").agg(F.max_by("id", F.struct(F.col("std"), -F.col("t"), F.col("id"))).alias("id"))


@query(f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS r, count(*) OVER (PARTITION BY src) AS n, luma >= coalesce(lag(luma) OVER w, luma) AND luma >= coalesce(lead(luma) OVER w, luma) AS peak FROM f WINDOW w AS (PARTITION BY src ORDER BY t, id)),
    x AS (SELECT src, id, 'time' AS reason FROM r WHERE r IN (0, round_even((n - 1) * 0.5, 0), n - 1) UNION ALL SELECT src, max_by(id, (std, -t, id)), 'sharp' FROM r GROUP BY src UNION ALL SELECT src, max_by(id, (luma, -t, id)), 'peak' FROM r WHERE peak GROUP BY src)
    SELECT src, id, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons FROM x GROUP BY src, id""")
def balanced_pool(t: Tables) -> DataFrame:
    """Frames chosen for their place, sharpness or peak; one chosen twice keeps both reasons."""
    best = lambda df, v, why: df.groupBy("src").agg(F.max_by("id", F.struct(F.col(v), -F.col("t"), F.col("id"))).alias("id")).select("src", "id", F.lit(why).alias("reason"))
    parts = [
        windows.pick_positions(t.frames, "src", [F.col("t"), F.col("id")], [0.0, 0.5, 1.0]).select("src", "id", F.lit("time").alias("reason")),
        best(t.frames, "std", "sharp"), best(windows.local_peaks(t.frames, "src", ["t", "id"], "luma").where("is_peak"), "luma", "peak"),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("src", "id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"))


@query(f"WITH {FRAMES} SELECT src, max_by(id, (std, -t, id)) AS winner, ceil(log2(count(*)))::BIGINT AS rounds FROM f GROUP BY src")
def tournament(t: Tables) -> DataFrame:
    """The winner of pairwise rounds is the best frame; a bracket of n frames has ceil(log2(n)) rounds."""
    return t.frames.groupBy("src").agg(F.max_by("id", F.struct(F.col("std"), -F.col("t"), F.col("id"))).alias("winner"), F.ceil(F.log2(F.count("*"))).alias("rounds"))


_DENSE = f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS rank, count(*) OVER (PARTITION BY src) AS n FROM f), m AS (SELECT *, least(n, greatest(1, ceil(round(n * 0.15::DOUBLE, 6))::BIGINT)) AS bins FROM r), b AS (SELECT *, (rank * bins + bins - 1) // n AS bin FROM m),
    s AS (SELECT src, id, t FROM (SELECT *, row_number() OVER (PARTITION BY src, bin ORDER BY std DESC, t, id) AS rn FROM b) WHERE rn = 1), g AS (SELECT *, t - lag(t) OVER (PARTITION BY src ORDER BY t, id) AS gap FROM s)"""


@query(_DENSE + " SELECT src, count(*) AS selected, coalesce(max(gap), 0) AS max_gap, coalesce(max(gap), 0) > 10000 AS too_far FROM g GROUP BY src")
def route_audit(t: Tables) -> DataFrame:
    """Of a selection: frames chosen, the longest gap between them, and whether that is over 10 s."""
    s = selection.density_selection(t.frames.withColumn("high", F.lit(False)), "src", "t", "id", "std", "high", 0.15)
    gap = s.withColumn("gap", F.col("t") - F.lag("t").over(windows.in_source("src", "t", "id")))
    longest = F.coalesce(F.max("gap"), F.lit(0))
    return gap.groupBy("src").agg(F.count("*").alias("selected"), longest.alias("max_gap"), (longest > 10_000).alias("too_far"))


@query("""SELECT CASE WHEN source_content_id IS NULL THEN 'mismatch' WHEN text IS NULL THEN 'failed' WHEN text = '' THEN 'missing' WHEN lang IS NULL OR lang = '' THEN 'parse_error' WHEN n_chars > 2000 THEN 'truncated' ELSE 'success' END AS class, count(*) AS n FROM documents GROUP BY 1""")
def output_classes(t: Tables) -> DataFrame:
    cls = audit.output_class(F.col("source_content_id").isNull(), F.col("text").isNull(), F.col("text") == "", F.coalesce(F.col("lang") != "", F.lit(False)), F.col("n_chars") > 2000)
    return t.documents.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH {FRAMES}, {LABELS}, p AS (SELECT id, EXISTS (SELECT 1 FROM l WHERE unit = id) AS has_labels, EXISTS (SELECT 1 FROM documents WHERE visual_unit_id = id) AS has_text FROM f)
    SELECT CASE WHEN NOT has_text THEN 'no_text' WHEN NOT has_labels THEN 'no_labels' ELSE 'open' END AS reason, count(*) AS n FROM p GROUP BY 1""")
def propagation_blocks(t: Tables) -> DataFrame:
    """Why frames can't be anchors."""
    mark = lambda df, n: df.distinct().withColumn(n, F.lit(True))
    p = t.frames.select("id").join(mark(t.labels.select(F.col("unit").alias("id")), "l"), "id", "left").join(mark(t.documents.select(F.col("visual_unit_id").alias("id")), "d"), "id", "left")
    return p.groupBy(F.when(F.col("d").isNull(), "no_text").when(F.col("l").isNull(), "no_labels").otherwise("open").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {FRAMES}, {LABELS}, a AS (SELECT count(*) AS total, count(*) FILTER (WHERE id IN (SELECT unit FROM l)) AS covered, count(*) - count(DISTINCT (src, t)) AS repeats FROM f) SELECT total, covered, repeats, CASE WHEN covered < 0.95 * total OR repeats > 0.8 * total THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM a""")
def policy_verdict(t: Tables) -> DataFrame:
    f = t.frames.join(t.labels.select(F.col("unit").alias("id"), F.lit(1).alias("has")).distinct(), "id", "left")
    a = f.agg(F.count("*").alias("total"), F.count("has").alias("covered"), (F.count("*") - F.countDistinct("src", "t")).alias("repeats"))
    return a.withColumn("verdict", identity.policy_verdict(F.col("total"), F.col("covered"), F.col("repeats"), F.lit(0)))


@query("""WITH x AS (SELECT lower(trim(label)) AS label, unnest(TRY_CAST(search_terms_json AS VARCHAR[])) AS term FROM visual_label_terms) SELECT DISTINCT label, term FROM x WHERE label <> '' AND term <> ''""")
def term_registry(t: Tables) -> DataFrame:
    """One row for each search term of a label; a registry text that isn't a JSON list has none."""
    terms = F.coalesce(F.from_json("search_terms_json", "array<string>"), F.array().cast("array<string>"))
    return t.visual_label_terms.select(F.lower(F.trim("label")).alias("label"), F.explode(terms).alias("term")).where("label <> '' and term <> ''").distinct()


@query("WITH a AS (SELECT visual_unit_id AS id FROM visual_units WHERE visual_unit_id IS NOT NULL), b AS (SELECT visual_unit_id AS id FROM stop03_2_candidate_queue_items WHERE visual_unit_id IS NOT NULL) SELECT (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) AS only_first, (SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) AS only_second")
def set_equality(t: Tables) -> DataFrame:
    a, b = (df.where("visual_unit_id is not null").select("visual_unit_id") for df in (t.visual_units, t.stop03_2_candidate_queue_items))
    return a.subtract(b).agg(F.count("*").alias("only_first")).join(F.broadcast(b.subtract(a).agg(F.count("*").alias("only_second"))))


@query(f"""WITH {QUEUE}, o AS (SELECT candidate_id, kind, visual_unit_id AS unit, created_at FROM q WHERE candidate_id IS NOT NULL) SELECT max(kind) AS kind, count(DISTINCT candidate_id) AS candidates, count(*) AS rows, count(*) - count(DISTINCT candidate_id) AS superseded FROM o""")
def run_readback(t: Tables) -> DataFrame:
    """What a run left behind, for comparison with its own counters."""
    o = t.queue.where("candidate_id is not null")
    return o.agg(F.max("kind").alias("kind"), F.countDistinct("candidate_id").alias("candidates"), F.count("*").alias("rows"), (F.count("*") - F.countDistinct("candidate_id")).alias("superseded"))


@query("WITH RECURSIVE" + NOVEL.format(rows=f"{FRAMES}, r AS (SELECT src, id, t, luma, std FROM f WHERE black = 0)", alike="abs(x.t - v.t) < 6000 OR (abs(x.t - v.t) <= 12000 AND abs(x.luma - v.luma) <= 2.0)", cap=12))
def screen_text_frames(t: Tables) -> DataFrame:
    """Up to twelve frames of a source that are six seconds apart and resemble none chosen before, sharpest first."""
    near = lambda a, b: (abs(a["t"] - b["t"]) < 6000) | ((abs(a["t"] - b["t"]) <= 12_000) & (abs(a["luma"] - b["luma"]) <= 2.0))
    rows = t.frames.where("black = 0").select("src", "id", "t", "luma", "std")
    return greedy.novel_first(rows, "src", "src string, id string, t bigint", [("std", False), ("t", True), ("id", True)], near, 12, "t", 12_000)


@query("SELECT scan_run_id, epoch(max(updated_at))::BIGINT AS last_seen, count(*) AS files FROM source_file_records WHERE scan_run_id IS NOT NULL GROUP BY scan_run_id ORDER BY last_seen DESC NULLS LAST, scan_run_id LIMIT 10")
def recent_runs(t: Tables) -> DataFrame:
    g = t.source_file_records.where("scan_run_id is not null").groupBy("scan_run_id").agg(F.unix_seconds(F.max("updated_at").cast("timestamp")).alias("last_seen"), F.count("*").alias("files"))
    return g.orderBy(F.desc_nulls_last("last_seen"), "scan_run_id").limit(10)


@query("WITH d AS (SELECT visual_unit_id AS unit, doc_id, text, created_at FROM documents WHERE visual_unit_id IS NOT NULL AND text IS NOT NULL), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY created_at DESC NULLS LAST, doc_id DESC) AS rn FROM d)) SELECT unit, doc_id FROM n WHERE rn = 1")
def latest_document(t: Tables) -> DataFrame:
    d = t.documents.where("visual_unit_id is not null and text is not null")
    return tables.newest(d, ["visual_unit_id"], [F.desc_nulls_last("created_at"), F.desc("doc_id")]).select(F.col("visual_unit_id").alias("unit"), "doc_id")


@query("WITH d AS (SELECT source_content_id AS src, visual_unit_id AS unit, text FROM documents WHERE visual_unit_id IS NOT NULL) SELECT unit, count(DISTINCT sha256(text)) AS texts, count(*) AS n FROM d GROUP BY unit HAVING count(DISTINCT sha256(text)) > 1")
def disagreeing_units(t: Tables) -> DataFrame:
    d = t.documents.where("visual_unit_id is not null").groupBy(F.col("visual_unit_id").alias("unit")).agg(F.countDistinct(F.sha2("text", 256)).alias("texts"), F.count("*").alias("n"))
    return d.where("texts > 1")

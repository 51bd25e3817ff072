"""Identity views, text evidence, audits and pages of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.functions import text, vectors
from framelode.operators import catalogue, search, tables
from framelode.plans.base import FRAMES, LABELS, QUEUE, Tables, query
from framelode.plans.fixtures import rows, values
from framelode.plans.retrieval import _relevant

_IDENTITY = f"""WITH {values('unit_identity')}, i AS (SELECT unit, coalesce(canonical, unit) AS canonical, sha, coalesce(failed, false) AS failed FROM unit_identity),
    j AS (SELECT a.*, coalesce(a.sha <> '' AND a.sha = b.sha, false) AS same FROM i a LEFT JOIN i b ON b.unit = a.canonical AND b.unit = b.canonical),
    k AS (SELECT *, count(*) OVER (PARTITION BY canonical) AS members, bool_and(same OR unit = canonical) OVER (PARTITION BY canonical) AS exact FROM j),
    identity AS (SELECT unit, canonical, CASE WHEN failed THEN 'blocked_decoder' WHEN members = 1 THEN 'unique' WHEN unit = canonical THEN 'canonical' WHEN same THEN 'exact_duplicate' ELSE 'near_duplicate' END AS status,
      CASE WHEN members > 1 THEN 'vdg_' || substring(sha256(canonical), 1, 24) END AS group_id, CASE WHEN members > 1 THEN CASE WHEN exact THEN 'exact_duplicate' ELSE 'near_duplicate' END END AS duplicate_type, members FROM k),
    seen AS (SELECT *, status IN ('blocked_decoder', 'unique', 'canonical') AS eligible FROM identity)"""


def _identity(t: Tables) -> DataFrame:
    return catalogue.visual_identity(rows(t, "unit_identity"), "unit", "canonical", "sha", "failed")


@query(_IDENTITY + " SELECT unit, canonical, status, eligible, group_id, duplicate_type, members FROM seen")
def visual_identities(t: Tables) -> DataFrame:
    return _identity(t)


@query(_IDENTITY + " SELECT unit, status FROM seen WHERE eligible")
def canonical_units(t: Tables) -> DataFrame:
    return catalogue.canonical_view(_identity(t)).select("unit", "status")


@query(_IDENTITY + " SELECT canonical, unit, status FROM seen WHERE canonical IN (SELECT canonical FROM seen WHERE status = 'canonical')")
def expanded_duplicates(t: Tables) -> DataFrame:
    """Every unit behind the canonical ones."""
    identity = _identity(t)
    return catalogue.expand(identity, identity.where("status = 'canonical'")).select("canonical", "unit", "status")


@query(_IDENTITY + f", {values('used_units')} SELECT DISTINCT unit FROM used_units WHERE unit IS NOT NULL AND unit NOT IN (SELECT unit FROM seen WHERE eligible)")
def leaked_units(t: Tables) -> DataFrame:
    return catalogue.leaks(rows(t, "used_units"), "unit", catalogue.canonical_view(_identity(t)), "unit")


_TEXT = f"""WITH {values('text_labels', 'text_frames')}, s AS (SELECT *, label IN ('sign', 'menu', 'paper') AND label NOT IN ('paper') AS strong FROM text_labels),
    e AS (SELECT unit, bool_or(strong) AS has_strong_text, max(CASE WHEN strong THEN coalesce(confidence, 0) ELSE 0 END) AS max_confidence, max(CASE WHEN strong THEN coalesce(area, 0) ELSE 0 END) AS max_area, sum(CASE WHEN strong THEN coalesce(area, 0) ELSE 0 END) AS aggregate_area,
      coalesce(string_agg(DISTINCT CASE WHEN strong THEN label END, '|' ORDER BY CASE WHEN strong THEN label END), '') AS labels FROM s GROUP BY unit)"""


def _evidence(t: Tables) -> DataFrame:
    return catalogue.text_evidence(rows(t, "text_labels"), "unit", ("sign", "menu", "paper"), ("paper",))


@query(_TEXT + " SELECT unit, has_strong_text, max_confidence, max_area, round(aggregate_area, 9) AS aggregate_area, labels FROM e")
def text_bearing_labels(t: Tables) -> DataFrame:
    return _evidence(t).withColumn("aggregate_area", F.round("aggregate_area", 9))


@query(_TEXT + """, q AS (SELECT f.*, row_number() OVER (PARTITION BY src ORDER BY aggregate_area DESC, max_confidence DESC, t, unit) AS position FROM text_frames f JOIN e USING (unit) WHERE sound AND has_strong_text AND max_confidence >= 0.5 AND (max_area >= 0.03 OR aggregate_area >= 0.008))
    SELECT src, unit, position FROM q WHERE position <= 1""")
def video_text_frames(t: Tables) -> DataFrame:
    frames = rows(t, "text_frames").join(_evidence(t), "unit")
    return catalogue.video_text_frames(frames, "src", "t", "unit", 0.5, 0.03, 0.008, 1).select("src", "unit", "position")


@query(f"""WITH {values('tail_frames', 'tail_anchors')}, r AS (SELECT src, coalesce(t, -1) AS t, row_number() OVER (PARTITION BY src ORDER BY coalesce(t, -1), id) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM tail_frames),
    x AS (SELECT a.*, (SELECT max(n) FROM r WHERE r.src = a.src) AS n, NOT short AND tail IS NOT NULL AND coalesce((SELECT bool_and(r.t >= a.tail) FROM r WHERE r.src = a.src AND r.t >= 0 AND abs(r.r - a.anchor) <= 2), false) AS tail_only, (SELECT max(r.r) FROM r WHERE r.src = a.src AND r.t >= 0 AND r.t < a.tail) AS last FROM tail_anchors a),
    y AS (SELECT *, CASE WHEN tail_only THEN coalesce(last, -1) ELSE anchor END AS effective FROM x)
    SELECT src, anchor, tail_only, effective, CASE WHEN effective < 0 THEN -1 ELSE greatest(0, effective - 2) END AS from_rank, CASE WHEN effective < 0 THEN -1 ELSE least(n - 1, effective + 2) END AS to_rank FROM y""")
def tail_remaps(t: Tables) -> DataFrame:
    return catalogue.tail_remap(rows(t, "tail_frames"), "src", "t", "id", rows(t, "tail_anchors"), "tail", "short", 2)


_AUDIT = f"""WITH {values('ocr_results', 'ocr_queue')}, r AS (SELECT *, coalesce(ocr_text, '') AS txt FROM ocr_results), m AS (SELECT *, trim(regexp_replace(lower(txt), '\\s+', ' ', 'g')) AS n FROM r), d AS (SELECT n FROM m WHERE n <> '' GROUP BY n HAVING count(DISTINCT candidate_id) > 1),
    v AS (SELECT m.*, q.candidate_id IS NOT NULL AS queued, q.source_content_id AS qs, q.derived_id AS qd, m.n IN (SELECT n FROM d) AS dup, coalesce(json_valid(ocr_lines_json) AND json_type(CASE WHEN json_valid(ocr_lines_json) THEN ocr_lines_json END) = 'ARRAY', false) AS listed FROM m LEFT JOIN ocr_queue q USING (candidate_id)),
    w AS (SELECT *, concat_ws('|', CASE WHEN NOT queued THEN 'candidate_missing_from_frozen_ocr_queue' END, CASE WHEN queued AND source_content_id IS DISTINCT FROM qs THEN 'lineage_source_content_id' END, CASE WHEN queued AND derived_id IS DISTINCT FROM qd THEN 'lineage_derived_id' END,
      CASE WHEN coalesce(item_status NOT IN ('success', 'no_text'), true) THEN 'run_item_non_terminal_success' END, CASE WHEN coalesce(result_status NOT IN ('success', 'no_text'), true) THEN 'result_non_terminal_success' END, CASE WHEN result_status = 'success' AND trim(txt) = '' THEN 'empty_ocr_success' END,
      CASE WHEN sha256(txt) IS DISTINCT FROM ocr_text_sha256 THEN 'ocr_text_sha256_mismatch' END, CASE WHEN NOT listed THEN 'ocr_lines_json_invalid' END, CASE WHEN listed AND json_array_length(CASE WHEN listed THEN ocr_lines_json END) <> ocr_line_count THEN 'ocr_line_count_mismatch' END) AS hard_fail_reasons,
      concat_ws('|', CASE WHEN length(txt) < 4 THEN 'ocr_text_short' END, CASE WHEN mean_confidence IS NULL OR mean_confidence < 0.8 THEN 'ocr_mean_confidence_low' END, CASE WHEN dup THEN 'ocr_exact_normalized_text_duplicate' END) AS review_reasons FROM v),
    a AS (SELECT candidate_id, CASE WHEN hard_fail_reasons <> '' THEN 'FAIL' WHEN review_reasons <> '' THEN 'REVIEW' ELSE 'PASS' END AS quality_status, hard_fail_reasons, review_reasons FROM w)"""


def _audit(t: Tables) -> DataFrame:
    return catalogue.ocr_audit(rows(t, "ocr_results"), rows(t, "ocr_queue"), "candidate_id", ("source_content_id", "derived_id"))


@query(_AUDIT + " SELECT * FROM a")
def ocr_audits(t: Tables) -> DataFrame:
    return _audit(t)


@query(_AUDIT + """, g AS (SELECT (SELECT count(*) FROM ((SELECT candidate_id FROM a EXCEPT SELECT candidate_id FROM ocr_queue) UNION ALL (SELECT candidate_id FROM ocr_queue EXCEPT SELECT candidate_id FROM a))) = 0 AND count(candidate_id) = count(DISTINCT candidate_id) AS sound, count(*) FILTER (WHERE quality_status = 'FAIL') AS failed, count(*) FILTER (WHERE quality_status = 'REVIEW') AS review FROM a),
    s AS (SELECT *, CASE WHEN sound AND failed = 0 THEN 'PASS' ELSE 'FAIL' END AS technical_status, CASE WHEN review > 0 THEN 'REVIEW' ELSE 'PASS' END AS policy_status FROM g), z AS (SELECT *, CASE WHEN technical_status = 'FAIL' THEN 'DO_NOT_STAGE' WHEN review > 0 THEN 'READY_WITH_QUALITY_FLAGS' ELSE 'READY' END AS staging FROM s)
    SELECT CASE WHEN technical_status = 'PASS' AND policy_status = 'PASS' THEN 'PASS' WHEN staging = 'READY_WITH_QUALITY_FLAGS' THEN 'PASS_WITH_REVIEW' ELSE 'FAIL' END AS status, technical_status, policy_status, staging, failed, review FROM z""")
def joint_audit_status(t: Tables) -> DataFrame:
    audits, queue = _audit(t), rows(t, "ocr_queue").select("candidate_id")
    ids = audits.select("candidate_id")
    apart = ids.exceptAll(queue).unionAll(queue.exceptAll(ids)).count()
    return catalogue.joint_status(audits, F.lit(apart == 0), ["candidate_id"])


_PERSONS = f"WITH {values('person_members')}, m AS (SELECT * FROM person_members WHERE member_count > 1 AND (distinct_source_count >= 2 OR coalesce(human_review_status = 'confirmed', false)) AND (cluster_confidence = 'high' OR coalesce(human_review_status = 'confirmed', false)))"


@query(_PERSONS + " SELECT visual_unit_id, max(similarity_to_representative) AS similarity FROM m WHERE person_cluster_id = 'p1' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2 OFFSET 1")
def person_page(t: Tables) -> DataFrame:
    return catalogue.person_results(rows(t, "person_members"), "p1", 1, 2)


@query(_PERSONS + " SELECT DISTINCT person_cluster_id, visual_unit_id, member_count, distinct_source_count FROM m WHERE face_id = representative_face_id ORDER BY member_count DESC, person_cluster_id LIMIT 10")
def person_catalogue(t: Tables) -> DataFrame:
    return catalogue.person_catalogue(rows(t, "person_members"), 0, 10)


@query(_PERSONS + " SELECT DISTINCT visual_unit_id, person_cluster_id, member_count FROM m WHERE visual_unit_id IN ('u1', 'u2', 'u5', 'zz')")
def person_clusters_of_units(t: Tables) -> DataFrame:
    units = t.spark.createDataFrame([("u1",), ("u2",), ("u5",), ("zz",)], "visual_unit_id string")
    return catalogue.clusters_of_units(rows(t, "person_members"), units)


@query(f"WITH {values('layouts')}, c AS (SELECT *, coalesce((raw <> lag(raw) OVER w)::INT, 0) AS a, coalesce((content <> lag(content) OVER w)::INT, 0) AS b FROM layouts WINDOW w AS (PARTITION BY src ORDER BY n)) SELECT src, n, sum(a) OVER w::BIGINT AS raw_transitions, sum(b) OVER w::BIGINT AS content_transitions FROM c WINDOW w AS (PARTITION BY src ORDER BY n ROWS UNBOUNDED PRECEDING)".replace("OVER w::BIGINT", "OVER w"))
def layout_transitions(t: Tables) -> DataFrame:
    return catalogue.transitions(rows(t, "layouts"), "src", ["n"], ["raw", "content"]).select("src", "n", "raw_transitions", "content_transitions")


@query(f"""WITH {values('text_documents')}, g AS (SELECT text_vector_id, max(x * 0.6 + y * 0.8) AS score, bool_or(contains(lower(embedding_text), 'tent')) AS exact, count(*) AS documents, string_agg(document_id::VARCHAR, '|' ORDER BY document_id) FILTER (WHERE n <= 2) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY text_vector_id ORDER BY document_id) AS n FROM text_documents) GROUP BY 1)
    SELECT text_vector_id, round(score, 9) AS score, exact, documents, shown FROM g ORDER BY exact DESC, score DESC, text_vector_id LIMIT 3""")
def text_vector_page(t: Tables) -> DataFrame:
    """Groups of documents with one text, exact ones first."""
    docs = rows(t, "text_documents").withColumn("score", F.col("x") * 0.6 + F.col("y") * 0.8).withColumn("exact", text.has_exact_query(F.col("embedding_text"), "tent"))
    page = search.exact_first(search.text_groups(docs, "text_vector_id", "document_id", "score", "exact", 2), "text_vector_id", "score", "exact", 3)
    return page.select("text_vector_id", F.round("score", 9).alias("score"), "exact", "documents", F.array_join(F.transform("shown", lambda x: x.cast("string")), "|").alias("shown"))


_UNITS = f"WITH {FRAMES}, {QUEUE}, a AS (SELECT source_content_id AS src, min(lower(trim(media_type))) AS media, bool_or(coalesce(is_deleted_or_missing, 0) = 0) AS there, min(relative_path) AS path FROM source_assets WHERE source_content_id IS NOT NULL GROUP BY 1)"


def _assets(t: Tables) -> DataFrame:
    return t.source_assets.where("source_content_id is not null").groupBy(F.col("source_content_id").alias("src")).agg(F.min(F.lower(F.trim("media_type"))).alias("media"), F.bool_or(F.coalesce("is_deleted_or_missing", F.lit(0)) == 0).alias("there"), F.min("relative_path").alias("path"))


@query(_UNITS + """ SELECT DISTINCT f.id FROM f JOIN a USING (src) WHERE media = 'image' AND there AND id NOT IN (SELECT visual_unit_id FROM q WHERE kind = 'qwenvl_high_value' AND visual_unit_id IS NOT NULL) AND id NOT IN (SELECT visual_unit_id FROM documents WHERE visual_unit_id IS NOT NULL)""")
def all_image_scope(t: Tables) -> DataFrame:
    """Units of images that are neither queued nor documented yet."""
    units = t.frames.join(_assets(t).where("media = 'image' and there"), "src").select("id").distinct()
    queued = t.queue.where("kind = 'qwenvl_high_value' and visual_unit_id is not null").select(F.col("visual_unit_id").alias("id"))
    return tables.missing_only(units, [queued, t.documents.where("visual_unit_id is not null").select(F.col("visual_unit_id").alias("id"))], "id")


@query(_UNITS + """ SELECT media, count(DISTINCT src) AS sources, count(DISTINCT CASE WHEN id IS NOT NULL THEN src END) AS with_units, count(DISTINCT id) AS units, count(DISTINCT CASE WHEN id IN (SELECT visual_unit_id FROM yolo_visual_unit_label) THEN id END) AS labelled, count(DISTINCT CASE WHEN id IN (SELECT visual_unit_id FROM documents) THEN id END) AS documented FROM a LEFT JOIN f USING (src) GROUP BY media""")
def stage_counters(t: Tables) -> DataFrame:
    """What each stage has reached, by kind of media."""
    has = lambda df, name: df.where("visual_unit_id is not null").select(F.col("visual_unit_id").alias("id")).distinct().withColumn(name, F.col("id"))
    met = _assets(t).join(t.frames.select("src", "id"), "src", "left").join(has(t.yolo_visual_unit_label, "l"), "id", "left").join(has(t.documents, "d"), "id", "left")
    per = met.groupBy("media", "src", "id").agg(F.max("l").alias("l"), F.max("d").alias("d"))
    one = per.groupBy("media", "src").agg(F.count("id").alias("units"), F.count("l").alias("labelled"), F.count("d").alias("documented"))
    return one.groupBy("media").agg(F.count("*").alias("sources"), F.sum((F.col("units") > 0).cast("bigint")).alias("with_units"), F.sum("units").alias("units"), F.sum("labelled").alias("labelled"), F.sum("documented").alias("documented"))


@query(_UNITS + """, n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM f), p AS (SELECT src, count(*) AS keyframes FROM f GROUP BY src ORDER BY src LIMIT 30 OFFSET 10)
    SELECT src, keyframes, any_value(path) AS path, string_agg(id || '@' || t, ', ' ORDER BY r) AS frames FROM p JOIN n USING (src) LEFT JOIN a USING (src) WHERE r IN (0, n // 2, n - 1) GROUP BY src, keyframes""")
def timelapse_page(t: Tables) -> DataFrame:
    """A page of sequences with their first, middle and last frame; frames are read for the page's sequences alone."""
    from framelode.operators import windows

    page = t.frames.groupBy("src").agg(F.count("*").alias("keyframes")).orderBy("src").limit(40).offset(10)
    ranked = windows.ranks(t.frames.join(page, "src"), "src", [F.col("t"), F.col("id")])
    shown = ranked.where((F.col("rank") == 0) | (F.col("rank") == F.floor(F.col("total") / 2)) | (F.col("rank") == F.col("total") - 1))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "t"))), lambda x: F.concat(x["id"], F.lit("@"), x["t"].cast("string"))), ", ")
    return shown.groupBy("src", "keyframes").agg(listed.alias("frames")).join(_assets(t).select("src", "path"), "src", "left").select("src", "keyframes", "path", "frames")


@query()
def result_contract(t: Tables) -> DataFrame:
    """What a client gets of the first hits: their place, reasons and the fields these lie in."""
    top = _relevant(t).orderBy(*search.reranked("vec_id")).limit(20)
    return top.select("vec_id", "relevance", "rrf", "reasons", search.hit_fields(F.col("reasons")).alias("hit_field"))


@query(f"""WITH {FRAMES}, {LABELS}, g AS (SELECT unit, list(label) AS ls FROM l GROUP BY unit), j AS (SELECT f.id, f.src, f.t, coalesce(ls, []::VARCHAR[]) AS ls FROM f LEFT JOIN g ON unit = id), p AS (SELECT id, ls, lag(ls) OVER (PARTITION BY src ORDER BY t, id) AS before FROM j),
    c AS (SELECT id, len(ls) AS a, len(before) AS b, len(list_intersect(ls, before)) AS k FROM p WHERE before IS NOT NULL), u AS (SELECT *, a + b - k AS n FROM c)
    SELECT id, round(CASE WHEN a > 0 AND b > 0 THEN k / n END, 9) AS jaccard, round(CASE WHEN n > 0 THEN 1 - k / n ELSE 0 END, 9) AS distance, round(CASE WHEN n > 0 THEN k / n ELSE 1 END, 9) AS share FROM u""")
def label_set_changes(t: Tables) -> DataFrame:
    """How far the labels of each frame are those of the frame before it; the three definitions differ where sets are empty."""
    from framelode.operators import windows

    sets = t.labels.groupBy("unit").agg(F.collect_set("label").alias("ls"))
    j = t.frames.join(sets, F.col("id") == F.col("unit"), "left").withColumn("ls", F.coalesce("ls", F.array().cast("array<string>")))
    p = j.withColumn("before", F.lag("ls").over(windows.in_source("src", "t", "id"))).where("before is not null")
    a, b = F.col("ls"), F.col("before")
    return p.select("id", F.round(vectors.jaccard(a, b), 9).alias("jaccard"), F.round(vectors.jaccard_distance(a, b), 9).alias("distance"), F.round(vectors.jaccard_full(a, b), 9).alias("share"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 11), e AS (SELECT vec_id, embedding::DOUBLE[] AS v, q, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS h, list_transform(q, lambda x: abs(x)) AS g FROM embeddings, q),
    s AS (SELECT *, list_avg(v) AS mv, list_avg(q) AS mq, sqrt(list_inner_product(v, v)) AS n, list_sum(h) AS total FROM e)
    SELECT vec_id, round(v[1] / n, 5) AS first, round(list_sum(list_transform(list_zip(v, q), lambda x: (x[1] - mv) * (x[2] - mq))) / sqrt(list_sum(list_transform(v, lambda x: (x - mv) * (x - mv))) * list_sum(list_transform(q, lambda x: (x - mq) * (x - mq)))), 5) AS correlation,
      round(list_sum(list_transform(h, lambda x: CASE WHEN x > 0 THEN -(x / total) * log2(x / total) ELSE 0 END)) / log2(64), 5) AS entropy, round(list_sum(list_transform(list_zip(h, g), lambda x: abs(x[1] - x[2]))), 5) AS histogram_distance FROM s""")
def vector_shapes(t: Tables) -> DataFrame:
    """Unit form, correlation with one vector, and entropy and distance of the components' sizes read as histograms."""
    one = t.embeddings.where("vec_id = 11").select(F.col("embedding").cast("array<double>").alias("q")).limit(1)
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).join(F.broadcast(one))
    size = lambda c: F.transform(c, lambda x: F.abs(x))
    return e.select(
        "vec_id", F.round(F.get(vectors.normalize(F.col("v")), 0), 5).alias("first"), F.round(vectors.correlation(F.col("v"), F.col("q")), 5).alias("correlation"),
        F.round(vectors.entropy(size("v"), 64), 5).alias("entropy"), F.round(vectors.histogram_distance(size("v"), size("q")), 5).alias("histogram_distance"),
    )


@query(f"""WITH {values('pixel_boxes')}, p AS (SELECT *, greatest(x1, y1, x2, y2) > 1.5 AS px FROM pixel_boxes), n AS (SELECT box, least(greatest(CASE WHEN px THEN x1 / width ELSE x1 END, 0), 1) AS a, least(greatest(CASE WHEN px THEN y1 / height ELSE y1 END, 0), 1) AS b, least(greatest(CASE WHEN px THEN x2 / width ELSE x2 END, 0), 1) AS c, least(greatest(CASE WHEN px THEN y2 / height ELSE y2 END, 0), 1) AS d FROM p)
    SELECT box, round((c - a) * (d - b), 9) AS area, round(sqrt(((a + c) / 2 - 0.5) ** 2 + ((b + d) / 2 - 0.5) ** 2), 9) AS from_center, a <= 0.02 OR b <= 0.02 OR c >= 0.98 OR d >= 0.98 AS at_edge FROM n WHERE c > a AND d > b""")
def unit_boxes(t: Tables) -> DataFrame:
    b = rows(t, "pixel_boxes").withColumn("b", vectors.normal_box(F.array("x1", "y1", "x2", "y2"), F.col("width"), F.col("height"))).where("b is not null")
    return b.select("box", F.round(vectors.box_area(F.col("b")), 9).alias("area"), F.round(vectors.center_distance(F.col("b")), 9).alias("from_center"), vectors.touches_edge(F.col("b")).alias("at_edge"))


@query("""SELECT doc_id, substring(sha256('{"document":' || doc_id || ',"time":' || coalesce(time_position_ms::VARCHAR, 'null') || '}'), 1, 24) AS request FROM documents WHERE doc_id IS NOT NULL""")
def request_ids(t: Tables) -> DataFrame:
    return t.documents.where("doc_id is not null").select("doc_id", search.request_id({"time": F.col("time_position_ms"), "document": F.col("doc_id")}).alias("request"))


@query(_PERSONS.split(", m AS")[0] + """ SELECT DISTINCT person_cluster_id, CASE WHEN member_count = 1 THEN 'singleton' WHEN distinct_source_count >= 2 OR coalesce(human_review_status = 'confirmed', false) THEN 'high' ELSE 'review' END AS confidence FROM person_members""")
def cluster_confidences(t: Tables) -> DataFrame:
    from framelode.operators import identity

    confirmed = F.coalesce(F.col("human_review_status") == "confirmed", F.lit(False))
    return rows(t, "person_members").select("person_cluster_id", identity.cluster_confidence(F.col("member_count"), F.col("distinct_source_count"), confirmed).alias("confidence")).distinct()


@query("""WITH b AS (SELECT source_file_id, content_sha256, updated_at, lower(trim(dedup_role)) AS role FROM source_file_records WHERE source_file_id IS NOT NULL AND content_sha256 IS NOT NULL), o AS (SELECT source_file_id, min(content_sha256) AS sha FROM b WHERE role = 'canonical' GROUP BY 1), s AS (SELECT source_file_id, content_sha256 AS sha FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY updated_at DESC NULLS LAST, content_sha256 DESC) AS n FROM b) WHERE n = 1)
    SELECT * FROM o UNION ALL SELECT * FROM s WHERE source_file_id NOT IN (SELECT source_file_id FROM o) AND sha NOT IN (SELECT sha FROM o)""")
def supplemented_files(t: Tables) -> DataFrame:
    """The canonical files, and the newest rows of all others that bring content which the base lacks."""
    from framelode.operators import evidence

    both = t.source_file_records.where("source_file_id is not null and content_sha256 is not null").select("source_file_id", F.col("content_sha256").alias("sha"), "updated_at", F.lower(F.trim("dedup_role")).alias("role"))
    base = both.where("role = 'canonical'").groupBy("source_file_id").agg(F.min("sha").alias("sha"))
    return evidence.merge_supplement(base, both.drop("role"), "source_file_id", "sha", "updated_at").select("source_file_id", "sha")

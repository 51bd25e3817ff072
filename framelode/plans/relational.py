"""Scans, filters, joins, sets and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import hashing, text, times
from framelode.operators import search, selection, tables
from framelode.plans.base import FILES, FRAMES, HASHED, LABELS, QUEUE, Tables, query
from framelode.sources import readers

_EXT = "lower(regexp_extract(file_name, '[^./][^/]*\\.([^./]+)$', 1))"


@query(f"""WITH e AS (SELECT source_content_id, lower(file_name) AS name, size_bytes, {_EXT} AS ext FROM source_assets), k AS (SELECT *, CASE
    WHEN ext IN ('mov', 'mp4', 'm4v', 'avi', 'mkv', 'mts', 'm2ts', 'insv', 'mxf', 'braw', 'r3d', 'crm', 'ari') THEN 'video'
    WHEN ext IN ('jpg', 'jpeg', 'png', 'tif', 'tiff', 'heic', 'heif', 'hif', 'dng', 'arw', 'cr2', 'cr3', 'nef', 'nrw', 'rw2', 'raf', 'orf', 'webp', 'bmp', 'gif') THEN 'image'
    WHEN ext IN ('wav', 'mp3', 'm4a', 'aac', 'flac', 'aiff', 'aif', 'ogg', 'opus', 'wma') THEN 'audio'
    WHEN ext IN ('xmp', 'xaml', 'aae', 'dop', 'cos', 'pp3', 'on1', 'lmnr') THEN 'metadata_sidecar'
    WHEN ext IN ('txt', 'srt', 'vtt', 'ass', 'ssa', 'json', 'csv', 'tsv', 'xml', 'md', 'rtf', 'log', 'cue', 'edl', 'fcpxml', 'otio') THEN 'text'
    WHEN ext IN ('zip', 'rar', '7z', 'tar', 'gz', 'bz2', 'xz', 'dmg', 'iso') THEN 'archive' ELSE 'other' END AS kind FROM e),
    r AS (SELECT *, CASE WHEN name IN ('.ds_store', 'thumbs.db', 'desktop.ini') THEN 'system_sidecar_ignored_name' WHEN size_bytes IS NULL THEN 'stat_failed' WHEN size_bytes = 0 THEN 'zero_byte_file'
      WHEN kind = 'metadata_sidecar' THEN 'linked_metadata_sidecar_not_processing_queue' WHEN kind = 'archive' THEN 'archive_or_disk_image_not_processed' WHEN kind <> 'other' THEN '' WHEN ext = '' THEN 'missing_extension' ELSE 'unsupported_extension:.' || ext END AS reason FROM k),
    s AS (SELECT *, CASE WHEN reason = '' THEN 'supported' WHEN reason = 'stat_failed' THEN 'blocked' WHEN reason LIKE 'linked%' THEN 'metadata_sidecar' ELSE 'unsupported' END AS status FROM r)
    SELECT source_content_id, CASE WHEN status IN ('supported', 'metadata_sidecar') THEN kind ELSE 'unsupported' END AS kind, status, reason FROM s""")
def media_kinds(t: Tables) -> DataFrame:
    kind, status, reason = readers.media_kind(F.col("file_name"), F.col("size_bytes"), F.col("size_bytes").isNull())
    return t.source_assets.select("source_content_id", kind.alias("kind"), status.alias("status"), reason.alias("reason"))


_SPANS = f"WITH {FRAMES}, d AS (SELECT src, max(t) AS duration, count(*) AS produced FROM f GROUP BY src)"


def _spans(t: Tables) -> DataFrame:
    return t.frames.groupBy("src").agg(F.max("t").alias("duration"), F.count("*").alias("produced"))


@query(_SPANS + """ SELECT src, unnest(CASE WHEN duration > 2000 THEN generate_series(2000, duration, 3000) WHEN duration < 500 THEN []::BIGINT[]
    ELSE [CASE WHEN duration > 1500 THEN 1500 ELSE greatest(300, duration // 2) END] END) AS t FROM d""")
def frame_times(t: Tables) -> DataFrame:
    return _spans(t).select("src", F.explode(selection.frame_times(F.col("duration"))).alias("t"))


@query(_SPANS + """, e AS (SELECT *, CASE WHEN duration > 2000 THEN (duration - 2000) // 3000 + 1 WHEN duration >= 500 THEN 1 ELSE 0 END AS expected FROM d)
    SELECT src, expected, produced, CASE WHEN expected = 0 AND produced = 0 THEN 'success_nothing_expected' WHEN produced = 0 THEN 'retry_no_frames' WHEN produced >= expected THEN 'success_complete'
    WHEN produced >= expected - 1 THEN 'success_one_missing' WHEN produced >= 0.7 * expected THEN 'success_lower_than_estimate' ELSE 'retry_too_few' END AS status FROM e""")
def extraction_status(t: Tables) -> DataFrame:
    d = _spans(t).withColumn("expected", selection.expected_frames(F.col("duration")))
    return d.select("src", "expected", "produced", selection.extraction_status(F.col("expected"), F.col("produced")).alias("status"))


_OLD_NEW = """WITH r AS (SELECT source_file_id AS id, size_bytes, stem_key, lower(trim(dedup_role)) AS role, coalesce(epoch_us(updated_at), -1) AS seen FROM source_file_records WHERE source_file_id IS NOT NULL),
  x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen, size_bytes NULLS LAST, role NULLS LAST, stem_key NULLS LAST) AS a, row_number() OVER (PARTITION BY id ORDER BY seen DESC, size_bytes NULLS LAST, role NULLS LAST, stem_key NULLS LAST) AS b, count(*) OVER (PARTITION BY id) AS c FROM r),
  o AS (SELECT id, size_bytes, stem_key, role FROM x WHERE a = 1 AND role = 'canonical'), n AS (SELECT id, size_bytes, stem_key, role FROM x WHERE b = 1 AND c > 1)"""


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The canonical files as first seen, and the files seen again as last seen."""
    r = t.source_file_records.where("source_file_id is not null").select(F.col("source_file_id").alias("id"), "size_bytes", "stem_key", F.lower(F.trim("dedup_role")).alias("role"), F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-1)).alias("at"))
    rest = [F.asc_nulls_last("size_bytes"), F.asc_nulls_last("role"), F.asc_nulls_last("stem_key")]
    old = tables.newest(r, ["id"], [F.asc("at"), *rest]).where("role = 'canonical'").drop("at")
    again = r.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    return old, tables.newest(r, ["id"], [F.desc("at"), *rest]).join(again, "id", "left_semi").drop("at")


@query(_OLD_NEW + " SELECT coalesce(n.id, o.id) AS id, coalesce(n.size_bytes, o.size_bytes) AS size_bytes, coalesce(n.stem_key, o.stem_key) AS stem_key, coalesce(n.role, o.role) AS role FROM o FULL JOIN n ON o.id = n.id")
def upsert_files(t: Tables) -> DataFrame:
    return tables.upsert(*_versions(t), "id")


@query(_OLD_NEW + " SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_ignore_files(t: Tables) -> DataFrame:
    return tables.insert_ignore(*_versions(t), "id")


@query(_OLD_NEW + " SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def replace_files(t: Tables) -> DataFrame:
    return tables.replace(*_versions(t), "id")


@query(_OLD_NEW + """ SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'missing'
    WHEN o.size_bytes IS NOT DISTINCT FROM n.size_bytes AND o.stem_key IS NOT DISTINCT FROM n.stem_key AND o.role IS NOT DISTINCT FROM n.role THEN 'unchanged' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.id = n.id""")
def change_classes(t: Tables) -> DataFrame:
    return tables.classify_changes(*_versions(t), "id")


@query(_OLD_NEW + " SELECT *, 'added' AS side FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT *, 'removed' AS side FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)")
def version_diff(t: Tables) -> DataFrame:
    return tables.added_removed(*_versions(t))


@query("""SELECT doc_id, document_kind FROM documents WHERE document_kind = 'direct_only' AND coalesce(time_position_ms, -1) BETWEEN 0 AND 600000 AND starts_with(lower(source), 'qwenvl')""")
def filtered_documents(t: Tables) -> DataFrame:
    keep = tables.filters(F.col("document_kind") == "direct_only", tables.time_between(F.col("time_position_ms"), 0, 600_000), tables.prefix(F.col("source"), "QWENVL"), None)
    return t.documents.where(keep).select("doc_id", "document_kind")


@query("SELECT source_content_id, coalesce(online_status, 1) AS online, coalesce(is_deleted_or_missing, 0) AS deleted FROM source_assets")
def asset_defaults(t: Tables) -> DataFrame:
    return t.source_assets.select("source_content_id", F.coalesce("online_status", F.lit(1)).alias("online"), F.coalesce("is_deleted_or_missing", F.lit(0)).alias("deleted"))


@query(f"WITH {LABELS} SELECT DISTINCT unit FROM l WHERE label IN ('person', 'car', 'dog')")
def units_with_listed_labels(t: Tables) -> DataFrame:
    return t.labels.where(F.col("label").isin("person", "car", "dog")).select("unit").distinct()


@query(f"WITH {FRAMES}, {LABELS} SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE unit = id)")
def frames_without_labels(t: Tables) -> DataFrame:
    return t.frames.join(t.labels.select(F.col("unit").alias("id")), "id", "left_anti").select("id")


@query(f"WITH {FRAMES} SELECT id FROM f WHERE EXISTS (SELECT 1 FROM documents WHERE visual_unit_id = id)")
def frames_with_documents(t: Tables) -> DataFrame:
    return t.frames.join(t.documents.select(F.col("visual_unit_id").alias("id")), "id", "left_semi").select("id")


@query(f"WITH {QUEUE} SELECT candidate_id, CASE WHEN canonical_time_ms >= 0 THEN canonical_time_ms ELSE time_position_ms END AS t FROM q")
def effective_times(t: Tables) -> DataFrame:
    return t.queue.select("candidate_id", times.effective_time(F.col("canonical_time_ms"), F.col("time_position_ms")).alias("t"))


@query(f"""WITH {FRAMES}, b AS (SELECT src, min(t) AS a, max(t) AS z FROM f GROUP BY src), c AS (SELECT f.*, CASE WHEN z > a THEN CAST(trunc(greatest(a, z - least(greatest(0.05::DOUBLE * (z - a), 3000), 12000))) AS BIGINT) END AS tail FROM f JOIN b USING (src))
    SELECT id, array_to_string(list_filter([CASE WHEN black = 1 THEN 'near_black' END, CASE WHEN luma = 0 THEN 'signature_failed' END, CASE WHEN t >= tail THEN 'in_tail' END], lambda x: x IS NOT NULL), '|') AS reasons FROM c""")
def frame_rejections(t: Tables) -> DataFrame:
    bounds = t.frames.groupBy("src").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    rows = t.frames.join(bounds, "src").withColumn("tail", selection.tail_start(F.col("a"), F.col("z")))
    no = F.lit(False)
    return rows.select("id", selection.hard_rejections(F.col("black") == 1, F.when(F.col("luma") == 0, "FAIL").otherwise("PASS"), F.col("tail"), F.col("t"), no, no).alias("reasons"))


@query("SELECT source_content_id FROM source_assets WHERE regexp_matches(lower(relative_path), 'screen recording|screenrecording|screen_record|rpreplay|录屏|屏幕录制')")
def screen_recordings(t: Tables) -> DataFrame:
    return t.source_assets.where(F.lower("relative_path").rlike("screen recording|screenrecording|screen_record|rpreplay|录屏|屏幕录制")).select("source_content_id")


@query("""SELECT doc_id, position, CASE WHEN (SELECT count(*) FROM documents) > 60 THEN 60 END AS next_offset
    FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents) WHERE position BETWEEN 41 AND 60""")
def document_page(t: Tables) -> DataFrame:
    return tables.page(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 40, 20).select("doc_id", "position", "next_offset")


@query("SELECT doc_id, substring(text, 1, 240) AS preview FROM documents WHERE text IS NOT NULL")
def document_previews(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.substring("text", 1, 240).alias("preview"))


@query(f"WITH {FRAMES} SELECT id, relative_path, media_type FROM f JOIN source_assets a ON a.source_content_id = f.src")
def frames_with_sources(t: Tables) -> DataFrame:
    return t.frames.join(t.source_assets, F.col("src") == F.col("source_content_id")).select("id", "relative_path", "media_type")


@query(f"WITH {LABELS} SELECT unit, l.label, min(label_zh) AS label_zh FROM l LEFT JOIN visual_label_terms v ON lower(trim(v.label)) = l.label GROUP BY unit, l.label")
def labels_with_terms(t: Tables) -> DataFrame:
    terms = t.visual_label_terms.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.min("label_zh").alias("label_zh"))  # 313 terms, a fixed registry
    return t.labels.join(F.broadcast(terms), "label", "left").select("unit", "label", "label_zh")


@query(f"""WITH {QUEUE} SELECT candidate_id, kind, run_id, created FROM (SELECT candidate_id, kind, run_id, epoch(TRY_CAST(created_at AS TIMESTAMPTZ))::BIGINT AS created,
    row_number() OVER (PARTITION BY candidate_id, kind ORDER BY TRY_CAST(created_at AS TIMESTAMPTZ) DESC NULLS LAST, run_id NULLS LAST) AS rn FROM q) WHERE rn = 1""")
def latest_attempts(t: Tables) -> DataFrame:
    q = t.queue.withColumn("at", F.col("created_at").try_cast("timestamp"))
    return tables.newest(q, ["candidate_id", "kind"], [F.desc_nulls_last("at"), F.asc_nulls_last("run_id")]).select("candidate_id", "kind", "run_id", F.unix_seconds("at").alias("created"))


@query("""SELECT o_orderkey, o_orderstatus, items, open_items FROM orders JOIN (SELECT l_orderkey, count(*) AS items, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open_items FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def runs_with_items(t: Tables) -> DataFrame:
    items = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("items"), F.sum((F.col("l_linestatus") == "O").cast("int")).alias("open_items"))
    return t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "items", "open_items")


@query("""WITH d AS (SELECT *, lower(trim(source)) AS s FROM documents WHERE visual_unit_id IS NOT NULL),
    c AS (SELECT * FROM d WHERE doc_id IN (SELECT max(doc_id) FROM d WHERE s = 'qwenvl_caption' GROUP BY visual_unit_id)), o AS (SELECT * FROM d WHERE doc_id IN (SELECT max(doc_id) FROM d WHERE s = 'ocr_text' GROUP BY visual_unit_id))
    SELECT c.visual_unit_id, c.doc_id AS caption_doc, o.doc_id AS ocr_doc, concat_ws('|', CASE WHEN c.source_content_id IS DISTINCT FROM o.source_content_id THEN 'source' END, CASE WHEN c.time_position_ms IS DISTINCT FROM o.time_position_ms THEN 'time' END) AS mismatches
    FROM c JOIN o USING (visual_unit_id)""")
def caption_and_ocr(t: Tables) -> DataFrame:
    d = t.documents.where("visual_unit_id is not null").withColumn("s", F.lower(F.trim("source")))
    last = lambda s, p: d.where(F.col("s") == s).groupBy("visual_unit_id").agg(F.max(F.struct("doc_id", "source_content_id", "time_position_ms")).alias(p))
    both = last("qwenvl_caption", "c").join(last("ocr_text", "o"), "visual_unit_id")
    differs = text.reasons([(~F.col("c.source_content_id").eqNullSafe(F.col("o.source_content_id")), "source"), (~F.col("c.time_position_ms").eqNullSafe(F.col("o.time_position_ms")), "time")])
    return both.select("visual_unit_id", F.col("c.doc_id").alias("caption_doc"), F.col("o.doc_id").alias("ocr_doc"), differs.alias("mismatches"))


@query("""WITH e AS (SELECT *, event_type FROM events) SELECT user_id, event_id, count(*) AS near FROM (SELECT a.user_id, a.event_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) <= 3600000) GROUP BY ALL""")
def events_within_an_hour(t: Tables) -> DataFrame:
    """Self-join within a time window: on the hour, so each row meets only its own and the neighbouring hours."""
    e = t.events.select("user_id", "event_id", F.expr("unix_millis(cast(ts as timestamp))").alias("ms")).withColumn("h", F.floor(F.col("ms") / 3_600_000))
    other = e.select(F.col("user_id"), F.col("event_id").alias("o"), F.col("ms").alias("oms"), F.explode(F.array(F.col("h") - 1, F.col("h"), F.col("h") + 1)).alias("h"))
    met = e.join(other, ["user_id", "h"]).where((F.col("event_id") != F.col("o")) & (F.abs(F.col("ms") - F.col("oms")) <= 3_600_000))
    return met.groupBy("user_id", "event_id").agg(F.count("*").alias("near"))


@query(f"""WITH {FRAMES}, d AS (SELECT DISTINCT doc_id, source_content_id AS s, time_position_ms AS u FROM documents WHERE time_position_ms >= 0)
    SELECT id, near, position, distance FROM (SELECT id, doc_id AS near, abs(t - u) AS distance, row_number() OVER (PARTITION BY id ORDER BY abs(t - u), u, doc_id) AS position FROM f JOIN d ON src = s) WHERE position <= 5""")
def nearest_documents(t: Tables) -> DataFrame:
    docs = t.documents.where("time_position_ms >= 0").select(F.col("source_content_id").alias("src"), F.col("doc_id").alias("id"), F.col("time_position_ms").alias("t"))
    return search.nearest_rows(t.frames, docs.where("src is not null").distinct(), "src", "t", "id", 5)


@query(f"""WITH {FRAMES}, a AS (SELECT src, min(t) AS s, max(t) AS z FROM f GROUP BY src), n AS (SELECT src, s, unnest(generate_series(0, (z - s) // 60000)) AS anchor FROM a)
    SELECT src, anchor, id, t FROM (SELECT n.src, anchor, id, t, row_number() OVER (PARTITION BY n.src, anchor ORDER BY abs(t - s - anchor * 60000), t, id) AS rn FROM n JOIN f ON f.src = n.src) WHERE rn = 1""")
def frames_nearest_to_anchors(t: Tables) -> DataFrame:
    return selection.nearest_to_anchors(t.frames, "src", "t", "id", 60_000)


_SIDE = f"WITH {FILES}, p AS (SELECT source_file_id AS id, lower(folder_path) AS dir, stem_key AS stem, lower(trim(extension)) AS ext, lower(trim(media_kind)) AS kind FROM s WHERE stem_key IS NOT NULL)"


def _parts(t: Tables) -> DataFrame:
    return t.files.where("stem_key is not null").select(F.col("source_file_id").alias("id"), F.lower("folder_path").alias("dir"), F.col("stem_key").alias("stem"), F.lower(F.trim("extension")).alias("ext"), F.lower(F.trim("media_kind")).alias("kind"))


@query(_SIDE + " SELECT a.id AS media, b.id AS companion FROM p a JOIN p b ON a.dir = b.dir AND a.stem = b.stem AND a.ext <> b.ext AND a.id <> b.id")
def same_stem_companions(t: Tables) -> DataFrame:
    a, b = _parts(t).alias("a"), _parts(t).alias("b")
    return a.join(b, (F.col("a.dir") == F.col("b.dir")) & (F.col("a.stem") == F.col("b.stem"))).where("a.ext <> b.ext and a.id <> b.id").select(F.col("a.id").alias("media"), F.col("b.id").alias("companion"))


@query(_SIDE + """ SELECT a.id AS shorter, b.id AS longer FROM p a JOIN p b ON a.dir = b.dir AND length(a.stem) >= 6 AND length(b.stem) > length(a.stem) AND starts_with(b.stem, a.stem)""")
def stem_prefix_pairs(t: Tables) -> DataFrame:
    """One stem begins with the other: an equi-join on folder and the first six signs, so a folder isn't crossed with itself."""
    p = _parts(t).where(F.length("stem") >= 6).withColumn("head", F.substring("stem", 1, 6))
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, (F.col("a.dir") == F.col("b.dir")) & (F.col("a.head") == F.col("b.head"))).where((F.length("b.stem") > F.length("a.stem")) & F.startswith("b.stem", "a.stem")).select(F.col("a.id").alias("shorter"), F.col("b.id").alias("longer"))


@query(f"""WITH {FILES} SELECT source_content_id, source_file_id FROM (SELECT source_content_id, source_file_id, row_number() OVER (PARTITION BY source_content_id ORDER BY CASE WHEN lower(trim(dedup_role)) = 'canonical' THEN 0 ELSE 1 END, source_file_id) AS rn FROM s WHERE source_content_id IS NOT NULL) WHERE rn = 1""")
def best_file_per_asset(t: Tables) -> DataFrame:
    rank = F.struct(F.when(F.lower(F.trim("dedup_role")) == "canonical", 0).otherwise(1), F.col("source_file_id"))
    return t.files.where("source_content_id is not null").groupBy("source_content_id").agg(F.min_by("source_file_id", rank).alias("source_file_id"))


@query(f"WITH {FILES} SELECT source_file_id FROM s WHERE scan_run_id = (SELECT max(scan_run_id) FROM s)")
def files_of_latest_scan(t: Tables) -> DataFrame:
    return t.files.join(F.broadcast(t.files.agg(F.max("scan_run_id").alias("scan_run_id"))), "scan_run_id").select("source_file_id")


@query(f"""WITH {QUEUE}, v AS (SELECT visual_unit_id, max(luma_mean) AS luma FROM visual_units GROUP BY visual_unit_id)
    SELECT candidate_id, coalesce(q.luma_mean, a.luma, b.luma) AS luma FROM q LEFT JOIN v a ON a.visual_unit_id = q.visual_unit_id LEFT JOIN v b ON b.visual_unit_id = q.canonical_visual_unit_id""")
def luma_with_fallback(t: Tables) -> DataFrame:
    v = t.visual_units.groupBy("visual_unit_id").agg(F.max("luma_mean").alias("luma"))
    a, b = v.select("visual_unit_id", F.col("luma").alias("l1")), v.select(F.col("visual_unit_id").alias("canonical_visual_unit_id"), F.col("luma").alias("l2"))
    return t.queue.join(a, "visual_unit_id", "left").join(b, "canonical_visual_unit_id", "left").select("candidate_id", F.coalesce("luma_mean", "l1", "l2").alias("luma"))


@query(f"""WITH {QUEUE}, {FRAMES}, {FILES}, w AS (SELECT source_content_id, min(source_file_id) AS file FROM s WHERE lower(trim(dedup_role)) = 'canonical' GROUP BY source_content_id)
    SELECT candidate_id, coalesce(q.source_relative_path, a.relative_path) AS path, coalesce(f.t, q.time_position_ms) AS t, file, CASE WHEN a.source_content_id IS NULL THEN 'unknown_source' WHEN w.file IS NULL THEN 'no_canonical_file' ELSE 'ok' END AS status
    FROM q LEFT JOIN f ON f.id = q.visual_unit_id LEFT JOIN source_assets a ON a.source_content_id = q.source_content_id LEFT JOIN w ON w.source_content_id = q.source_content_id""")
def candidate_projection(t: Tables) -> DataFrame:
    file = t.files.where(F.lower(F.trim("dedup_role")) == "canonical").groupBy("source_content_id").agg(F.min("source_file_id").alias("file"))
    assets = t.source_assets.select("source_content_id", F.col("relative_path").alias("own_path"), F.lit(1).alias("known"))
    q = t.queue.join(t.frames.select(F.col("id").alias("visual_unit_id"), "t"), "visual_unit_id", "left").join(assets, "source_content_id", "left").join(file, "source_content_id", "left")
    status = F.when(F.col("known").isNull(), "unknown_source").when(F.col("file").isNull(), "no_canonical_file").otherwise("ok")
    return q.select("candidate_id", F.coalesce("source_relative_path", "own_path").alias("path"), F.coalesce("t", "time_position_ms").alias("t"), "file", status.alias("status"))


@query(f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS rank, count(*) OVER (PARTITION BY src) AS total FROM f), i AS (SELECT src, total // 2 AS m FROM r GROUP BY src, total)
    SELECT DISTINCT r.id AS pool_id FROM r JOIN i USING (src) WHERE rank BETWEEN m - 3 AND m + 3 UNION SELECT canonical_visual_unit_id FROM stop03_2_candidate_queue_items WHERE visual_unit_id IN (SELECT r.id FROM r JOIN i USING (src) WHERE rank BETWEEN m - 3 AND m + 3) AND canonical_visual_unit_id IS NOT NULL""")
def anchor_pool(t: Tables) -> DataFrame:
    """Frames of the middle interval, and the canonical frames that those name."""
    from framelode.operators import windows

    near = windows.ranks(t.frames, "src", [F.col("t"), F.col("id")]).where(F.abs(F.col("rank") - F.floor(F.col("total") / 2)) <= 3).select("id")
    named = t.stop03_2_candidate_queue_items.join(near.withColumnRenamed("id", "visual_unit_id"), "visual_unit_id", "left_semi").where("canonical_visual_unit_id is not null").select("canonical_visual_unit_id")
    return near.unionAll(named).distinct().withColumnRenamed("id", "pool_id")


@query("SELECT visual_unit_id FROM yolo_visual_unit_label WHERE visual_unit_id IS NOT NULL EXCEPT SELECT visual_unit_id FROM visual_units")
def labelled_but_unknown_units(t: Tables) -> DataFrame:
    return t.yolo_visual_unit_label.where("visual_unit_id is not null").select("visual_unit_id").subtract(t.visual_units.select("visual_unit_id"))


@query("SELECT visual_unit_id FROM documents WHERE visual_unit_id IS NOT NULL INTERSECT SELECT visual_unit_id FROM stop03_2_candidate_queue_items")
def documented_candidates(t: Tables) -> DataFrame:
    return t.documents.where("visual_unit_id is not null").select("visual_unit_id").intersect(t.stop03_2_candidate_queue_items.select("visual_unit_id"))


@query(f"""WITH {QUEUE}, x AS (SELECT candidate_id, visual_unit_id, kind FROM q WHERE candidate_id IS NOT NULL) , b AS (SELECT candidate_id, min(visual_unit_id) AS unit FROM x WHERE kind = 'qwenvl_high_value' GROUP BY candidate_id), o AS (SELECT candidate_id, min(visual_unit_id) AS unit FROM x WHERE kind = 'ocr_trigger' GROUP BY candidate_id)
    SELECT * FROM b UNION ALL SELECT * FROM o WHERE candidate_id NOT IN (SELECT candidate_id FROM b) AND unit NOT IN (SELECT unit FROM b WHERE unit IS NOT NULL)""")
def merged_queues(t: Tables) -> DataFrame:
    """The second queue adds candidates of units that the first doesn't have."""
    one = lambda k: t.queue.where((F.col("kind") == k) & F.col("candidate_id").isNotNull()).groupBy("candidate_id").agg(F.min("visual_unit_id").alias("unit"))
    b, o = one("qwenvl_high_value"), one("ocr_trigger")
    return b.unionAll(tables.missing_only(tables.missing_only(o, [b], "candidate_id"), [b], "unit").where("unit is not null").select("candidate_id", "unit"))


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY orders.o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_success_run(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"))


@query("SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS size FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) UNION ALL SELECT * FROM (SELECT 'part', p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20) ORDER BY size DESC, kind, id LIMIT 20")
def largest_of_all(t: Tables) -> DataFrame:
    top = lambda df, kind, k, v: df.orderBy(F.desc(v), k).limit(20).select(F.lit(kind).alias("kind"), F.col(k).alias("id"), F.col(v).alias("size"))
    return top(t.orders, "order", "o_orderkey", "o_totalprice").unionAll(top(t.part, "part", "p_partkey", "p_retailprice")).orderBy(F.desc("size"), "kind", "id").limit(20)


@query(f"""WITH {FILES}, {HASHED} SELECT content_sha256, bytes, files FROM (SELECT d AS content_sha256, sum(size_bytes)::BIGINT AS bytes, count(*) AS files FROM hashed WHERE d IS NOT NULL GROUP BY d) WHERE files > 1 ORDER BY bytes DESC NULLS LAST, content_sha256 LIMIT 25 OFFSET 5""")
def duplicate_groups_page(t: Tables) -> DataFrame:
    g = t.files.withColumn("d", hashing.valid_hash(F.col("content_sha256"))).where("d is not null").groupBy(F.col("d").alias("content_sha256")).agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("files")).where("files > 1")
    return g.orderBy(F.desc_nulls_last("bytes"), "content_sha256").offset(5).limit(25)


@query(f"WITH {QUEUE} SELECT source_content_id, candidate_id, position FROM (SELECT source_content_id, candidate_id, row_number() OVER (PARTITION BY source_content_id ORDER BY candidate_score DESC NULLS LAST, candidate_id, created_at) AS position FROM q WHERE source_content_id IS NOT NULL) WHERE position <= 5")
def five_per_source(t: Tables) -> DataFrame:
    w = Window.partitionBy("source_content_id").orderBy(F.desc_nulls_last("candidate_score"), "candidate_id", "created_at")
    return t.queue.where("source_content_id is not null").withColumn("position", F.row_number().over(w)).where("position <= 5").select("source_content_id", "candidate_id", "position")


@query(f"""WITH {FRAMES}, r AS (SELECT src, id, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM f), b AS (SELECT *, least(ceil(n / 40)::BIGINT, n) AS b FROM r)
    SELECT src, id FROM b WHERE (b = 1 AND r = round_even((n - 1) / 2, 0)::BIGINT) OR (b > 1 AND list_contains(list_transform(generate_series(0, greatest(b - 1, 1)), lambda i: round_even((n - 1) * i / (b - 1), 0)::BIGINT), r))""")
def evenly_spaced_frames(t: Tables) -> DataFrame:
    counted = t.frames.withColumn("_c", F.ceil(F.count("*").over(Window.partitionBy("src")) / 40))
    return tables.evenly_spaced(counted, ["src"], [F.col("t"), F.col("id")], F.col("_c")).select("src", "id")

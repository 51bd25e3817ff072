"""The queries of the training-data problems, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.llm import cleaning, components, cooccur, mixing, runs, sentences, survivors, tokenize, top_n, varied
from framelode.runtime import Scratch, table

QUEUE = "stop03_2_candidate_queue_items"
LABELS = "yolo_visual_unit_label"
#: Part of the records that p5 selects.
VARIED_SHARE = 0.01


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, QUEUE)
    rows = cleaning.latest_candidates(queue, ["source_content_id", "queue_type", "candidate_id", "candidate_score"]).where("source_content_id is not null and queue_type is not null")
    best = top_n.top_n_per_group(rows, ["source_content_id", "queue_type"], "candidate_score", "candidate_id", 3, cuts_from=queue.select("candidate_score"))
    return best.select("source_content_id", "queue_type", "candidate_id")


def p2_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Every pair seen together, with lift and pointwise mutual information to six places."""
    rows = table(spark, d, LABELS).select("visual_unit_id", cooccur.normal_label_column(F.col("label")).alias("label"))
    pairs = cooccur.cooccurrence(rows, "visual_unit_id", "label", min_count=1)
    return pairs.select(F.col("item_a").alias("label_a"), F.col("item_b").alias("label_b"), "c", "a", "b", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, LABELS).select("visual_unit_id", cooccur.normal_label_column(F.col("label")).alias("label"))
    pairs = cooccur.cooccurrence(rows, "visual_unit_id", "label", min_count=5, min_share=1 / 2000)
    far = pairs.where((F.col("c") >= 5) & (2000 * F.col("c") >= F.col("n")) & (F.col("c") * F.col("n") >= 4 * F.col("a") * F.col("b")))
    return far.select(F.col("item_a").alias("label_a"), F.col("item_b").alias("label_b"))


def _survivors(spark: SparkSession, d: str, recent: tuple[str, ...] = ()) -> DataFrame:
    scratch = Scratch(spark, "files")
    return survivors.survivors(survivors.content_groups(table(spark, d, "source_file_records"), scratch), survivors.content_policy(recent), scratch)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Survivors, and the most recent tags: no field is filled by layer here."""
    best = _survivors(spark, d, survivors.HASH_FIELDS)
    return best.select(F.col("content_hash").alias("content_sha256"), F.col("survivor").alias("survivor_id"), F.coalesce("finder_tags_json_from", F.lit("")).alias("tags_from_id"))


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each content group, fields filled from successive dominance layers."""
    return _survivors(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    names = ["visual_unit_id", "canonical_visual_unit_id", "duplicate_group_id", "duplicate_reverse_visual_unit_ids"]
    return components.unit_groups(cleaning.latest_candidates(table(spark, d, QUEUE), names))


def _features(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.latest_candidates(table(spark, d, QUEUE), ["candidate_id", "source_content_id", "labels", "generic_label_categories"])
    return rows.select("candidate_id", "source_content_id", varied.queue_features("labels", "generic_label_categories", "source_content_id").alias("features"))


def p5_varied(spark: SparkSession, d: str) -> DataFrame:
    """One record in a hundred, covering labels, categories and sources."""
    scratch = Scratch(spark, "varied")
    rows = scratch.put(_features(spark, d), "features")
    size = -(-rows.count() * round(VARIED_SHARE * 100) // 100)
    return varied.varied_subset(rows, "candidate_id", "features", size, near="source_content_id", scratch=scratch).select("candidate_id", "round", F.round("gain", 6).alias("gain"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    names = ["source_content_id", "queue_type", "candidate_id", "time_position_ms", "group_start_ms", "group_end_ms"]
    rows = cleaning.latest_candidates(table(spark, d, QUEUE), names)
    return runs.runs(rows, ["source_content_id", "queue_type"], "time_position_ms", "candidate_id", "group_start_ms", "group_end_ms", 250)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("frames > 1").select("source_content_id", "queue_type", F.col("first_id").alias("first_candidate_id"), F.col("last_id").alias("last_candidate_id"))


def p6_events(spark: SparkSession, d: str) -> DataFrame:
    """Every run, of one frame or more, with its frame count and duration."""
    return _runs(spark, d).select("source_content_id", "queue_type", F.col("first_id").alias("first_candidate_id"), F.col("last_id").alias("last_candidate_id"), "frames", "duration_ms")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The texts decoded from their own ids; null comes back as an empty text."""
    return tokenize.decode(tokenize.encode(table(spark, d, "documents"), "doc_id", "text"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]
    return report.select("mix_name", "source", "max_repeats", *[F.round(c, 9).alias(c) for c in ("wanted_share", "target_share", "actual_share")], F.round("budget", 3).alias("budget"), "actual_tokens", F.round("error_tokens", 3).alias("error_tokens"), "longest", "documents", "most_repeats")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(table(spark, d, "documents")).select("doc_id", "start_char", "end_char")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p2_cooccurrence, p3_found, p3_filled, p4_found, p5_varied, p6_found, p6_events, p7_ids, p7_round_trip, p8_selection, p8_shares, p9_found)}


_STRIP = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"
_QUEUE = f"""
WITH q AS (
  SELECT * EXCLUDE (queue_type, rn), lower({_STRIP.format('queue_type')}) AS queue_type
  FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY TRY_CAST(created_at AS TIMESTAMPTZ) DESC NULLS LAST) AS rn FROM {QUEUE} WHERE candidate_id IS NOT NULL) WHERE rn = 1)
"""
_LABELS = r"""
WITH l AS (
  SELECT DISTINCT visual_unit_id AS u, trim(regexp_replace(lower(label), '[\s\p{Z}_-]+', ' ', 'g')) AS x FROM (
    SELECT visual_unit_id, NFKC_LABEL AS label FROM yolo_visual_unit_label WHERE visual_unit_id IS NOT NULL)),
k AS (SELECT * FROM l WHERE x IS NOT NULL AND x NOT IN ('', 'none', 'null', 'nan', '[]') AND length(x) <= 80),
n AS (SELECT count(DISTINCT u) AS n FROM k),
s AS (SELECT x, count(*) AS s FROM k GROUP BY x),
p AS (SELECT a.x AS label_a, b.x AS label_b, count(*) AS c FROM k a JOIN k b ON a.u = b.u AND a.x < b.x GROUP BY 1, 2)
"""
# SQL has no NFKC; full-width ASCII and the ideographic blank are the only compatibility forms the table holds.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　 "
_PLAIN = "".join(chr(0x21 + i) for i in range(94)) + "  "
_NFKC = f"translate(label, '{_WIDE}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')"
_RUNS = _QUEUE + """
, f AS (
  SELECT source_content_id, queue_type, candidate_id, time_position_ms AS t,
    CASE WHEN group_start_ms >= 0 THEN group_start_ms ELSE time_position_ms END AS b1, CASE WHEN group_end_ms >= 0 THEN group_end_ms ELSE time_position_ms END AS b2
  FROM q WHERE source_content_id IS NOT NULL AND queue_type IS NOT NULL AND time_position_ms >= 0),
g AS (SELECT *, least(b1, b2) AS lo, greatest(b1, b2) AS hi FROM f),
h AS (SELECT *, CASE WHEN abs(lo - lag(lo) OVER w) <= 250 AND abs(hi - lag(hi) OVER w) <= 250 THEN 0 ELSE 1 END AS brk FROM g WINDOW w AS (PARTITION BY source_content_id, queue_type ORDER BY t, candidate_id)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY source_content_id, queue_type ORDER BY t, candidate_id ROWS UNBOUNDED PRECEDING) AS run FROM h),
e AS (SELECT source_content_id, queue_type, arg_min(candidate_id, (t, candidate_id)) AS first_candidate_id, arg_max(candidate_id, (t, candidate_id)) AS last_candidate_id, count(*) AS frames, max(t) - min(t) AS duration_ms FROM r GROUP BY source_content_id, queue_type, run)
"""
_FILES = rf"""
WITH r AS (
  SELECT {_STRIP.format('source_file_id')} AS id, lower({_STRIP.format('dedup_role')}) AS role, regexp_replace(lower({_STRIP.format('content_sha256')}), '^sha256:', '') AS h,
    {_STRIP.format('canonical_source_file_id')} AS ref, size_bytes, mtime_ns, ctime_ns, stem_key, finder_tags_json, updated_at FROM source_file_records WHERE source_file_id IS NOT NULL),
f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM r) WHERE rn = 1),
v AS (SELECT *, CASE WHEN regexp_full_match(h, '[0-9a-f]{{64}}') THEN h END AS own FROM f),
m AS (SELECT a.*, coalesce(a.own, b.own) AS g FROM v a LEFT JOIN v b ON a.own IS NULL AND a.ref = b.id WHERE a.role IS NULL OR a.role <> 'unsupported_or_blocked'),
c AS (SELECT *, coalesce({_STRIP.format('finder_tags_json')} NOT IN ('', '[]'), false) AS tagged,
  (size_bytes IS NOT NULL)::INT + (mtime_ns IS NOT NULL)::INT + (ctime_ns IS NOT NULL)::INT + coalesce({_STRIP.format('stem_key')} NOT IN ('', '[]'), false)::INT + coalesce({_STRIP.format('finder_tags_json')} NOT IN ('', '[]'), false)::INT AS n
  FROM m WHERE g IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY coalesce(role = 'canonical', false) DESC, n DESC, updated_at DESC NULLS LAST, id) AS rn, count(*) OVER (PARTITION BY g) AS files,
  row_number() OVER (PARTITION BY g, tagged ORDER BY updated_at DESC NULLS LAST, id) AS tn FROM c)
SELECT g AS content_sha256, max(CASE WHEN rn = 1 THEN id END) AS survivor_id, coalesce(max(CASE WHEN tagged AND tn = 1 THEN id END), '') AS tags_from_id FROM o WHERE files > 1 GROUP BY g
"""


_UNITS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^0-9a-z_]+'), lambda x: regexp_full_match(x, 'vu_[0-9a-f]{{24}}'))"
_GROUPS = _QUEUE.replace("WITH q", "WITH RECURSIVE q") + f"""
, r AS (SELECT {_UNITS.format('visual_unit_id')}[1] AS u, list_concat({_UNITS.format('canonical_visual_unit_id')}, {_UNITS.format('duplicate_reverse_visual_unit_ids')}) AS named, lower({_STRIP.format('duplicate_group_id')}) AS g FROM q),
e AS (SELECT u AS a, unnest(named) AS b FROM r WHERE u IS NOT NULL UNION SELECT u, '~' || g FROM r WHERE u IS NOT NULL AND g NOT IN ('', 'none', 'null', 'nan')),
d AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT DISTINCT a AS n, a AS m FROM d UNION SELECT reach.n, d.b FROM reach JOIN d ON reach.m = d.a)
SELECT n AS visual_unit_id, min(m) AS group_id FROM reach WHERE n LIKE 'vu%' AND m LIKE 'vu%' GROUP BY n HAVING count(DISTINCT m) > 1
"""


def oracle_sql() -> dict[str, str]:
    labels = _LABELS.replace("NFKC_LABEL", _NFKC)
    return {
        "p1_found": _QUEUE + """, k AS (SELECT *, row_number() OVER (PARTITION BY source_content_id, queue_type ORDER BY candidate_score DESC, candidate_id) AS rn FROM q
            WHERE source_content_id IS NOT NULL AND queue_type IS NOT NULL AND candidate_score IS NOT NULL AND NOT isnan(candidate_score))
            SELECT source_content_id, queue_type, candidate_id FROM k WHERE rn <= 3""",
        "p2_found": labels + """SELECT label_a, label_b FROM p, n, s a, s b WHERE a.x = label_a AND b.x = label_b AND c >= 5 AND 2000 * c >= n AND c * n >= 4 * a.s * b.s""",
        "p2_cooccurrence": labels + """SELECT label_a, label_b, c, a.s AS a, b.s AS b, n, round(c * n / (a.s::DOUBLE * b.s), 6) AS lift, round(log2(c * n / (a.s::DOUBLE * b.s)), 6) AS pmi
            FROM p, n, s a, s b WHERE a.x = label_a AND b.x = label_b""",
        "p3_found": _FILES,
        "p4_found": _GROUPS,
        "p6_found": _RUNS + "SELECT source_content_id, queue_type, first_candidate_id, last_candidate_id FROM e WHERE frames > 1",
        "p6_events": _RUNS + "SELECT source_content_id, queue_type, first_candidate_id, last_candidate_id, frames, duration_ms FROM e",
        "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }

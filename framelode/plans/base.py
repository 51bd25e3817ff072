"""The registry of queries, and the views that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (tables -> DataFrame) under its name, with SQL of the same result if there is one."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of one data directory."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        """A table, opened once a query."""
        opened = self.__dict__[name] = table(self.spark, self.d, name)
        return opened

    @property
    def frames(self) -> DataFrame:
        """Frames of known source and time, each once: id, src, t, luma, std, black."""
        v = self.visual_units.select(
            F.col("visual_unit_id").alias("id"), F.col("source_content_id").alias("src"), F.col("time_position_ms").alias("t"),
            F.coalesce("luma_mean", F.lit(0.0)).alias("luma"), F.coalesce("luma_std", F.lit(0.0)).alias("std"), F.coalesce("near_black", F.lit(0)).alias("black"),
        )
        return v.where("id is not null and src is not null and t >= 0").distinct()

    @property
    def labels(self) -> DataFrame:
        """unit, label: lower case and trimmed, each once."""
        return self.yolo_visual_unit_label.select(F.col("visual_unit_id").alias("unit"), F.lower(F.regexp_replace("label", r"(?U)^\s+|\s+$", "")).alias("label")).where("unit is not null and label is not null and label <> ''").distinct()

    @property
    def files(self) -> DataFrame:
        """Each file by its newest row."""
        from framelode.operators.tables import newest

        return newest(self.source_file_records.where("source_file_id is not null"), ["source_file_id"], [F.desc_nulls_last("updated_at"), F.asc_nulls_last("scan_run_id"), F.asc_nulls_last("dedup_role"), F.asc_nulls_last("content_sha256"), F.asc_nulls_last("size_bytes")])

    @property
    def queue(self) -> DataFrame:
        """Queue rows as they stand: kind in normal form, exact repeats once."""
        return self.stop03_2_candidate_queue_items.distinct().withColumn("kind", F.lower(F.trim("queue_type")))


FRAMES = """f AS (SELECT DISTINCT visual_unit_id AS id, source_content_id AS src, time_position_ms AS t, coalesce(luma_mean, 0) AS luma, coalesce(luma_std, 0) AS std, coalesce(near_black, 0) AS black
  FROM visual_units WHERE visual_unit_id IS NOT NULL AND source_content_id IS NOT NULL AND time_position_ms >= 0)"""
LABELS = r"l AS (SELECT * FROM (SELECT DISTINCT visual_unit_id AS unit, lower(regexp_replace(label, '^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$', '', 'g')) AS label FROM yolo_visual_unit_label WHERE visual_unit_id IS NOT NULL) WHERE label <> '')"
FILES = """s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY updated_at DESC NULLS LAST, scan_run_id NULLS LAST, dedup_role NULLS LAST, content_sha256 NULLS LAST, size_bytes NULLS LAST) AS rn
  FROM source_file_records WHERE source_file_id IS NOT NULL) WHERE rn = 1)"""
# SQL has no NFKC; full-width ASCII and the ideographic blank are the compatibility forms that the tables hold.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "\u3000"
_NARROW = ("".join(chr(0x21 + i) for i in range(94)) + " ").replace("'", "''")


def narrow(sql: str) -> str:
    """SQL of a text with its full-width signs as ASCII."""
    return f"translate({sql}, '{_WIDE}', '{_NARROW}')"


#: A text in lower case with every run of white space as one blank, trimmed; and the search terms of a registry row, none if they are no JSON list.
SQUEEZED = r"trim(regexp_replace(lower({0}), '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))"
LISTED = "CASE WHEN json_valid(search_terms_json) AND json_type(search_terms_json) = 'ARRAY' THEN json_extract_string(search_terms_json, '$[*]') ELSE []::VARCHAR[] END"
#: Files with ``d``, the 64 hex digits of a valid hash in whatever spelling.
HASHED = r"""cleaned AS (SELECT *, regexp_replace(lower(regexp_replace(content_sha256, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g')), '^sha256:', '') AS c FROM s),
  hashed AS (SELECT * EXCLUDE (c), CASE WHEN regexp_full_match(c, '[0-9a-f]{64}') THEN c END AS d FROM cleaned)"""
#: Greedy choice, row by row: a row stays if it resembles none that stayed before it in its source, up to a cap. Follows ``WITH RECURSIVE``.
NOVEL = """ {rows}, v AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY std DESC, t, id) AS n FROM r),
    g AS (SELECT src, n, id, t, true AS stays, [{{'t': t, 'luma': luma, 'std': std}}] AS kept FROM v WHERE n = 1
      UNION ALL SELECT src, n, id, t, ok, CASE WHEN ok THEN list_append(kept, {{'t': t, 'luma': luma, 'std': std}}) ELSE kept END
      FROM (SELECT v.*, g.kept, len(g.kept) < {cap} AND len(list_filter(g.kept, lambda x: {alike})) = 0 AS ok FROM g JOIN v ON v.src = g.src AND v.n = g.n + 1) w)
    SELECT src, id, t FROM g WHERE stays"""
QUEUE = "q AS (SELECT DISTINCT *, lower(trim(queue_type)) AS kind FROM stop03_2_candidate_queue_items)"

"""Reading files, delimited text and vector payloads."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelode.functions import vectors

# What extensions hold, in the order in which they are tried.
KINDS = {
    "video": ("mov", "mp4", "m4v", "avi", "mkv", "mts", "m2ts", "insv", "mxf", "braw", "r3d", "crm", "ari"),
    "image": ("jpg", "jpeg", "png", "tif", "tiff", "heic", "heif", "hif", "dng", "arw", "cr2", "cr3", "nef", "nrw", "rw2", "raf", "orf", "webp", "bmp", "gif"),
    "audio": ("wav", "mp3", "m4a", "aac", "flac", "aiff", "aif", "ogg", "opus", "wma"),
    "metadata_sidecar": ("xmp", "xaml", "aae", "dop", "cos", "pp3", "on1", "lmnr"),
    "text": ("txt", "srt", "vtt", "ass", "ssa", "json", "csv", "tsv", "xml", "xmp", "md", "rtf", "log", "cue", "edl", "fcpxml", "otio"),
    "archive": ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "dmg", "iso"),
}
IGNORED = (".ds_store", "thumbs.db", "desktop.ini")


def media_kind(name: Column, size: Column, failed: Column) -> tuple[Column, Column, Column]:
    """Kind, support status and reason, in the order: ignored names, unreadable files, empty files, then the extension.

    A sidecar is linked to what it describes and is no input itself; archives and other extensions are unsupported.
    """
    ext = F.lower(F.regexp_extract(name, r"[^./][^/]*\.([^./]+)$", 1))
    held = F
    for k, exts in KINDS.items():
        held = held.when(ext.isin(*exts), k)
    held = held.otherwise("other")
    refused = F.when(F.lower(name).isin(*IGNORED), "system_sidecar_ignored_name").when(failed, "stat_failed").when(size.isNull(), "size_unknown").when(size == 0, "zero_byte_file")
    reason = F.coalesce(
        refused, F.when(held == "metadata_sidecar", "linked_metadata_sidecar_not_processing_queue").when(held == "archive", "archive_or_disk_image_not_processed").when(held != "other", "")
        .when(ext == "", "missing_extension").otherwise(F.concat(F.lit("unsupported_extension:."), ext)),
    )
    status = F.when(reason == "", "supported").when(reason.isin("stat_failed", "size_unknown"), "blocked").when(reason.startswith("linked_"), "metadata_sidecar").otherwise("unsupported")
    return F.when(status.isin("supported", "metadata_sidecar"), held).otherwise("unsupported"), status, reason


def scan_files(spark: SparkSession, roots: list[str], content: bool = False) -> DataFrame:
    """Every file below the roots once: path, size, time; with ``content`` also quick and full hash.

    Without it only the listing is read. A path under two roots comes once.
    """
    from framelode.functions import hashing

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    keep = [F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms")]
    if content:
        quick, full = hashing.content_hashes(F.col("content"), F.col("length"))
        keep += [quick.alias("quick_hash"), full.alias("content_sha256")]
    return files.select(*keep).dropDuplicates(["path"])


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or text delimited by tab, semicolon or comma, whichever is most frequent in the first line.

    A JSON line that doesn't parse becomes a row with only ``_corrupt_record``.
    """
    first = spark.read.text(path).limit(1).collect()
    head = first[0][0] if first else ""
    if path.endswith(".jsonl") or head.lstrip().startswith("{"):
        return spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    sep = max("\t;,", key=head.count)
    return spark.read.option("header", True).option("sep", sep).csv(path)


VECTOR_SCHEMA = "embedding_id string, visual_unit_id string, source_content_id string, dimension int, vector array<double>, vector_sha256 string, run_id string"


@F.pandas_udf(T.StringType())
def vector_digest(vectors_: pd.Series) -> pd.Series:
    """The SHA-256 of a vector written as compact JSON, as payloads carry it. The shortest decimal form of a float is Python's, not the JVM's."""
    return vectors_.map(lambda v: None if v is None else hashlib.sha256(json.dumps([float(x) for x in v], separators=(",", ":")).encode()).hexdigest())


def check_vectors(spark: SparkSession, path: str, index: DataFrame, run_id: str, dimension: int) -> DataFrame:
    """``index`` (embedding_id, visual_unit_id, ...) with the vector of each from a JSON-lines payload, and ``problem``, null if it is sound.

    A row of the payload is sound if it is of this unit and run, of the right length, finite, of unit length to 0.001,
    and has the digest it carries. A vector must be there, sound, and only once.
    """
    rows = spark.read.schema(VECTOR_SCHEMA).json(path).select("embedding_id", F.col("visual_unit_id").alias("unit"), "vector", "vector_sha256", F.col("run_id").alias("run"))
    met = index.join(rows, "embedding_id", "left")
    sound = (
        F.col("unit").eqNullSafe(F.col("visual_unit_id")) & F.col("run").eqNullSafe(F.lit(run_id)) & F.coalesce(vectors.is_valid(F.col("vector"), dimension), F.lit(False))
        & F.col("vector_sha256").eqNullSafe(vector_digest(F.col("vector")))
    )
    judged = met.withColumn("sound", sound)
    found = judged.groupBy("embedding_id").agg(F.count("vector").alias("copies"), F.sum(F.col("sound").cast("int")).alias("good"), F.min(F.when(F.col("sound"), F.col("vector"))).alias("vector"))
    problem = F.when(F.col("copies") == 0, "missing").when(F.col("good") < F.col("copies"), "invalid").when(F.col("copies") > 1, "duplicate")
    return index.join(found, "embedding_id").withColumn("problem", problem).drop("copies", "good")


def read_vectors(spark: SparkSession, path: str, index: DataFrame, run_id: str, dimension: int) -> DataFrame:
    """The vectors of ``check_vectors``, if all are sound and no unit has two; else an error that counts the problems."""
    checked = check_vectors(spark, path, index, run_id, dimension)
    bad = {r["problem"]: r["count"] for r in checked.where("problem is not null").groupBy("problem").count().collect()}
    if twice := checked.groupBy("visual_unit_id").count().where("count > 1").count():
        bad["units_with_two_vectors"] = twice
    if bad:
        raise ValueError("bad vectors: " + ", ".join(f"{k}={n}" for k, n in sorted(bad.items())))
    return checked.drop("problem")


def lenient_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Vectors brought to unit length; those that can't be are dropped."""
    return df.withColumn(vector, vectors.normalize(F.col(vector))).where(F.col(vector).isNotNull())

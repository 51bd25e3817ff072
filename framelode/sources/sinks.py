"""Writing tables: with read-back, idempotent by digest, immutable snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from framelode.functions import hashing


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def table_digest(df: DataFrame) -> str:
    """A digest of all rows that doesn't depend on their order; one pass, combined before the shuffle."""
    return df.agg(hashing.multiset_digest(*[F.col(c) for c in sorted(df.columns)])).first()[0]


def commit(df: DataFrame, path: str) -> str:
    """Write beside the target, read back and compare, then rename. The table before is kept as ``.before`` until the new one is in place.

    The rows are made once: their digest is observed while they are written.
    """
    spark = df.sparkSession
    restore(spark, path)
    draft = f"{path}.draft"
    seen = Observation()
    df.observe(seen, hashing.multiset_digest(*[F.col(c) for c in sorted(df.columns)]).alias("digest")).write.mode("overwrite").parquet(draft)
    digest = table_digest(spark.read.parquet(draft))
    if digest != seen.get["digest"]:
        raise OSError(f"{draft} doesn't hold what was written")
    fs, target = _fs(spark, path)
    before = _fs(spark, f"{path}.before")[1]
    if fs.exists(target) and not fs.rename(target, before):
        raise OSError(f"{path} can't be put aside")
    if not fs.rename(_fs(spark, draft)[1], target):
        fs.rename(before, target)
        raise OSError(f"{draft} can't be renamed")
    fs.delete(before, True)
    return digest


def restore(spark: SparkSession, path: str) -> bool:
    """Puts back the table that a commit had put aside when it was cut off; whether there was one."""
    fs, target = _fs(spark, path)
    before = _fs(spark, f"{path}.before")[1]
    if fs.exists(before) and not fs.exists(target):
        return bool(fs.rename(before, target))
    fs.delete(before, True)
    return False


def commit_once(df: DataFrame, path: str) -> str:
    """COMMITTED, or IDEMPOTENT_PASS if the target already holds these rows."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and table_digest(spark.read.parquet(path)) == table_digest(df):
        return "IDEMPOTENT_PASS"
    commit(df, path)
    return "COMMITTED"


def snapshot(df: DataFrame, path: str) -> str:
    """A table that can't be replaced; its digest is kept beside it."""
    df.write.mode("errorifexists").parquet(path)
    digest = table_digest(df.sparkSession.read.parquet(path))
    df.sparkSession.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("errorifexists").json(f"{path}.digest")
    return digest


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot, if its rows still have the digest they were written with."""
    df = spark.read.parquet(path)
    if spark.read.schema("digest string").json(f"{path}.digest").first()[0] != table_digest(df):
        raise ValueError(f"{path} was changed after it was written")
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(frames: list[DataFrame], path: str) -> None:
    """The union of frames with the union of their fields, in first-seen order."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).write.mode("overwrite").option("header", True).csv(path)


def restore_missing(table: DataFrame, key: str, referenced: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows for referenced ids that the table lacks, taken from a manifest."""
    lost = referenced.select(key).distinct().join(table.select(key), key, "left_anti")
    return table.unionByName(manifest.join(lost, key, "left_semi").dropDuplicates([key]), allowMissingColumns=True)

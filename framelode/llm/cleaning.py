"""Clean-up shared by the operators on queue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def latest(df: DataFrame, key: str, instant: Column, payload: list[Column], names: list[str]) -> DataFrame:
    """One row per ``key``: the one with the latest ``instant`` (null is earliest).

    Equal instants are resolved by the payload itself, so the result doesn't depend
    on row order. Rows without a key name nothing and are left out. The maximum is
    combined before the shuffle: a key with any number of rows costs one row a task.
    """
    packed = F.struct(instant.alias("at"), *[c.alias(f"p{i}") for i, c in enumerate(payload)])
    best = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(packed).alias("v"))
    return best.select(*[F.col("k").alias(key)] * (key not in names), *[F.col(f"v.p{i}").alias(n) for i, n in enumerate(names)])


def latest_candidates(queue: DataFrame, names: list[str]) -> DataFrame:
    """Each candidate_id by its row with the latest created_at as an instant; queue_type trimmed and in lower case."""
    columns = [F.lower(strip(F.col(n))) if n == "queue_type" else F.col(n) for n in names]
    return latest(queue, "candidate_id", F.col("created_at").try_cast("timestamp"), columns, names)

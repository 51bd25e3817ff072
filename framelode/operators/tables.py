"""Set, upsert and comparison operators on keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filters(*conditions: Column | None) -> Column:
    """All conditions that are given; none at all lets every row pass."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def prefix(c: Column, text: str) -> Column:
    """Prefix match without regard to ASCII case; nothing in ``text`` is a wildcard."""
    return F.startswith(F.lower(c), F.lit(text.lower()))


def time_between(c: Column, low: int | None, high: int | None) -> Column | None:
    """Within bounds; an unknown time counts as -1."""
    t = F.coalesce(c, F.lit(-1))
    return filters(None if low is None else t >= low, None if high is None else t <= high)


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Each task keeps one row a key before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones field by field; a null in the new row keeps the old value."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def classify_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, change``: new, unchanged, updated or missing, by null-safe comparison of all fields."""
    fields = [c for c in old.columns if c != key]
    a = old.select(F.col(key).alias("k1"), F.struct(*fields).alias("a"))
    b = new.select(F.col(key).alias("k2"), F.struct(*fields).alias("b"))
    change = F.when(F.col("k1").isNull(), "new").when(F.col("k2").isNull(), "missing").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("updated")
    return a.join(b, F.col("k1") == F.col("k2"), "full_outer").select(F.coalesce("k1", "k2").alias(key), change.alias("change"))


def added_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one version has, repeats counted."""
    return new.exceptAll(old).withColumn("side", F.lit("added")).unionAll(old.exceptAll(new).withColumn("side", F.lit("removed")))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows of one page with ``next_offset`` (null on the last). Only offset + limit + 1 rows are kept while sorting."""
    offset, limit = max(0, offset), max(1, limit)
    top = df.orderBy(*order).limit(offset + limit + 1).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    more = F.max("position").over(Window.partitionBy()) > offset + limit
    return top.withColumn("next_offset", F.when(more, F.lit(offset + limit))).where(F.col("position").between(offset + 1, offset + limit))


def evenly_spaced(df: DataFrame, keys: list[str], order: list[Column], count: Column) -> DataFrame:
    """Rows at round((n - 1) * i / (count - 1)), halves to even."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_b", F.least(count, F.col("_n")))
    wanted = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_b") - 1, F.lit(0)).cast("int")), lambda i: F.when(F.col("_b") > 1, F.bround((F.col("_n") - 1) * i / (F.col("_b") - 1)).cast("int")).otherwise(F.bround((F.col("_n") - 1) / 2).cast("int")))
    return ranked.where(F.array_contains(wanted, F.col("_r").cast("int"))).drop("_r", "_n", "_b")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def missing_only(wanted: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """Rows of ``wanted`` that no earlier result holds."""
    return reduce(lambda d, x: d.join(x.select(key).distinct(), key, "left_anti"), done, wanted)

"""Aggregates. The three percentile definitions are kept apart by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.runtime import Scratch, bounded_broadcast


#: Buckets into which the span of a group is cut, and rows of a group that are then ranked at once.
BUCKETS_OF_SPAN, RANKED_AT_ONCE = 2048, 1_000_000


def value_at(df: DataFrame, keys: list[str], value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``keys, which, value, n``: of each group the values of some ranks from 0 (named, as functions of the group's size). Nulls take no part.

    The span of values is cut into buckets that are counted before the shuffle; only the bucket that holds a rank is cut
    again, until it holds few rows, and only those are ranked. A group with any number of rows is never sorted in one task.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v"))
    groups = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    listed = F.array(*[F.struct(F.lit(w).alias("which"), rank(F.col("n")).cast("long").alias("r")) for w, rank in wanted.items()])
    state = scratch.put(groups.withColumn("x", F.explode(listed)).select(*names, "x.which", "x.r", "n", "lo", "hi", F.col("n").alias("left")), "state")

    def inside() -> DataFrame:
        asked = bounded_broadcast(state, ranks)
        return rows.alias("a").join(asked.alias("b"), same_of("a", "b") & F.col("v").between(F.col("lo"), F.col("hi"))).select(*[F.col(f"b.{n}").alias(n) for n in names], "which", "r", "n", "lo", "hi", "v")

    def same_of(a: str, b: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names], F.lit(True))

    def largest() -> tuple[int, int]:
        """How many ranks are asked for, and the rows that the largest of their spans holds."""
        return state.agg(F.count("*"), F.coalesce(F.max(F.when(F.col("lo") < F.col("hi"), F.col("left"))), F.lit(0))).first()

    ranks, most = largest()
    if most > RANKED_AT_ONCE:
        rows = scratch.put(rows, "values")
    while most > RANKED_AT_ONCE:
        place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BUCKETS_OF_SPAN - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS_OF_SPAN))).otherwise(0)
        counted = inside().groupBy(*names, "which", "r", "n", place.alias("bucket")).agg(F.count("*").alias("left"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        line = Window.partitionBy(*names, "which").orderBy("bucket")  # at most BUCKETS_OF_SPAN rows
        summed = counted.withColumn("upto", F.sum("left").over(line)).where(F.col("upto") > F.col("r"))
        first = summed.groupBy(*names, "which").agg(F.min(F.struct("bucket", "upto", "left", "lo", "hi", "r", "n")).alias("x"))
        state = scratch.put(first.select(*names, "which", (F.col("x.r") - (F.col("x.upto") - F.col("x.left"))).alias("r"), "x.n", "x.lo", "x.hi", "x.left"), "state")
        most = largest()[1]
    few = inside().where("lo < hi").withColumn("_r", F.row_number().over(Window.partitionBy(*names, "which").orderBy("v")) - 1).where(F.col("_r") == F.col("r")).select(*names, "which", "v", "n")
    found = few.unionAll(state.where("lo = hi").select(*names, "which", F.col("lo").alias("v"), "n"))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "which", F.col("v").alias("value"), "n")


def percentile_nearest(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The value of rank ceil(q * n) - 1."""
    return value_at(df, keys, value, {"q": lambda n: F.greatest(F.ceil(n * q) - 1, F.lit(0))}).select(*keys, "value")


def percentile_round(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The value of rank round((n - 1) * q), halves to even."""
    return value_at(df, keys, value, {"q": lambda n: F.bround((n - 1) * q)}).select(*keys, "value")


def percentiles_linear(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """``keys, n`` and a column for each of ``qs``: the value at rank (n - 1) * q, between neighbours in proportion."""
    ranks = {}
    for name, q in qs.items():
        ranks |= {f"{name}<": lambda n, q=q: F.floor((n - 1) * q), f"{name}>": lambda n, q=q: F.ceil((n - 1) * q)}
    found = value_at(df, keys, value, ranks)
    at = lambda w: F.max(F.when(F.col("which") == w, F.col("value")))
    sides = found.groupBy(*keys).agg(F.max("n").alias("n"), *[at(w).alias(w) for w in ranks])
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return sides.select(*keys, "n", *[(F.col(f"{name}<") + (F.col(f"{name}>") - F.col(f"{name}<")) * part(q)).alias(name) for name, q in qs.items()])


def percentile_linear(value: str, q: float) -> Column:
    """As an aggregate, for groups whose distinct values fit a task; ``percentiles_linear`` has no such limit."""
    return F.percentile(value, q)


def summary(value: str) -> list[Column]:
    return [F.min(value).alias("least"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.9).alias("p90"), F.max(value).alias("most"), F.count(value).alias("n")]


#: Upper bounds of count buckets; beyond the last one everything is one bucket.
BUCKETS = (("0", 0), ("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 5), ("6-10", 10), ("11-20", 20))


def bucket(c: Column) -> Column:
    made = F
    for name, top in BUCKETS:
        made = made.when(c <= top, name)
    return made.otherwise(">20")


def bucket_histogram(df: DataFrame, count: str) -> DataFrame:
    """Rows per bucket, empty buckets included."""
    frame = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate([b for b, _ in BUCKETS] + [">20"])], "bucket string, position int")
    counted = df.groupBy(bucket(F.col(count)).alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(frame).join(counted, "bucket", "left").select("bucket", "position", F.coalesce("n", F.lit(0)).alias("n"))


def top_share(df: DataFrame, value: str, tie: str, tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """The share of the total that the k largest rows hold: the k come from a bounded top-k, not a global rank."""
    total = df.agg(F.sum(value).alias("total"))
    top = df.orderBy(F.desc(value), tie).limit(max(tops)).select(value, tie).withColumn("r", F.row_number().over(Window.orderBy(F.desc(value), tie)))
    shares = top.agg(*[F.sum(F.when(F.col("r") <= k, F.col(value))).alias(f"s{k}") for k in tops])
    return shares.join(F.broadcast(total)).select(*[(F.col(f"s{k}") / F.col("total")).alias(f"top{k}_share") for k in tops])


def concentration(df: DataFrame, key: str, value: str, least: float = 0.2) -> DataFrame:
    """Groups that hold more than ``least`` of the total."""
    sums = df.groupBy(key).agg(F.sum(value).alias("part"))
    total = df.agg(F.sum(value).alias("total"))
    return sums.join(F.broadcast(total)).withColumn("share", F.col("part") / F.col("total")).where(F.col("share") > least).select(key, "share")


def venn(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts of ids by the sets that hold them: one row for each combination that occurs."""
    flagged = reduce(DataFrame.unionByName, [df.select(key).distinct().select(key, *[F.lit(int(n == name)).alias(n) for n in sets]) for name, df in sets.items()])
    one = flagged.groupBy(key).agg(*[F.max(n).alias(n) for n in sets])
    return one.groupBy(*sets).agg(F.count("*").alias("n"))


def status_pivot(df: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """A count per status in one row per key; a status that doesn't occur is 0."""
    return df.groupBy(key).agg(*[F.sum((F.col(status) == v).cast("int")).alias(f"n_{v}") for v in values], F.count("*").alias("total"))


def reason_counts(df: DataFrame, reasons: str, sep: str = r"\|") -> DataFrame:
    parts = F.filter(F.transform(F.split(reasons, sep), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(F.explode(parts).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def rare_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values that occur once in their group; counted by aggregation, so a large group isn't gathered."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n")).where("n = 1").drop("n")

"""Window operators on frames of a source. Every order ends with an id, so results don't depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_source(source: str, *order: str):
    return Window.partitionBy(source).orderBy(*order)


def islands(df: DataFrame, source: str, order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the stretches of rows; ``starts`` says where a new one begins (it may use lags over the same order)."""
    w = in_source(source, *order)
    return df.withColumn("_s", starts).withColumn(name, F.sum(F.when(F.col("_s"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def gap_islands(df: DataFrame, source: str, time: str, tie: str, gap: int) -> DataFrame:
    """A stretch ends where the next row comes more than ``gap`` later; an equal gap doesn't end it."""
    w = in_source(source, time, tie)
    return islands(df, source, [time, tie], F.col(time) - F.lag(time).over(w) > gap)


def change_islands(df: DataFrame, source: str, order: list[str], value: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """A stretch ends where ``value`` changes, but not to an ignored one."""
    before = F.lag(value).over(in_source(source, *order))
    return islands(df, source, order, before.isNotNull() & (F.col(value) != before) & ~F.col(value).isin(*ignored, "\0"))


def island_sizes(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("frames"), F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), (F.max(time) - F.min(time)).alias("span_ms"))


def local_peaks(df: DataFrame, source: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value is at least that of both neighbours (a missing neighbour counts as equal)."""
    w = in_source(source, *order)
    before, after = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    return df.withColumn("is_peak", (F.col(value) >= before) & (F.col(value) >= after))


def neighbour_max(df: DataFrame, source: str, order: list[str], value: str, name: str) -> DataFrame:
    """The largest change to the frame before or after."""
    w = in_source(source, *order)
    return df.withColumn(name, F.greatest(F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)), F.lit(0.0)), F.coalesce(F.abs(F.lead(value).over(w) - F.col(value)), F.lit(0.0))))


def around(df: DataFrame, source: str, order: list[str], value: str, radius: int = 3) -> DataFrame:
    """Mean and least absolute difference to the ``radius`` frames on each side, itself excluded."""
    w = in_source(source, *order)
    others = F.concat(F.collect_list(value).over(w.rowsBetween(-radius, -1)), F.collect_list(value).over(w.rowsBetween(1, radius)))
    far = F.transform(others, lambda x: F.abs(x - F.col(value)))
    return df.withColumn("least_difference", F.array_min(far)).withColumn("mean_difference", F.when(F.size(far) > 0, F.aggregate(far, F.lit(0.0), lambda s, x: s + x) / F.size(far)))


def ranks(df: DataFrame, source: str, order: list[Column]) -> DataFrame:
    """Rank from 0 and size of the source."""
    w = Window.partitionBy(source)
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count("*").over(w))


def rank_bins(df: DataFrame, source: str, order: list[Column], bins: Column) -> DataFrame:
    """Bin i holds ranks from floor(i*n/T) to floor((i+1)*n/T) - 1, which ``ntile`` doesn't give."""
    ranked = ranks(df, source, order)
    return ranked.withColumn("bins", bins).withColumn("bin", F.floor((F.col("rank") * F.col("bins") + F.col("bins") - 1) / F.col("total")))


def pick_positions(df: DataFrame, source: str, order: list[Column], parts: list[float]) -> DataFrame:
    """The rows at round((n - 1) * p), halves to even, of each source; a row asked for twice comes once."""
    ranked = ranks(df, source, order)
    wanted = F.array(*[F.bround((F.col("total") - 1) * F.lit(p)).cast("int") for p in parts])
    return ranked.where(F.array_contains(wanted, F.col("rank").cast("int")))


def tumbling(df: DataFrame, source: str, time: str, width: int) -> DataFrame:
    """Windows from the source's first time; the last one takes the remainder."""
    w = Window.partitionBy(source)
    start, end = F.min(time).over(w), F.max(time).over(w)
    count = F.greatest(F.lit(1), F.floor((end - start) / width))
    return df.withColumn("window", F.least(count - 1, F.floor((F.col(time) - start) / width)))


def interval_stats(df: DataFrame, source: str, time: str, tie: str, low: int, high: int) -> DataFrame:
    """Median of the intervals between neighbours, the share of them in [low, high], and the longest."""
    gaps = df.withColumn("_gap", F.col(time) - F.lag(time).over(in_source(source, time, tie))).where("_gap is not null")
    return gaps.groupBy(source).agg(F.median("_gap").alias("median_gap"), F.avg(F.col("_gap").between(low, high).cast("int")).alias("valid_ratio"), F.max("_gap").alias("max_gap"), F.count("*").alias("gaps"))


def monotonic_ratio(df: DataFrame, source: str, order: list[str], value: str) -> DataFrame:
    w = in_source(source, *order)
    return df.withColumn("_b", F.lag(value).over(w)).where("_b is not null").groupBy(source).agg(F.avg((F.col(value) >= F.col("_b")).cast("int")).alias("monotonic_ratio"))


def local_argmax(df: DataFrame, source: str, time: str, tie: str, value: str, reach: int) -> DataFrame:
    """Rows that are the best within ``reach`` to either side: the largest value, then the earliest, then the smallest id.

    A range self-join on buckets as wide as the reach, so a row only meets its own and the two neighbouring buckets.
    """
    own = df.select(F.col(source).alias("s"), F.col(time).alias("t"), F.col(tie).alias("i"), F.col(value).alias("v")).withColumn("b", F.floor(F.col("t") / reach))
    other = own.select(F.col("s"), F.col("t").alias("t2"), F.col("i").alias("i2"), F.col("v").alias("v2"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    better = (F.abs(F.col("t") - F.col("t2")) <= reach) & (F.struct(-F.col("v2"), F.col("t2"), F.col("i2")) < F.struct(-F.col("v"), F.col("t"), F.col("i")))
    beaten = own.join(other, (own["s"] == other["s"]) & (own["b"] == other["b"]) & better, "left_anti")
    return beaten.select(F.col("s").alias(source), F.col("i").alias(tie), F.col("v").alias(value))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Ranks from 1 over all rows without one task for all: range partitions are ranked on their own and shifted by the sizes before them.

    Rows come from ``df`` twice (once for the sizes), so it should be cheap or written. ``order`` must be total.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    numbered = parts.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    line = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = numbered.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_m", "_p", "_i", "_before")

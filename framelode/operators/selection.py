"""Selection of frames: scores, anchors, budgets and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions.text import reasons
from framelode.operators import windows


def signal_score(categories: Column, labels: Column, confidence: Column, centered: Column, structure: Column, label_change: Column, vector_change: Column, grid_change: Column, strong_text: Column) -> Column:
    """Nine capped parts, to six digits."""
    cap = lambda c, top: F.least(F.lit(top), c)
    parts = [
        cap(categories * 0.9, 3.0), cap(labels * 0.2, 2.0), cap(confidence * 1.5, 1.5), cap(centered * 0.5, 1.5), cap(structure / 24.0, 1.0),
        cap(label_change, 1.0), cap(vector_change * 2.0, 1.0), cap(grid_change, 1.0), F.when(strong_text, 0.5).otherwise(0.0),
    ]
    return F.round(sum(parts[1:], parts[0]), 6)


def tail_start(start: Column, end: Column) -> Column:
    """Where the tail of a film begins: its last 5 %, between 3 and 12 seconds; null for unknown bounds."""
    length = F.least(F.greatest(0.05 * (end - start), F.lit(3000.0)), F.lit(12000.0))
    return F.when(end > start, F.greatest(start, end - length).cast("bigint"))


def hard_rejections(black: Column, status: Column, tail: Column, time: Column, blocked: Column, missing: Column) -> Column:
    return reasons([(black, "near_black"), (status != "PASS", "signature_failed"), (F.coalesce(time >= tail, F.lit(False)), "in_tail"), (blocked, "identity_blocked"), (missing, "file_missing")])


def anchors(frames: DataFrame, source: str, time: str, key: str, stride: int = 6, radius: int = 3) -> DataFrame:
    """Anchors from the middle frame outwards every ``stride`` ranks (left first), with the ranks each covers."""
    ranked = windows.ranks(frames, source, [F.col(time), F.col(key)])
    middle = F.floor(F.col("total") / 2)
    far = F.col("rank") - middle
    kept = ranked.where(F.pmod(far, F.lit(stride)) == 0)
    number = F.row_number().over(Window.partitionBy(source).orderBy(F.abs(far), far)) - 1
    return kept.select(source, F.col(key), number.alias("anchor"), "rank", F.greatest(F.lit(0), F.col("rank") - radius).alias("from_rank"), F.least(F.col("total") - 1, F.col("rank") + radius).alias("to_rank"))


def density_target(n: Column, share: float) -> Column:
    return F.least(n, F.greatest(F.lit(1), F.ceil(F.round(n * share, 6))))


def density_selection(frames: DataFrame, source: str, time: str, key: str, score: str, high: str, share: float) -> DataFrame:
    """Bins of equal rank counts; the best of each: high signal first, then score, earliest, smallest id."""
    sized = windows.ranks(frames, source, [F.col(time), F.col(key)])
    binned = windows.rank_bins(sized.drop("rank", "total"), source, [F.col(time), F.col(key)], density_target(F.count("*").over(Window.partitionBy(source)), share))
    w = Window.partitionBy(source, "bin").orderBy(F.desc(high), F.desc(score), time, key)
    return binned.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def nearest_to_anchors(frames: DataFrame, source: str, time: str, key: str, every: int) -> DataFrame:
    """For each anchor ``every`` apart from a source's first time, the nearest frame: of those in its own and neighbouring cells, else of the frames around the hole."""
    w = Window.partitionBy(source)
    ordered = w.orderBy(time, key)
    spans = frames.withColumn("_s", F.min(time).over(w)).withColumn("_next", F.lead(time).over(ordered)).withColumn("_prev", F.lag(time).over(ordered))
    # A frame serves the anchors from the middle to its predecessor up to the middle to its successor.
    low = F.coalesce(F.ceil(((F.col("_prev") + F.col(time)) / 2 - F.col("_s")) / every), F.lit(0))
    high = F.coalesce(F.floor(((F.col("_next") + F.col(time)) / 2 - F.col("_s")) / every), F.floor((F.col(time) - F.col("_s")) / every))
    served = spans.where(high >= low).select(source, time, key, "_s", F.explode(F.sequence(low, high)).alias("anchor"))
    pick = Window.partitionBy(source, "anchor").orderBy(F.abs(F.col(time) - F.col("_s") - F.col("anchor") * every), time, key)
    return served.withColumn("_n", F.row_number().over(pick)).where("_n = 1").select(source, "anchor", key, time)


def duration_budget(seconds: Column) -> Column:
    """Frames a film is worth by its length."""
    per_minute = F.ceil(seconds / 60)
    return F.when(seconds < 20, 1).when(seconds < 60, 2).when(seconds < 180, F.least(F.lit(3), per_minute)).when(seconds < 600, F.least(F.lit(5), per_minute)).otherwise(F.least(F.lit(10), per_minute))


def count_budget(frames: Column) -> Column:
    return F.when(frames <= 3, 1).when(frames <= 8, 1).when(frames <= 20, 2).when(frames <= 60, 4).otherwise(6)


def supplement_cap(frames: Column) -> Column:
    return F.when(frames <= 20, 1).when(frames <= 100, 2).otherwise(3)


def timelapse(images: DataFrame, source: str, time: str, key: str, least: int = 60, gap: int = 30_000, low: int = 1500, high: int = 10_000, valid: float = 0.85) -> DataFrame:
    """Stretches of at least ``least`` images whose intervals have a median in [low, high] and mostly lie in it."""
    split = windows.gap_islands(images, source, time, key, gap)
    w = windows.in_source(source, time, key)
    stepped = split.withColumn("_gap", F.when(F.lag("island").over(w) == F.col("island"), F.col(time) - F.lag(time).over(w)))
    groups = stepped.groupBy(source, "island").agg(F.count("*").alias("images"), F.median("_gap").alias("median_gap"), F.avg(F.col("_gap").between(low, high).cast("int")).alias("valid_ratio"), F.min(time).alias("start_ms"), F.max(time).alias("end_ms"))
    return groups.where((F.col("images") >= least) & F.col("median_gap").between(low, high) & (F.col("valid_ratio") >= valid))


def collapse_positions(first_middle: Column, middle_last: Column) -> Column:
    """Which of first, middle and last remain when neighbours are alike."""
    return F.when(first_middle & middle_last, "middle").when(first_middle, "middle|last").when(middle_last, "first|middle").otherwise("first|middle|last")


def seed_union(seeds: dict[int, DataFrame], key: str) -> DataFrame:
    """Rows of all seeds once each, with the highest priority."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [df.select(key).withColumn("priority", F.lit(p)) for p, df in seeds.items()])
    return rows.groupBy(key).agg(F.max("priority").alias("priority"))


def frame_times(duration: Column, offset: int = 2000, step: int = 3000) -> Column:
    """Sampling times of a film; a short one has its middle, or one early time; one under half a second none."""
    short = F.when(duration < 500, F.array().cast("array<bigint>")).otherwise(F.array(F.when(duration > 1500, F.lit(1500)).otherwise(F.greatest(F.lit(300), F.floor(duration / 2))).cast("bigint")))
    return F.when(duration > offset, F.sequence(F.lit(offset).cast("bigint"), duration.cast("bigint"), F.lit(step).cast("bigint"))).otherwise(short)


def expected_frames(duration: Column, offset: int = 2000, step: int = 3000) -> Column:
    return F.when(duration > offset, F.floor((duration - offset) / step) + 1).when(duration >= 500, 1).otherwise(0)


def extraction_status(expected: Column, produced: Column) -> Column:
    """How an extraction went; one frame less is tolerated."""
    return (
        F.when((expected == 0) & (produced == 0), "success_nothing_expected").when(produced == 0, "retry_no_frames").when(produced >= expected, "success_complete")
        .when(produced >= expected - 1, "success_one_missing").when(produced >= 0.7 * expected, "success_lower_than_estimate").otherwise("retry_too_few")
    )


def dynamics_class(p90: Column) -> Column:
    return F.when(p90 < 0.02, "low").when(p90 < 0.10, "normal").otherwise("high")

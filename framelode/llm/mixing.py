"""Problem 8: mixing sources to target weights by hash-threshold histograms.

Every record has a fixed hash. Tokens are summed by source and hash bucket; a source's
share of the total is a budget, whole repeats of the source use up most of it, and the
rest is the records below a hash threshold. The bucket in which the running sum crosses
the budget is refined by the next bits of the hash, and only that one, until it holds
one record. Records are then filtered against the thresholds; nothing is sorted. One
hash serves all mixes, so selections of one source are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.llm.cleaning import strip
from framelode.llm.tokenize import BYTE_BPE_50K, token_counts
from framelode.runtime import Scratch, bounded_broadcast

#: Bits of the hash a level of the histogram looks at, and levels (60 bits in all).
BITS, LEVELS = 12, 5


def normal_source(c: Column) -> Column:
    return F.lower(strip(c))


def plan(targets: DataFrame, sizes: DataFrame, total: int | None = None) -> DataFrame:
    """Per mix and source: the share, the budget in tokens, whole repeats, and the tokens that remain to be picked.

    The total of a mix is the largest that every source can serve its share of under
    its cap (with no cap at all: all tokens of its sources once), or ``total`` if that
    is less. A source that has no tokens can't be served: its weight is spread over the
    others, and it stays in the report with nothing.
    """
    clean = targets.select(
        "mix_name", normal_source(F.col("source")).alias("source"),
        F.when(F.col("target_weight") > 0, F.when(~F.isnan(F.col("target_weight").cast("double")), F.col("target_weight").cast("double"))).alias("w"), F.col("max_repeats").cast("long").alias("cap"),
    ).where("mix_name is not null and source is not null").distinct()
    clean = clean.groupBy("mix_name", "source").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.min("cap").alias("cap"))
    own = Window.partitionBy("mix_name")
    has = clean.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    can = (F.col("tokens") > 0) & (F.col("w") > 0) & (F.coalesce("cap", F.lit(1)) > 0)
    share = F.when(can, F.col("w") / F.sum(F.when(can, F.col("w"))).over(own)).otherwise(0.0)
    has = has.withColumn("share", share).withColumn("wanted_share", F.coalesce(F.try_divide("w", F.sum("w").over(own)), F.lit(0.0)))
    most = F.min(F.when(can & F.col("cap").isNotNull(), F.col("tokens") * F.col("cap") / F.col("share"))).over(own)
    every = F.sum(F.when(can, F.col("tokens"))).over(own).cast("double")
    has = has.withColumn("total", F.coalesce(most, every, F.lit(0.0)))
    if total is not None:
        has = has.withColumn("total", F.least("total", F.lit(float(total))))
    has = has.withColumn("budget", F.col("share") * F.col("total"))
    # A budget that is a whole number of repeats but for rounding is that number.
    turns = F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(0.0)
    turns = F.when(F.abs(turns - F.round(turns)) < 1e-9, F.round(turns)).otherwise(turns)
    return has.withColumn("whole", F.floor(turns)).withColumn("rest", F.when(turns > F.floor(turns), F.col("budget") - F.floor(turns) * F.col("tokens")).otherwise(0.0))


def thresholds(docs: DataFrame, wanted: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """``mix_name, source, below``: records with a hash under ``below`` hold, to within half of the record at the boundary, the tokens ``rest``. ``rows``: how many ``wanted`` has."""
    state = wanted.where("rest > 0").select("mix_name", "source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    done = None
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("h", shift)
        if level == 0:
            inside = docs.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
            counted = inside.join(bounded_broadcast(state, rows), "source")
        else:
            # Only records in some boundary bucket are looked at again.
            edge = state.select("source", "prefix").distinct()
            near = docs.withColumn("prefix", F.shiftright("h", shift + BITS)).join(bounded_broadcast(edge, rows), ["source", "prefix"])
            inside = near.groupBy("source", "prefix", bucket.alias("bucket")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
            counted = inside.join(bounded_broadcast(state, rows), ["source", "prefix"])
        line = Window.partitionBy("mix_name", "source").orderBy("bucket")  # at most 2 ** BITS rows
        summed = counted.withColumn("upto", F.sum("t").over(line)).where(F.col("upto") >= F.col("left"))
        crossing = summed.groupBy("mix_name", "source").agg(F.min(F.struct("bucket", "upto", "t", "n", "left")).alias("x")).select("mix_name", "source", "x.*")
        before = F.col("left") - (F.col("upto") - F.col("t"))
        state = scratch.put(crossing.select("mix_name", "source", before.alias("left"), F.col("bucket").alias("prefix"), "t", "n"), f"level{level}")
        # One record left (or no more bits): in, if that comes nearer to the budget.
        nearer = F.when(F.col("t") - F.col("left") <= F.col("left"), F.col("prefix") + 1).otherwise(F.col("prefix"))
        final = (F.col("n") <= 1) | F.lit(level == LEVELS - 1)
        ended = state.where(final).select("mix_name", "source", F.expr(f"shiftleft(1L, {shift})").alias("one"), nearer.alias("upto")).select("mix_name", "source", (F.col("upto") * F.col("one")).alias("below"))
        done = ended if done is None else done.unionAll(ended)
        state = state.where(~final).select("mix_name", "source", "left", "prefix")
        if state.isEmpty():
            break
    return done


def mix(docs: DataFrame, targets: DataFrame, record: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, path: str = BYTE_BPE_50K, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection ``mix_name, record, source, tokens, repeats`` and the report of the shares reached.

    * Sources are compared trimmed and in lower case; a null source belongs to no mix.
    * A null, negative or NaN weight is zero; a null ``max_repeats`` is no cap; several
      rows for one source of a mix add their weights under the smallest cap.
    * Records with a null id are left out; null and empty texts have no tokens.
    * Records with equal hashes are picked together. Empty tables give no rows.
    * Records are whole, so a source misses its budget by at most half of the record at the boundary. The report has the
      error in tokens and the longest record of the source.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    named = docs.where(F.col(f"`{record}`").isNotNull()).select(F.col(f"`{record}`").alias("id"), normal_source(F.col(f"`{source}`")).alias("source"), F.col(f"`{text}`").alias("text"))
    hashed = token_counts(named, ["id", "source"], path=path).where("source is not null")
    hashed = scratch.put(hashed.withColumn("h", F.xxhash64(F.col("id").cast("string")).bitwiseAND(F.lit((1 << (BITS * LEVELS)) - 1))), "tokens")
    sizes = hashed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))
    wanted = scratch.put(plan(targets, sizes, total), "plan")
    rows = wanted.count()
    below = thresholds(hashed, wanted, rows, scratch)
    full = wanted.join(below, ["mix_name", "source"], "left")
    joined = hashed.join(bounded_broadcast(full.select("mix_name", "source", "whole", F.coalesce("below", F.lit(0)).alias("below")), rows), "source")
    repeats = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    selection = scratch.put(joined.withColumn("repeats", repeats.cast("int")).where("repeats > 0").select("mix_name", F.col("id").alias(record), "source", "tokens", "repeats"), "selection")
    got = selection.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    reached = Window.partitionBy("mix_name")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = wanted.join(got, ["mix_name", "source"], "left").select(
        "mix_name", "source", "wanted_share", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), "budget",
        zero("actual_tokens"), (F.coalesce("actual_tokens", F.lit(0)) - F.col("budget")).alias("error_tokens"), zero("longest"), (F.coalesce("actual_tokens", F.lit(0)) / F.greatest(F.sum("actual_tokens").over(reached), F.lit(1))).alias("actual_share"), zero("documents"), zero("most_repeats"),
    )
    return selection, report

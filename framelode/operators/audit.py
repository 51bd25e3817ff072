"""Quality audits of evidence and runs, and the status queries of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions.text import reasons


def lineage_mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Of rows with the same key, the fields that differ (nulls compare as equal)."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    return joined.select(F.col(f"a.{key}"), reasons([(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields]).alias("mismatches")).where("mismatches <> ''")


def caption_verdict(text: Column, sha_ok: Column, lineage_ok: Column) -> tuple[Column, Column]:
    """PASS, REVIEW or FAIL with reasons: broken lineage and digests fail, odd lengths and cut ends are for review."""
    n = F.length(F.coalesce(text, F.lit("")))
    fails = [(~lineage_ok, "lineage_mismatch"), (~sha_ok, "sha_mismatch"), (n == 0, "empty")]
    doubts = [((n > 0) & (n < 80), "too_short"), (n > 2000, "too_long"), (text.rlike("[,，、:：(（-]\\s*$"), "cut_off")]
    bad, odd = reasons(fails), reasons(doubts)
    return F.when(bad != "", "FAIL").when(odd != "", "REVIEW").otherwise("PASS"), F.concat_ws("|", F.nullif(bad, F.lit("")), F.nullif(odd, F.lit("")))


def output_class(mismatch: Column, failed: Column, missing: Column, parsed: Column, truncated: Column) -> Column:
    return F.when(mismatch, "mismatch").when(failed, "failed").when(missing, "missing").when(~parsed, "parse_error").when(truncated, "truncated").otherwise("success")


def balanced_runs(runs: DataFrame, items: DataFrame, run: str) -> DataFrame:
    """Runs that have as many items as planned, all of them good."""
    counted = items.groupBy(run).agg(F.count("*").alias("items"), F.sum(F.col("ok").cast("int")).alias("succeeded"))
    return runs.join(counted, run).where((F.col("planned") == F.col("items")) & (F.col("succeeded") == F.col("items")))


def unique_and_present(df: DataFrame, key: str) -> DataFrame:
    """Counts that must be zero before a queue is used."""
    dup = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).agg(F.sum((F.col("n") > 1).cast("int")).alias("repeated"))
    return df.agg(F.sum(F.col(key).isNull().cast("int")).alias("missing"), F.count("*").alias("rows")).join(F.broadcast(dup))


def shares(df: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """Rows per group, their share, and how many carry each flag."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(c.cast("int")).alias(n) for n, c in flags.items()]).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def review_sample(scored: DataFrame, key: str, source: str, score: str, length: str, worst: int, longest: int, size: int) -> DataFrame:
    """The worst, the longest, the worst of each source, then the next worst, up to ``size``; each row once, by its first reason."""
    bad = scored.orderBy(F.desc(score), key).limit(worst).select(key, F.lit(1).alias("p"), F.col(score).alias("s"))
    long = scored.orderBy(F.desc(length), key).limit(longest).select(key, F.lit(2).alias("p"), F.col(score).alias("s"))
    per = scored.groupBy(source).agg(F.min(F.struct((-F.col(score)).alias("n"), F.col(key).alias("k"))).alias("x")).select(F.col("x.k").alias(key), F.lit(3).alias("p"), (-F.col("x.n")).alias("s"))
    rest = scored.orderBy(F.desc(score), key).limit(size).select(key, F.lit(4).alias("p"), F.col(score).alias("s"))
    one = bad.unionByName(long).unionByName(per).unionByName(rest).groupBy(key).agg(F.min("p").alias("reason"), F.max("s").alias("score"))
    return one.orderBy("reason", F.desc("score"), key).limit(size)

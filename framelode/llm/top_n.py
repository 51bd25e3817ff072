"""Problem 1: the N best items of every group, by descending score bands.

The score range is cut into bands at approximate quantiles and the rows are written
partitioned by band. Bands are read from the top. In each, every task first keeps its
own N best rows of a group, so a group of any size sends at most N rows a task; groups
that higher bands have filled, or that have no further rows, leave by a join before the
rows of a band are ranked, and the bands end when no group is open. The boundary band of
a group is ranked exactly by score, then by the tie column. Equal scores never straddle a cut, so ties
are always decided inside one band.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode.runtime import Scratch, bounded_broadcast

#: Quantiles of the score at which bands are cut, from the top.
CUTS = (0.9, 0.6, 0.3)
#: Open groups up to which they are sent to every worker; more are joined.
MOST_SENT = 20_000


def _same(left: DataFrame, right: DataFrame, n: int):
    return reduce(lambda a, b: a & b, [left[f"_k{i}"].eqNullSafe(right[f"_g{i}"]) for i in range(n)])


def top_n_per_group(df: DataFrame, keys: list[str], score: str, tie: str, n: int = 3, cuts_from: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``, equal scores by ascending ``tie``.

    * Null and NaN scores take no part; infinities do.
    * A null key is a group of its own; ``n`` < 1 and empty tables give no rows.
    * Rows equal in score and tie are told apart by nothing: of such repeats any may
      stand for the others, as they are the same in every ordering column.
    * Other columns, of whatever name, are carried along; the working columns start
      with ``_`` and are dropped again.

    ``cuts_from`` is a cheaper table with the same score column from which the cuts are
    estimated (they only balance the bands, they never decide a row).
    """
    spark, names = df.sparkSession, df.columns
    scratch = scratch or Scratch(spark, "top_n")
    packed = df.select(
        F.struct(*[df[f"`{c}`"] for c in names]).alias("_row"),
        *[df[f"`{k}`"].alias(f"_k{i}") for i, k in enumerate(keys)],
        df[f"`{score}`"].cast("double").alias("_s"),
        df[f"`{tie}`"].alias("_t"),
    ).where("_s is not null and not isnan(_s)")
    source = cuts_from if cuts_from is not None else df
    usable = source.select(F.col(f"`{score}`").cast("double").alias("_s")).where("_s is not null and not isnan(_s)")
    cuts = sorted(set(usable.approxQuantile("_s", list(CUTS), 0.01)), reverse=True) if n > 0 else []
    band = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        band = F.when(F.col("_s") >= cuts[i], F.lit(i)).otherwise(band)
    banded = scratch.put(packed.withColumn("_band", band), "bands", partition_by="_band")

    keys_ = [f"_k{i}" for i in range(len(keys))]
    order = Window.partitionBy(*keys_).orderBy(F.desc("_s"), F.asc("_t"))
    picked: list[DataFrame] = []
    state = None
    for b in range(len(cuts) + 1):
        rows = banded.where(F.col("_band") == b)
        if state is None:
            ranked = rows.withColumn("_kept", F.lit(0))
        else:
            # Groups that are filled, or have no rows left, go before anything is ranked or shuffled.
            open_ = state.where(F.col("_got") < F.least(F.col("_all"), F.lit(n))).select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys_)], F.col("_got").alias("_kept"))
            left = open_.count()
            if not left:
                break
            ranked = rows.join(bounded_broadcast(open_, left, MOST_SENT), _same(rows, open_, len(keys)))
        ranked = ranked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).where(F.col("_rank") + F.col("_kept") <= n)
        picked.append(scratch.put(ranked.select("_row", *keys_), f"picked{b}"))
        if b < len(cuts):
            got = picked[-1].groupBy(*keys_).agg(F.count("*").alias("_got"), F.lit(0).cast("long").alias("_all"))
            seen = banded.groupBy(*keys_).agg(F.lit(0).cast("long").alias("_got"), F.count("*").alias("_all")) if state is None else state
            before, state = state, scratch.put(got.unionAll(seen).groupBy(*keys_).agg(F.sum("_got").alias("_got"), F.sum("_all").alias("_all")), f"state{b}")
            scratch.drop(before)
    scratch.drop(banded, state)
    return reduce(DataFrame.unionAll, picked).select("_row.*")

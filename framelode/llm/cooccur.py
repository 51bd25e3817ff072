"""Problem 2: how often each two items occur in one basket, and how much more than by chance.

Items are made distinct per basket, ordered pairs are emitted and counted (combined
before the shuffle), and lift and pointwise mutual information follow from the single
counts. An item can only be in a wanted pair if it is frequent enough itself, so rarer
items leave before baskets are gathered: that bounds both the items (see ``frequent``)
and the pairs of a basket, and loses no wanted pair. Baskets of more than BLOCK items
are never gathered: their items lie in blocks, and pairs of blocks meet by a join.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelode.runtime import Scratch, bounded_broadcast

NO_LABELS = ("", "none", "null", "nan", "[]")
LONGEST_LABEL = 80
#: Items of a basket that one task expands against each other at once.
BLOCK = 64

_GAPS = re.compile(r"[\s_\-]+")


@lru_cache(maxsize=100_000)
def normal_label(label: str | None) -> str | None:
    """NFKC, lower case, runs of white space, ``_`` and ``-`` as one blank, trimmed; None if that is no label."""
    if label is None:
        return None
    text = _GAPS.sub(" ", unicodedata.normalize("NFKC", label).lower()).strip()
    return None if text in NO_LABELS or len(text) > LONGEST_LABEL else text


@F.pandas_udf(T.StringType())
def _normal(labels: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(labels, use_na_sentinel=True)
    values = [normal_label(x) for x in distinct] + [None]
    return pd.Series([values[c] for c in codes], dtype=object)


def normal_label_column(c: Column) -> Column:
    return _normal(c)


def cooccurrence(df: DataFrame, basket: str, item: str, min_count: int = 1, min_share: float = 0.0, scratch: Scratch | None = None) -> DataFrame:
    """``item_a, item_b, c, a, b, n, lift, pmi`` of every two items with ``c >= min_count`` and ``c >= min_share * n``.

    ``n`` is the number of baskets with at least one item, ``a`` and ``b`` those with
    each item, ``c`` those with both; ``item_a < item_b`` by code points (Spark orders
    strings by their UTF-8 bytes, which is the same). ``pmi`` is base 2.

    * Null baskets and null items don't count; repeated rows count once.
    * A basket of one item adds to ``n`` and to its item, but has no pair.
    * An empty table gives no rows. Other columns are never read.
    """
    scratch = scratch or Scratch(df.sparkSession, "cooccur")
    rows = df.select(F.col(f"`{basket}`").alias("u"), F.col(f"`{item}`").cast("string").alias("x")).where("u is not null and x is not null")
    items = scratch.put(rows.distinct(), "items")
    sizes = scratch.put(items.groupBy("u").agg(F.count("*").alias("size")), "sizes")
    n = sizes.count()
    least = max(1, min_count, min_share * n)
    # Items held by min_share of the baskets: at most (mean items a basket) / min_share of them.
    singles = items.groupBy("x").agg(F.count("*").alias("single")).where(F.col("single") >= least)
    frequent = scratch.put(singles.withColumn("i", F.monotonically_increasing_id()), "frequent")
    known = bounded_broadcast(frequent, frequent.count())
    coded = items.join(known.select("x", "i"), "x").select("u", "i")
    large = sizes.where(F.col("size") > BLOCK)
    large = bounded_broadcast(large, large.count())
    small = coded.join(large, "u", "left_anti").groupBy("u").agg(F.collect_list("i").alias("left")).where(F.size("left") > 1).select("left", F.col("left").alias("right"))
    # A large basket is never gathered: its items lie in blocks, whose pairs are made by a join that may be split.
    block = F.pmod(F.xxhash64("i"), F.ceil(F.col("size") / (BLOCK // 2)))
    blocks = scratch.put(coded.join(large, "u").groupBy("u", block.alias("k")).agg(F.collect_list("i").alias("xs")), "blocks")
    met = blocks.select("u", "k", F.col("xs").alias("left")).join(blocks.select("u", F.col("k").alias("m"), F.col("xs").alias("right")), "u").where("k <= m")
    of_blocks = met.select("left", "right", F.col("k") == F.col("m"))
    once = small.withColumn("same", F.lit(True)).unionAll(of_blocks).select(F.explode("left").alias("p"), "right", "same").select("p", F.explode("right").alias("q"), "same").where("p < q or (not same and p <> q)")
    pairs = once.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    both = pairs.groupBy("p", "q").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    left = known.select(F.col("i").alias("p"), F.col("x").alias("x1"), F.col("single").alias("s1"))
    right = known.select(F.col("i").alias("q"), F.col("x").alias("x2"), F.col("single").alias("s2"))
    named = both.join(left, "p").join(right, "q")
    ordered = named.select(
        F.least("x1", "x2").alias("item_a"),
        F.greatest("x1", "x2").alias("item_b"),
        "c",
        F.when(F.col("x1") < F.col("x2"), F.col("s1")).otherwise(F.col("s2")).alias("a"),
        F.when(F.col("x1") < F.col("x2"), F.col("s2")).otherwise(F.col("s1")).alias("b"),
        F.lit(n).cast("long").alias("n"),
    )
    lift = F.col("c") * F.col("n") / (F.col("a").cast("double") * F.col("b"))
    return ordered.withColumn("lift", lift).withColumn("pmi", F.log2(lift))

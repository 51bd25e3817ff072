"""De-duplication and identity of files and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_duplicates(files: DataFrame, path: str, key: str) -> DataFrame:
    """Each file with the first (smallest id) of those with its path. The minimum is combined before the shuffle."""
    first = files.groupBy(path).agg(F.min(key).alias("canonical_id"), F.count("*").alias("members"))
    return files.join(first, path).withColumn("is_alias", F.col(key) != F.col("canonical_id"))


def hash_wanted(files: DataFrame, size: str) -> DataFrame:
    """Files whose content must be hashed: those that share their size with another."""
    shared = files.groupBy(size).agg(F.count("*").alias("n")).where("n > 1").select(size)
    return files.join(shared, size, "left_semi")


def content_canonical(files: DataFrame, digest: str, relative: str, absolute: str, key: str) -> DataFrame:
    """Each file with a valid digest and the canonical file of that content: the shortest relative path, then paths and id."""
    packed = F.struct(F.length(relative).alias("n"), F.col(relative).alias("r"), F.col(absolute).alias("a"), F.col(key).alias("k"))
    first = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(packed).alias("c"), F.count("*").alias("members"))
    return files.join(first, digest).withColumn("canonical_id", F.col("c.k")).drop("c")


def dedup_role(supported: Column, path_alias: Column, content_alias: Column) -> Column:
    return F.when(~supported, "unsupported_or_blocked").when(path_alias, "path_duplicate_alias").when(content_alias, "content_duplicate_alias").otherwise("canonical")


def two_stage_identity(files: DataFrame, quick: str, full: str, path: str, key: str) -> DataFrame:
    """Quick hash first; the full hash only decides inside groups that share it. A peer without a full hash blocks the whole quick group."""
    group = files.groupBy(quick).agg(F.count("*").alias("peers"), F.sum(F.col(full).isNull().cast("int")).alias("failed"))
    depth = F.size(F.split(F.col(path), "/"))
    first = files.where(F.col(full).isNotNull()).groupBy(quick, full).agg(F.min(F.struct(depth.alias("d"), F.col(path).alias("p"), F.col(key).alias("k"))).alias("c"), F.count("*").alias("same"))
    joined = files.join(group, quick).join(first, [quick, full], "left")
    status = (
        F.when(F.col(quick).isNull(), "failed").when(F.col("peers") == 1, "unique").when(F.col("failed") > 0, "blocked_peer_failure")
        .when(F.col("same") == 1, "unique").when(F.col("c.k") == F.col(key), "canonical").otherwise("exact_duplicate")
    )
    return joined.select(key, status.alias("status"), F.when(status == "exact_duplicate", F.col("c.k")).otherwise(F.col(key)).alias("canonical_id"))


def exact_text_duplicates(docs: DataFrame, text: Column, key: str) -> DataFrame:
    """Documents whose text occurs more than once, with the digest and the number of its documents."""
    hashed = docs.select(key, F.sha2(text, 256).alias("text_sha"))
    counted = hashed.groupBy("text_sha").agg(F.count("*").alias("documents")).where("documents > 1")
    return hashed.join(counted, "text_sha")


def is_duplicate_frame(gap: Column, cos: Column, mad: Column, corr: Column, labels: Column) -> Column:
    """Exact identity aside: near in time, alike in vector or grid, and alike in labels or in both vector and grid."""
    vector = F.coalesce(cos >= 0.985, F.lit(False))
    grid = F.coalesce((mad <= 6.0) & (corr >= 0.98), F.lit(False))
    label = F.coalesce(labels >= 0.8, F.lit(False))
    return (gap <= 12_000) & (vector | grid) & (label | (vector & grid))


def is_novel(cos: Column, mad: Column, jaccard: Column) -> Column:
    return F.coalesce(cos < 0.97, F.lit(False)) | F.coalesce(mad > 10, F.lit(False)) | F.coalesce(jaccard < 0.60, F.lit(False))


def cluster_confidence(members: Column, sources: Column, confirmed: Column) -> Column:
    return F.when(members == 1, "singleton").when((sources >= 2) | confirmed, "high").otherwise("review")


def reliable_cluster(members: Column, sources: Column, high: Column, confirmed: Column) -> Column:
    return (members > 1) & ((sources >= 2) | confirmed) & (high | confirmed)


def policy_verdict(total: Column, covered: Column, duplicates: Column, leaks: Column) -> Column:
    """FAIL on leaks, REVIEW on low coverage or many duplicates, else PASS."""
    return F.when(leaks > 0, "FAIL").when((covered < 0.95 * total) | (duplicates > 0.8 * total), "REVIEW").otherwise("PASS")


def similar_pairs(items: DataFrame, key: str, vector: str, least: float, unit: str | None = None, planes: int = 10, tables: int = 16) -> DataFrame:
    """Pairs of items with cosine of at least ``least``, found among items that share a random-hyperplane bucket.

    Each of ``tables`` tables cuts the space by ``planes`` fixed planes, so only items of one bucket meet. Pairs are
    checked exactly; a pair is missed only if no table puts both in one bucket. Of pairs at cosine c a share of
    1 - (1 - (1 - acos(c) / pi) ** planes) ** tables is found: 0.98 at 0.9 and 0.91 at 0.85 as it is set. ``scan_queries`` is exact.
    """
    from framelode.functions import vectors

    size = F.size(vector)
    sign = lambda t, p: F.aggregate(F.transform(F.col(vector), lambda x, i: F.when(F.pmod(F.xxhash64(i, F.lit(t * 1000 + p)), F.lit(2)) == 0, x.cast("double")).otherwise(-x.cast("double"))), F.lit(0.0), lambda s, x: s + x) >= 0
    code = F.transform(F.array(*[F.concat_ws("", *[sign(t, p).cast("int").cast("string") for p in range(planes)]) for t in range(tables)]), lambda c, i: F.concat_ws(":", i, c))
    own = [F.col(key).alias("k"), F.col(vector).alias("v"), F.col(unit or key).alias("u")]
    coded = items.where(size > 0).select(*own, F.explode(code).alias("b"))
    a, b = coded.alias("a"), coded.alias("b")
    on = (F.col("a.b") == F.col("b.b")) & (F.col("a.k") < F.col("b.k"))
    if unit:
        on = on & (F.col("a.u") != F.col("b.u"))
    met = a.join(b, on).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.col("a.v").alias("va"), F.col("b.v").alias("vb")).dropDuplicates(["a", "b"])
    return met.withColumn("similarity", vectors.cosine(F.col("va"), F.col("vb"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


#: Queries that meet every item in one pass.
QUERY_BLOCK = 1000


def scan_queries(items: DataFrame, queries: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """``query, item, similarity`` of at least ``least``: a stated set of queries against all items, exact.

    Queries come in blocks of QUERY_BLOCK, each multiplied with the items where they lie; items are never shuffled.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    kind = items.schema[key].dataType.simpleString()
    out, last = None, None
    while True:
        ordered = queries.where(F.col(key).isNotNull() & (F.size(vector) > 0)) if last is None else queries.where((F.col(key) > last) & (F.size(vector) > 0))
        block = ordered.select(key, vector).orderBy(key).limit(QUERY_BLOCK).collect()
        if not block:
            break
        last = block[-1][0]
        ids, q = [r[0] for r in block], np.array([r[1] for r in block], dtype=float)
        shared = items.sparkSession.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def meet(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, known = shared.value
            for rows in batches:
                rows = rows[rows["v"].map(lambda x: x is not None and len(x) == known.shape[1])]
                if not len(rows):
                    continue
                v = np.array(rows["v"].tolist(), dtype=float)
                scores = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)) @ known.T
                i, j = np.nonzero(scores >= least)
                if len(i):
                    yield pd.DataFrame({"query": [names[x] for x in j], "item": rows["k"].to_numpy()[i], "similarity": scores[i, j]})

        found = items.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(meet, f"query {kind}, item {kind}, similarity double")
        out = found if out is None else out.unionAll(found)
        if len(block) < QUERY_BLOCK:
            break
    if out is None:
        out = items.limit(0).select(F.col(key).alias("query"), F.col(key).alias("item"), F.lit(0.0).alias("similarity"))
    return out

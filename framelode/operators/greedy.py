"""Operators whose decisions depend on what was already chosen: grouped Arrow functions.

Order is set inside the function; nothing relies on how rows arrive. Where a decision
only looks a bounded time away, a source is cut at longer gaps: its stretches decide
for themselves, so a source of any length is many groups. Rules that look at a whole
source (``time_coverage``, ``spaced_representatives``) take one source a task, in time
that grows like a sort.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode.operators import windows
from framelode.runtime import spread


def _grouped(df: DataFrame, keys: list[str], choose: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Groups lie in as many tasks as there are cores, however small they are: the work is in the function, not in the bytes."""
    return spread(df, *keys).groupBy(*keys).applyInPandas(lambda g: choose(g)[[c.strip().split(" ")[0] for c in schema.split(",")]], schema)


#: Rows of a source from which it is cut at its next long gap.
PART_ROWS = 500


def _stretches(df: DataFrame, source: str, time: str, reach: int) -> DataFrame:
    """``df`` with ``_stretch``: a source is cut only between rows more than ``reach`` apart, and only into parts of about PART_ROWS or more rows."""
    w = windows.in_source(source, time)
    begins = F.coalesce(F.col(time) - F.lag(time).over(w) > reach, F.lit(True))
    placed = df.withColumn("_b", begins).withColumn("_r", F.row_number().over(w))
    start = F.max(F.when(F.col("_b"), F.col("_r"))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_stretch", F.floor(start / PART_ROWS)).drop("_b", "_r")


def _first(df: DataFrame, source: str, order: list[tuple[str, bool]], cap: int) -> DataFrame:
    """The first ``cap`` rows of each source; each task keeps that many before the shuffle."""
    by = [F.asc(c) if up else F.desc(c) for c, up in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(*by))).where(F.col("_n") <= cap).drop("_n")


def keep_apart(df: DataFrame, source: str, time: str, order: list[tuple[str, bool]], gap: int, schema: str, cap: int | None = None) -> DataFrame:
    """In the given order (column, ascending), keep a row unless it lies less than ``gap`` from any row kept before.

    A gap of 0 keeps all. ``cap`` bounds the rows kept of a source: the first in the same order. Kept times stay sorted, so a row is tested against its two neighbours.
    """

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([c for c, _ in order], ascending=[a for _, a in order], kind="stable")
        kept: list[int] = []
        flags = []
        for t in g[time].tolist():
            i = bisect_left(kept, t)
            near = gap > 0 and ((i < len(kept) and kept[i] - t < gap) or (i > 0 and t - kept[i - 1] < gap))
            if not near:
                insort(kept, t)
            flags.append(not near)
        return g[flags]

    if cap is None:
        return _grouped(_stretches(df, source, time, gap - 1), [source, "_stretch"], choose, schema)
    full = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return _first(_grouped(_stretches(df, source, time, gap - 1), [source, "_stretch"], choose, full), source, order, cap).select(names)


def better_of_near(df: DataFrame, source: str, time: str, score: str, tie: str, gap: int, schema: str) -> DataFrame:
    """In time order, compare each row with the last one kept only; of two closer than ``gap`` the better score stays."""

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([time, tie], kind="stable").reset_index(drop=True)
        times, scores = g[time].tolist(), g[score].tolist()
        kept: list[int] = []
        for i, t in enumerate(times):
            if kept and t - times[kept[-1]] < gap:
                if scores[i] > scores[kept[-1]]:
                    kept[-1] = i
            else:
                kept.append(i)
        return g.iloc[kept]

    return _grouped(_stretches(df, source, time, gap - 1), [source, "_stretch"], choose, schema)


def time_coverage(df: DataFrame, source: str, time: str, tie: str, every: int, most: int, schema: str) -> DataFrame:
    """The first row, the row nearest to each further anchor ``every`` apart, then the middle of each gap over ``most`` until none is left.

    A gap is filled by the inner row nearest to its middle, which leaves two smaller ones; gaps don't touch each other, so their order says nothing.
    """

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([time, tie], kind="stable").reset_index(drop=True)
        t = g[time].to_numpy(np.int64)
        n = len(t)

        def nearest(at: np.ndarray) -> np.ndarray:
            """The first row nearest to each time."""
            after = np.clip(np.searchsorted(t, at), 0, n - 1)
            before = np.clip(after - 1, 0, n - 1)
            best = np.where(np.abs(t[before] - at) <= np.abs(t[after] - at), t[before], t[after])
            return np.searchsorted(t, best)

        chosen = {0}
        if n > 1:
            if t[-1] - t[0] <= every:
                chosen.add(n - 1)
            else:
                chosen.update(nearest(np.arange(int(t[0]) + every, int(t[-1]) + 1, every)).tolist())
            at = sorted(chosen)
            times = t.tolist()
            gaps = list(zip(at, at[1:], strict=False)) if most > 0 else []
            while gaps:
                a, b = gaps.pop()
                if times[b] - times[a] <= most:
                    continue
                low, high = bisect_right(times, times[a]), bisect_left(times, times[b])
                if low >= high:
                    continue
                aim = (times[a] + times[b]) // 2
                after = min(bisect_left(times, aim, low, high), high - 1)
                before = max(after - 1, low)
                best = times[before] if abs(times[before] - aim) <= abs(times[after] - aim) else times[after]
                middle = bisect_left(times, best, low, high)
                chosen.add(middle)
                gaps += [(a, middle), (middle, b)]
        return g.iloc[sorted(chosen)]

    return _grouped(df, [source], choose, schema)


def spaced_representatives(df: DataFrame, source: str, time: str, tie: str, budget: str, gap: int, schema: str) -> DataFrame:
    """For each of ``budget`` anchors from start to end, the nearest row at least ``gap`` from those chosen."""

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([time, tie], kind="stable").reset_index(drop=True)
        t, n = g[time].tolist(), int(g[budget].iloc[0])
        if n <= 0:
            return g.iloc[:0]
        if n == 1:
            return g.iloc[[len(g) // 2]]
        taken: list[int] = []  # times chosen, in order
        chosen: list[int] = []

        def free(x: int) -> bool:
            i = bisect_left(taken, x)
            return (i == len(taken) or taken[i] - x >= gap) and (i == 0 or x - taken[i - 1] >= gap)

        for i in range(n):
            anchor = round(t[0] + (t[-1] - t[0]) * i / (n - 1))
            high = bisect_left(t, anchor)
            low = high - 1
            while low >= 0 or high < len(t):
                # Outwards from the anchor, at equal distances the earlier row; of rows at one time the first.
                if low >= 0 and (high >= len(t) or anchor - t[low] <= t[high] - anchor):
                    j = bisect_left(t, t[low])
                    low = j - 1
                else:
                    j = high
                    high = bisect_left(t, t[high] + 1)
                if free(t[j]):
                    insort(taken, t[j])
                    chosen.append(j)
                    break
        return g.iloc[sorted(chosen)]

    return _grouped(df, [source], choose, schema)


def leaders(df: DataFrame, source: str, schema: str, order: list[tuple[str, bool]], same: Callable[[dict, dict], np.ndarray], key: str, time: str | None = None, reach: int = 0) -> DataFrame:
    """Each row joins the first leader it is the same as, or becomes one. Adds ``leader``. ``same`` compares a row with arrays of leaders.

    With ``time``, rows more than ``reach`` apart are never the same, and a source is cut at longer gaps.
    """

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([c for c, _ in order], ascending=[a for _, a in order], kind="stable").reset_index(drop=True)
        values = {c: g[c].to_numpy() for c in g.columns}
        heads = {c: np.empty_like(v) for c, v in values.items()}
        found: list[int] = []
        leader = []
        for i in range(len(g)):
            row, n = {c: v[i] for c, v in values.items()}, len(found)
            hits = np.flatnonzero(same(row, {c: v[:n] for c, v in heads.items()})) if n else ()
            if not len(hits):
                for c, x in row.items():
                    heads[c][n] = x
                found.append(i)
            leader.append(found[hits[0]] if len(hits) else i)
        return g.assign(leader=values[key][leader])

    return _grouped(_stretches(df, source, time, reach), [source, "_stretch"], choose, schema) if time else _grouped(df, [source], choose, schema)


def novel_first(df: DataFrame, source: str, schema: str, order: list[tuple[str, bool]], duplicate: Callable[[dict, dict], np.ndarray], cap: int, time: str, reach: int) -> DataFrame:
    """In order, keep up to ``cap`` rows of a source that duplicate none kept before.

    Rows more than ``reach`` apart never duplicate each other, so a source is cut at longer gaps; what a stretch keeps doesn't
    depend on the cap, which then takes the first of all that are kept.
    """

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([c for c, _ in order], ascending=[a for _, a in order], kind="stable").reset_index(drop=True)
        values = {c: g[c].to_numpy() for c in g.columns}
        kept: list[int] = []
        for i in range(len(g)):
            if len(kept) == cap:
                break
            if not kept or not duplicate({c: v[i] for c, v in values.items()}, {c: v[kept] for c, v in values.items()}).any():
                kept.append(i)
        return g.iloc[kept]

    full = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return _first(_grouped(_stretches(df, source, time, reach), [source, "_stretch"], choose, full), source, order, cap).select(names)


def constrained_clusters(nodes: DataFrame, component: str, id: str, unit: str, vector: str, least: float) -> DataFrame:
    """Merge the pairs of one component from the most similar on, if no unit occurs in both clusters and their centroids are similar.

    Returns ``id, cluster, similarity``: the cluster's smallest id, and the cosine to its representative, the member nearest to the centroid.
    Merges only happen along edges of at least ``least``, so components of the edge graph are independent.
    """

    def cosine(a: np.ndarray, b: np.ndarray) -> float:
        n = float(np.linalg.norm(a) * np.linalg.norm(b))
        return float(a @ b) / n if n else 0.0

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(id, kind="stable").reset_index(drop=True)
        v = np.array(g[vector].tolist(), dtype=float)
        unitized = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        scores = unitized @ unitized.T
        at = [(-scores[i, j], i, j) for i in range(len(g)) for j in range(i + 1, len(g)) if scores[i, j] >= least]
        group = list(range(len(g)))
        members = {i: [i] for i in range(len(g))}
        for _, i, j in sorted(at):
            a, b = sorted((group[i], group[j]))
            if a == b or set(g[unit][members[a]]) & set(g[unit][members[b]]):
                continue
            if cosine(unitized[members[a]].mean(axis=0), unitized[members[b]].mean(axis=0)) < least:
                continue
            for k in members[b]:
                group[k] = a
            members[a] += members.pop(b)
        similarity = np.ones(len(g))
        for own in members.values():
            center = unitized[own].mean(axis=0)
            best = max(own, key=lambda k: (cosine(unitized[k], center), -k))
            for k in own:
                similarity[k] = scores[k, best]
        return pd.DataFrame({id: g[id], "cluster": [g[id][k] for k in group], "similarity": np.round(similarity, 6)})

    kind = nodes.schema[id].dataType.simpleString()
    return nodes.groupBy(component).applyInPandas(choose, f"{id} {kind}, cluster {kind}, similarity double")

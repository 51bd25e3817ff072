"""Problem 3: one surviving record for each group of duplicates, by skyline selection.

Records of a group are compared in trust, completeness and recency. The skyline is the
set of records that no other record of the group equals or exceeds in all three and
exceeds in one. The survivor is its first record by the lexicographic policy (trust,
completeness, recency, smallest id). Its unfilled fields are then filled from the
skyline, from the skyline of what remains without it, and so on, or, where the policy
says so of a field, from the most recent record that has it.

Trust and completeness have few values, so a group's skyline lies among the newest
records of each (trust, completeness) cell, and the first record to fill a field is the
newest that does so in its cell. These are combined before the shuffle; a group with any
number of records is never gathered in one task.

A field that the skyline leaves open needs the layers of its candidates. A record's layer
is one more than the last layer among those that dominate it, so from the newest record
on, the last layer so far of each cell is all that must be known. Each record changes it
by a map that is linear over (max, +); such maps compose. A group is therefore cut into
ranges of time, each range composes its own maps, and the ranges are put together after.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.functions.hashing import valid_hash
from framelode.llm.cleaning import latest, strip
from framelode.runtime import Scratch

#: Stands for "no chain" in a map.
_NONE = -(1 << 40)


def filled(c: Column) -> Column:
    """False for null, blank and ``[]``."""
    text = F.regexp_replace(c.cast("string"), r"(?U)[\s\x1c-\x1f]+", "")
    return F.coalesce(~text.isin("", "[]"), F.lit(False))


@dataclass(frozen=True)
class Policy:
    """What a group is, what to prefer, which fields count as completeness and are filled, and which of them by recency alone."""

    group: str
    record: str
    trust: Column
    recency: Column
    fields: tuple[str, ...]
    recent: tuple[str, ...] = ()


def _cells(rows: DataFrame, n: int) -> DataFrame:
    """A row per group of two or more: its cells, each with its newest point, the smallest id there, and for each field the newest record that fills it (of these the smallest id)."""
    first = lambda *more: F.min(F.struct("ago", "id", *more))
    cell = rows.groupBy("g", "t", "c").agg(F.count("*").alias("n"), first().alias("h"), *[F.min(F.when(F.col(f"v{i}").isNotNull(), F.struct("ago", "id", F.col(f"v{i}").alias("v")))).alias(f"w{i}") for i in range(n)])
    packed = F.struct((-F.col("t")).alias("t"), (-F.col("c")).alias("c"), F.col("h.ago").alias("ago"), F.col("h.id").alias("id"), *[f"w{i}" for i in range(n)])
    return cell.groupBy("g").agg(F.sum("n").alias("members"), F.sort_array(F.collect_list(packed)).alias("cells")).where("members > 1")


def _beats(y: Column, x: Column) -> Column:
    """Trust, completeness and time are turned round, so less is better."""
    at_least = (y["t"] <= x["t"]) & (y["c"] <= x["c"]) & (y["ago"] <= x["ago"])
    return at_least & ((y["t"] < x["t"]) | (y["c"] < x["c"]) | (y["ago"] < x["ago"]))


def _layers(points: DataFrame, cells: list[tuple[int, int]], scratch: Scratch) -> DataFrame:
    """``g, t, c, ago, layer`` of the points that are ``asked`` for among the distinct points of their groups.

    Points are sorted by group, from the newest on, better cells first at equal times, in ranges. Where a range begins
    inside a group, layers are kept as maps of the state with which the group enters it: for each cell the last layer there.
    """
    size, index = len(cells), {cell: i for i, cell in enumerate(cells)}
    better = [[j for j, (t, c) in enumerate(cells) if t >= own[0] and c >= own[1]] for own in cells]
    kind = points.schema["g"].dataType.simpleString()
    schema = f"g {kind}, t int, c int, ago long, layer array<long>, chunk int, begins boolean"

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        chunk, group, state, entered = TaskContext.get().partitionId(), None, None, True
        unit = np.where(np.eye(size, dtype=bool), 0, _NONE).astype(np.int64)

        def frame(out: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["g", "t", "c", "ago", "layer", "chunk", "begins"])
            return made.astype({"t": "Int32", "c": "Int32", "ago": "Int64", "chunk": "Int32", "begins": "boolean"})

        def edge() -> tuple:
            return group, None, None, None, state.ravel().tolist(), chunk, not entered

        for rows in batches:
            out = []
            for g, t, c, ago, asked in zip(rows["g"], rows["t"], rows["c"], rows["ago"], rows["asked"], strict=True):
                if state is None:
                    group, state = g, unit.copy()
                elif g != group:
                    if entered:
                        out.append(edge())
                    group, state, entered = g, np.zeros((size, 1), np.int64), False
                i = index[t, c]
                state[i] = 1 + state[better[i]].max(axis=0)
                if asked:
                    out.append((g, t, c, ago, state[i].tolist(), chunk if entered else None, None))
            if out:
                yield frame(out)
        if state is not None:
            yield frame([edge()])

    def enter(rows: pd.DataFrame) -> pd.DataFrame:
        """The state with which a group enters each of its ranges; one row a range comes in."""
        state, out = np.zeros(size, np.int64), []
        for chunk, begins, made in sorted(zip(rows["chunk"], rows["begins"], rows["layer"], strict=True), key=lambda x: x[0]):
            made = np.asarray(made, np.int64)
            if not begins:
                out.append((rows["g"].iloc[0], chunk, state.tolist()))
                made = (made.reshape(size, size) + state).max(axis=1)
            state = made
        return pd.DataFrame(out, columns=["g", "chunk", "state"])

    order = [F.col("g"), F.col("ago"), F.desc("t"), F.desc("c")]
    found = scratch.put(points.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(number, schema), "numbered")
    states = found.where("begins is not null").select("g", "chunk", "layer", "begins").groupBy("g").applyInPandas(enter, f"g {kind}, chunk int, state array<long>")
    inside = found.where("begins is null and chunk is null").select("g", "t", "c", "ago", F.col("layer")[0].alias("layer"))
    across = found.where("begins is null and chunk is not null").join(states, ["g", "chunk"])
    return inside.unionAll(across.select("g", "t", "c", "ago", F.array_max(F.zip_with("layer", "state", lambda a, b: a + b)).alias("layer")))


def survivors(df: DataFrame, policy: Policy, scratch: Scratch | None = None) -> DataFrame:
    """``group, survivor, members`` and, for each field, its value and the record it came from (``<field>_from``).

    One row for each group of two or more records.

    * Records with a null group or id are left out; repeated ids are cleaned up before.
    * A null recency is the earliest; a null trust the lowest. Null, blank and ``[]``
      fields are not filled; a field that no member fills is null, as is its source.
    * Of records equal in trust, completeness and recency the smallest id comes first.
    * The survivor's own filled fields stay; others are taken from the first dominance
      layer that fills them, within a layer by the policy. A field in ``policy.recent``
      is that of the most recent record that fills it (then of the smallest id).
    * An empty table gives no rows. Working columns don't clash with the table's.
    """
    scratch = scratch or Scratch(df.sparkSession, "survivors")
    n = len(policy.fields)
    values = [F.when(filled(F.col(f"`{f}`")), F.col(f"`{f}`").cast("string")) for f in policy.fields]
    at = F.coalesce(F.unix_micros(policy.recency.cast("timestamp")), F.lit(-(1 << 62)))
    rows = df.select(
        F.col(f"`{policy.group}`").alias("g"), F.col(f"`{policy.record}`").cast("string").alias("id"), F.coalesce(policy.trust.cast("int"), F.lit(-1)).alias("t"),
        (-at).alias("ago"), *[v.alias(f"v{i}") for i, v in enumerate(values)],
    ).where("g is not null and id is not null")
    rows = rows.withColumn("c", sum((F.col(f"v{i}").isNotNull().cast("int") for i in range(n)), F.lit(0)))
    layered = [i for i, f in enumerate(policy.fields) if f not in policy.recent]
    if layered:
        rows = scratch.put(rows, "records")

    filler = [f"w{i}" for i in range(n)]
    state = _cells(rows, n).withColumn("front", F.filter("cells", lambda x: ~F.exists("cells", lambda y: _beats(y, x)))).withColumn("survivor", F.col("front")[0]["id"])

    def of_front(w: str) -> Column:
        """The survivor's own, else that of the first record of its layer: a cell's filler is in the layer if it is at the cell's newest time."""
        own = F.get(F.filter("front", lambda x: x[w]["id"] == F.col("survivor")), 0)[w]
        return F.coalesce(own, F.get(F.filter("front", lambda x: x[w]["ago"] == x["ago"]), 0)[w])

    def newest(w: str) -> Column:
        return F.array_min(F.transform("cells", lambda x: x[w]))

    for i, w in enumerate(filler):
        state = state.withColumn(f"f{i}", of_front(w) if i in layered else newest(w))
    out = [F.col("g").alias(policy.group), "survivor", "members"]
    for i, f in enumerate(policy.fields):
        out += [F.col(f"f{i}.v").alias(f), F.col(f"f{i}.id").alias(f"{f}_from")]
    if not layered:
        return state.select(*out)

    def candidates(i: int, w: str) -> Column:
        """Of every cell the newest record that fills an open field."""
        found = F.transform(F.filter("cells", lambda x: x[w].isNotNull()), lambda x: F.struct(F.lit(i).alias("i"), (-x["t"]).alias("t"), (-x["c"]).alias("c"), x[w].alias("w")))
        return F.when(F.col(f"f{i}").isNull(), found).otherwise(F.filter(found, lambda x: F.lit(False)))

    wanted = F.concat(*[candidates(i, filler[i]) for i in layered])
    state = scratch.put(state.select("g", "survivor", "members", *[f"f{i}" for i in range(n)], wanted.alias("wanted")), "skyline")
    asked = scratch.put(state.where(F.size("wanted") > 0).select("g", F.explode("wanted").alias("x")).select("g", "x.i", "x.t", "x.c", F.col("x.w.ago").alias("ago"), "x.w"), "open")
    if asked.isEmpty():
        return state.select(*out)
    known = rows.join(asked.select("g").distinct(), "g", "left_semi").select("g", "t", "c", "ago", F.lit(False).alias("asked"))
    points = known.unionAll(asked.select("g", "t", "c", "ago", F.lit(True))).groupBy("g", "t", "c", "ago").agg(F.max("asked").alias("asked"))
    cells = sorted((x["t"], x["c"]) for x in rows.select("t", "c").distinct().collect())  # as many as trust and completeness have values
    layers = _layers(points, cells, scratch)
    rank = F.struct("layer", (-F.col("t")).alias("t"), (-F.col("c")).alias("c"), "ago", F.col("w.id"))
    best = asked.join(layers, ["g", "t", "c", "ago"]).groupBy("g").agg(*[F.min_by("w", F.when(F.col("i") == i, rank)).alias(f"n{i}") for i in layered])
    filled_in = [F.coalesce(f"f{i}", f"n{i}").alias(f"f{i}") if i in layered else F.col(f"f{i}") for i in range(n)]
    return state.join(best, "g", "left").select("g", "survivor", "members", *filled_in).select(*out)


HASH_FIELDS = ("size_bytes", "mtime_ns", "ctime_ns", "stem_key", "finder_tags_json")


def content_files(files: DataFrame) -> DataFrame:
    """Each file once, by its row with the latest updated_at, with ``content_hash``: its own, or that of the file its canonical id names.

    Blocked files take no part, but lend their hash to files that name them. The lookup
    has unique ids on one side; an id that very many files name is split by the skew
    join of adaptive execution.
    """
    names = ["source_file_id", "role", "own", "names", *HASH_FIELDS, "updated_at"]
    payload = [strip(F.col("source_file_id")), F.lower(strip(F.col("dedup_role"))), valid_hash(F.col("content_sha256")), strip(F.col("canonical_source_file_id")), *[F.col(f) for f in HASH_FIELDS], F.col("updated_at")]
    keyed = files.withColumn("_key", strip(F.col("source_file_id")))
    return latest(keyed, "_key", F.col("updated_at"), payload, names).select(names)


def content_groups(files: DataFrame, scratch: Scratch) -> DataFrame:
    every = scratch.put(content_files(files), "files")
    lent = every.where("own is not null").select(F.col("source_file_id").alias("names"), F.col("own").alias("lent"))
    part = every.where("role is null or role <> 'unsupported_or_blocked'")
    hashed = part.where("own is not null").withColumn("lent", F.col("own"))
    named = part.where("own is null").join(lent, "names").select(*hashed.columns)
    return hashed.unionAll(named).withColumnRenamed("lent", "content_hash")


def content_policy(recent: tuple[str, ...] = ()) -> Policy:
    return Policy("content_hash", "source_file_id", F.when(F.col("role") == "canonical", 1).otherwise(0), F.col("updated_at"), HASH_FIELDS, recent)

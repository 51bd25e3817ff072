"""Problem 6: runs of identical or nearly identical consecutive events, collapsed to one event each.

Rows are range-partitioned and sorted by group, order and id, so even one huge group is
cut into chunks. Every chunk encodes its runs locally. A run summary (first and last
event, count, ends) is associative, so only the first and last run of each chunk can
still join a neighbour: those summaries, at most two a chunk, are merged by a tree over
the chunks, a bounded number of neighbours a task and level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelode.runtime import Scratch

_FIELDS = ["first_id", "last_id", "start_at", "end_at", "frames", "low", "high"]


def _summaries(gap: int):
    """Local runs of the sorted rows of one chunk; a run that is cut by the end of a batch is carried on."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry, number = None, 0
        chunk = None
        for rows in batches:
            if not len(rows):
                continue
            if chunk is None:
                from pyspark import TaskContext

                chunk = TaskContext.get().partitionId()
            group, lo, hi, at, ids = rows["g"].to_numpy(), rows["lo"].to_numpy(), rows["hi"].to_numpy(), rows["at"].to_numpy(), rows["id"].to_numpy()
            new = np.empty(len(rows), dtype=bool)
            new[0] = True
            new[1:] = (group[1:] != group[:-1]) | (np.abs(lo[1:] - lo[:-1]) > gap) | (np.abs(hi[1:] - hi[:-1]) > gap)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(rows)) - 1
            out = pd.DataFrame({
                "g": group[first], "first_id": ids[first], "last_id": ids[last], "start_at": at[first], "end_at": at[last], "frames": last - first + 1,
                "low": np.minimum.reduceat(lo, first), "high": np.maximum.reduceat(hi, first), "lo1": lo[first], "hi1": hi[first], "lo2": lo[last], "hi2": hi[last],
            })
            if carry is not None:
                a, b = carry.iloc[0], out.iloc[0]
                if a["g"] == b["g"] and abs(a["lo2"] - b["lo1"]) <= gap and abs(a["hi2"] - b["hi1"]) <= gap:
                    for name in ("first_id", "start_at", "lo1", "hi1"):
                        out.loc[0, name] = a[name]
                    out.loc[0, "frames"] = a["frames"] + b["frames"]
                    out.loc[0, "low"], out.loc[0, "high"] = min(a["low"], b["low"]), max(a["high"], b["high"])
                else:
                    out = pd.concat([carry, out], ignore_index=True)
            done, carry = out.iloc[:-1], out.iloc[-1:].reset_index(drop=True)
            if len(done):
                yield done.assign(chunk=chunk, number=np.arange(number, number + len(done)), edge=np.arange(number, number + len(done)) == 0)
                number += len(done)
        if carry is not None:
            yield carry.assign(chunk=chunk, number=number, edge=True)

    return encode


#: Chunks (or stretches of chunks) that one task merges.
FAN_IN = 256
_SUMMARY = "g string, first_id string, last_id string, start_at long, end_at long, frames long, low long, high long, lo1 long, hi1 long, lo2 long, hi2 long, chunk int, number long, edge boolean"


def _merged(local: DataFrame, gap: int, scratch: Scratch) -> DataFrame:
    """The runs at the ends of chunks, merged across chunks by a tree: FAN_IN neighbouring stretches become one, whose own first and last run stay open."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["chunk", "number"], kind="stable")
        out: list[dict] = []
        at = None
        for row in rows.to_dict("records"):
            last = out[-1] if out else None
            if last is not None and at != row["chunk"] and last["g"] == row["g"] and abs(row["lo1"] - last["lo2"]) <= gap and abs(row["hi1"] - last["hi2"]) <= gap:
                last |= {name: row[name] for name in ("last_id", "end_at", "lo2", "hi2")}
                last |= {"frames": last["frames"] + row["frames"], "low": min(last["low"], row["low"]), "high": max(last["high"], row["high"])}
            else:
                out.append(row)
            at = row["chunk"]
        for i, row in enumerate(out):
            row |= {"chunk": row["chunk"] // FAN_IN, "number": i, "edge": i in (0, len(out) - 1)}
        for row in out:
            row["chunk"] = out[0]["chunk"]
        return pd.DataFrame(out, columns=rows.columns)

    names = [f.name for f in T._parse_datatype_string(_SUMMARY)]
    edges, done = local.where("edge").select(names), []
    last = edges.agg(F.max("chunk")).first()[0] or 0
    while True:
        level = scratch.put(edges.groupBy(F.floor(F.col("chunk") / FAN_IN)).applyInPandas(merge, _SUMMARY), "merged")
        if last < FAN_IN:
            return reduce(DataFrame.unionAll, [*done, level])
        done.append(level.where("not edge"))
        edges, last = level.where("edge"), last // FAN_IN


def runs(df: DataFrame, keys: list[str], at: str, tie: str, low: str, high: str, gap: int = 250, scratch: Scratch | None = None) -> DataFrame:
    """``*keys, first_id, last_id, start_at, end_at, frames, low, high, duration_ms`` of each run (of one event or more).

    Events are ordered by ``at``, then ``tie``; one continues the run before it if both
    bounds differ from that event's by at most ``gap``.

    * Events with null keys, null ``tie`` or a null or negative ``at`` are left out.
    * A null or negative bound stands for ``at``; then swapped bounds are put in order.
    * Repeated rows are events of their own (clean up first where they aren't).
    * An empty table gives no rows. Other columns are never read.
    """
    scratch = scratch or Scratch(df.sparkSession, "runs")
    when = F.col(f"`{at}`").cast("long")
    bound = lambda c: F.when(F.col(f"`{c}`") >= 0, F.col(f"`{c}`").cast("long")).otherwise(when)
    rows = df.select(F.struct(*[F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(keys)]).alias("g"), when.alias("at"), F.col(f"`{tie}`").cast("string").alias("id"), bound(low).alias("b1"), bound(high).alias("b2"))
    whole = " and ".join(["at >= 0", "id is not null", *[f"g.k{i} is not null" for i in range(len(keys))]])
    rows = scratch.put(rows.where(whole).select("g", "at", "id", F.least("b1", "b2").alias("lo"), F.greatest("b1", "b2").alias("hi")), "events")
    order = ["g", "at", "id"]
    flat = F.to_json("g").alias("g")
    chunks = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(flat, "at", "id", "lo", "hi").mapInPandas(_summaries(gap), _SUMMARY)
    local = scratch.put(chunks, "summaries")
    scratch.drop(rows)

    merged = _merged(local, gap, scratch)
    every = local.where("not edge").select("g", *_FIELDS).unionAll(merged.select("g", *_FIELDS))
    key = T.StructType([T.StructField(f"k{i}", T.StringType()) for i in range(len(keys))])
    parsed = every.withColumn("g", F.from_json("g", key))
    return parsed.select(*[F.col(f"g.k{i}").alias(k) for i, k in enumerate(keys)], *_FIELDS, (F.col("end_at") - F.col("start_at")).alias("duration_ms"))

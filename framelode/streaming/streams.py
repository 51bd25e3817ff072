"""Structured Streaming counterparts: windows, sessions, greedy spacing, and exactly-once batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, time: str, key: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide or width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def spaced(events: DataFrame, key: str, id: str, ms: str, gap: int) -> DataFrame:
    """Keep an event unless it lies less than ``gap`` after the last one kept of its key; the state is that one time."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ms, id])
        kept = []
        for i, t in zip(rows[id], rows[ms], strict=True):
            if last is None or t - last >= gap:
                kept.append((k[0], i, t))
                last = t
        if last is not None:
            state.update((last,))
        if kept:
            yield pd.DataFrame(kept, columns=[key, id, ms])

    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id, ms)}
    schema = f"{key} {kinds[key]}, {id} {kinds[id]}, {ms} {kinds[ms]}"
    return events.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """Each batch goes to its own folder, so a batch that is run again replaces itself; reads what is there, then stops."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_latest(stream: DataFrame, path: str, checkpoint: str):
    """The whole result so far replaces the one before, batch by batch; reads what is there, then stops."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

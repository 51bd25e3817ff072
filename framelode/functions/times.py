"""Times on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd_HHmmss")


def timecode(ms: Column, millis: bool = False) -> Column:
    """MM:SS or HH:MM:SS, with .mmm if wanted; ``--:--`` for negative and missing times."""
    s = F.floor(ms / 1000)
    h, m, sec = F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60)).cast("int")
    text = F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%02d:%02d", m, sec))
    if millis:
        text = F.concat(text, F.format_string(".%03d", F.pmod(ms, F.lit(1000)).cast("int")))
    return F.when(ms >= 0, text).otherwise("--:--")


def parse_any(c: Column) -> Column:
    """The first of FORMATS that fits, sub-seconds dropped; null if none does."""
    plain = F.regexp_replace(F.trim(c), r"\.\d+$", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS])


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def preview_segment(t: Column, window: int = 5000, lead: int = 2000) -> tuple[Column, Column]:
    start = F.greatest(F.lit(0), t - lead)
    return start, start + window


def search_segment(t: Column, low: Column, high: Column, reach: int = 10_000) -> tuple[Column, Column]:
    """``reach`` to either side, clipped to the bounds."""
    return F.greatest(t - reach, low, F.lit(0)), F.least(t + reach, F.coalesce(high, t + reach))


def eta_seconds(elapsed: Column, done: Column, total: Column, baseline: Column, workers: Column) -> Column:
    """From the pace so far, or from a baseline while nothing is done."""
    left = F.greatest(total - done, F.lit(0))
    return F.when(done > 0, elapsed / done * left).otherwise(baseline / F.greatest(workers, F.lit(1)) * left)


def effective_time(derived: Column, own: Column) -> Column:
    """The derived frame's time where it is known, else the unit's own."""
    return F.when(derived >= 0, derived).otherwise(own)

"""Ids and digests that are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, parts: list[Column], sep: str = "|", size: int = 24) -> Column:
    """``prefix`` and the first ``size`` hex digits of the SHA-256 of the joined parts; null counts as empty."""
    text = F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, size))


def execution_key(parts: list[Column]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON with sorted keys, without blanks, nulls kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def row_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def set_digest(ids: Column) -> Column:
    """Aggregate: SHA-256 of the sorted ids, one a line. For groups whose ids fit a task; see ``multiset_digest``."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(ids)), "\n"), 256)


def ordered_digest(order: Column, digest: Column) -> Column:
    """Aggregate: SHA-256 of row digests in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), digest.alias("d")))), lambda x: x["d"]), "\n"), 256)


def multiset_digest(*columns: Column) -> Column:
    """Aggregate: a digest that doesn't depend on row order, combined before the shuffle, for tables of any size.

    The SHA-256 of each row is taken as four numbers of 60 bits, which are summed over the rows.
    """
    row = F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return F.concat_ws("-", F.count(F.lit(1)).cast("string"), *[F.coalesce(x, F.lit(0)).cast("string") for x in lanes])


def valid_hash(c: Column) -> Column:
    """The 64 hex digits of a SHA-256, trimmed, in lower case and without ``sha256:``; null if they aren't."""
    text = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), "^sha256:", "")
    return F.when(text.rlike("^[0-9a-f]{64}$"), text)


def quick_hash(size: Column, head: Column, tail: Column) -> Column:
    """SHA-256 of size, first and last 64 KiB, each divided by a zero byte."""
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(F.encode(size.cast("string"), "UTF-8"), zero, head, zero, tail), 256)


def content_hashes(content: Column, length: Column) -> tuple[Column, Column]:
    """The quick and the full hash of file contents as ``binaryFile`` reads them."""
    k = 64 * 1024
    tail = F.when(length > k, F.expr("substring(content, -65536, 65536)")).otherwise(content)
    return quick_hash(length, F.substring(content, 1, k), tail), F.sha2(content, 256)


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex numbers. Base -10 keeps the top bit, which base 10 would overflow."""
    number = lambda c: F.conv(c, 16, -10).cast("bigint")
    return F.bit_count(number(a).bitwiseXOR(number(b)))

"""Problem 5: a varied subset of given size, by concave feature coverage.

A subset is worth the sum, over features, of the square root of the mass that its records
have of the feature, so each further record of a large source or with a frequent label
adds less. Rounds with a falling threshold add records whose marginal gain exceeds it,
until the size is reached.

Records lie in blocks of at most about BLOCK_ROWS, packed once into a row of arrays each,
which is never rewritten. In a round every block is one step of one task: the exact gains
of its records follow from the mass selected so far, and those above the threshold are
taken in descending order of gain, each against the mass that the block's own takings
add. As the other blocks do the same at the same time, own takings of a feature count as
often as the feature's mass in all blocks exceeds that in its own. Records of one source
share a block as far as they fit, so what they add to each other is known exactly; a
source with more records is spread over several blocks. After a round the takings of all
blocks are added up, and the next one starts from exact masses again.

What a block must know (masses of its features, records taken) comes as a broadcast while
it has at most MOST_SENT rows, and by a shuffled join beyond that; results are the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelode.runtime import Scratch, bounded_broadcast

#: Each round's threshold is so much of the one before.
FALL = 0.8
#: Records of a block. A source with more than a quarter of that is spread.
BLOCK_ROWS = 20_000
#: Masses and records taken that are sent to every worker (16 bytes each); more are joined.
MOST_SENT = 500_000
#: Gains below this are none.
NOTHING = 1e-9

_PACKED = "block long, ids array<string>, u array<long>, sizes array<int>, at array<int>, mass array<double>, features array<long>, times array<double>"
_TAKEN = "block long, place int, id string, u long, gain double, features array<long>, mass array<double>, best double"


def _masses(c: Column, kind: T.DataType) -> Column:
    """Features as (f, m): names with mass 1, or structs of a name and its mass. Null names and masses that aren't positive are left out."""
    named = isinstance(kind.elementType, T.StructType)
    fields = kind.elementType.names if named else ()
    pair = lambda x: F.struct(F.xxhash64(x[fields[0]] if named else x).alias("f"), (x[fields[1]].cast("double") if named else F.lit(1.0)).alias("m"))
    known = F.filter(c, lambda x: (x[fields[0]].isNotNull() & (x[fields[1]] > 0) & ~F.isnan(x[fields[1]].cast("double"))) if named else x.isNotNull())
    return F.coalesce(F.transform(known, pair), F.array().cast("array<struct<f:bigint,m:double>>"))


def _blocks(rows: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """One row of arrays for each block of the records ``id, near, u, fs, ms``."""
    blocks = -(-count // BLOCK_ROWS)
    large = rows.groupBy("near").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS // 4).withColumn("parts", F.ceil(F.col("n") / (BLOCK_ROWS // 4)))
    large = scratch.put(large, "large")  # at most four for each block
    part = F.pmod(F.col("u"), F.coalesce("parts", F.lit(1)))
    placed = rows.join(bounded_broadcast(large.select("near", "parts"), large.count()), "near", "left").withColumn("block", F.pmod(F.xxhash64("near", part), F.lit(blocks))).select("block", "id", "u", "fs", "ms")
    placed = scratch.put(placed, "placed")
    own = placed.select("block", F.explode(F.arrays_zip("fs", "ms")).alias("x")).groupBy("block", F.col("x.fs").alias("f")).agg(F.sum("x.ms").alias("own"))
    own = scratch.put(own, "features")
    known = own.join(own.groupBy("f").agg(F.sum("own").alias("all")), "f").select("block", "f", (F.col("all") / F.col("own")).alias("times"))

    def pack(records: pa.Table, features: pa.Table) -> pa.Table:
        records, features = records.combine_chunks().sort_by([("u", "ascending"), ("id", "ascending")]), features.combine_chunks().sort_by("f")
        keys = features["f"].to_numpy()
        lists = records["fs"].combine_chunks()
        at = np.searchsorted(keys, lists.flatten().to_numpy())
        one = lambda x: pa.array([x])
        columns = [pa.array([records["block"][0].as_py()]), pa.array([records["id"].to_pylist()], pa.list_(pa.string())), one(records["u"].to_numpy()), one(np.diff(lists.offsets.to_numpy()).astype(np.int32)), one(at.astype(np.int32)), one(records["ms"].combine_chunks().flatten().to_numpy()), one(keys), one(features["times"].to_numpy())]
        return pa.Table.from_arrays(columns, names=["block", "ids", "u", "sizes", "at", "mass", "features", "times"])

    packed = scratch.put(placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(pack, _PACKED), "blocks")
    scratch.drop(placed)
    return packed, own.select("block", "f")


def _step(row: dict, mass: np.ndarray, taken: np.ndarray, level: float) -> tuple[list[tuple[float, int]], float, np.ndarray, np.ndarray]:
    """What a block takes at a threshold: (gain, place) of each, the highest gain that is left, and where each record's features are."""
    sizes, at, own = row["sizes"], row["at"], row["mass"]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    record = np.repeat(np.arange(len(sizes)), sizes)
    now = mass[at]
    gains = np.bincount(record, np.sqrt(now + own) - np.sqrt(now), len(sizes))
    gains[taken] = -1.0
    heap = [(-gains[i], i) for i in np.flatnonzero((gains >= level) & (gains >= 0)).tolist()]
    heapq.heapify(heap)
    mass, times, found = mass.copy(), row["times"], []
    while heap:
        _, i = heapq.heappop(heap)
        a, z = offsets[i], offsets[i + 1]
        f, m = at[a:z], own[a:z]
        gain = float((np.sqrt(mass[f] + m) - np.sqrt(mass[f])).sum())
        if gain < level:
            continue
        if heap and gain < -heap[0][0] - 1e-12:
            heapq.heappush(heap, (-gain, i))
            continue
        found.append((gain, i))
        mass[f] += m * times[f]
        gains[i] = -1.0
    return found, float(gains.max(initial=-1.0)), offsets, at


class _Known:
    """What has been taken: on the driver while it is little, else only in tables."""

    def __init__(self, most: int):
        self.most, self.rows, self.taken, self.mass = most, 0, None, None
        self.places: dict[int, list[int]] = {}
        self.values: dict[int, float] = {}

    @property
    def little(self) -> bool:
        return max(self.rows, len(self.values)) <= self.most

    def add(self, new: DataFrame, rows: int, scratch: Scratch, turn: int) -> None:
        self.rows += rows
        self.taken = new.select("block", "place") if self.taken is None else self.taken.unionAll(new.select("block", "place"))
        if self.little:
            for block, place, features, mass in new.select("block", "place", "features", "mass").toLocalIterator():
                self.places.setdefault(block, []).append(place)
                for f, m in zip(features, mass, strict=True):
                    self.values[f] = self.values.get(f, 0.0) + m
        added = new.select(F.explode(F.arrays_zip("features", "mass")).alias("x")).select(F.col("x.features").alias("f"), F.col("x.mass").alias("v"))
        self.mass = added if self.mass is None else self.mass.unionAll(added)
        if not self.little:
            self.mass = scratch.put(self.mass.groupBy("f").agg(F.sum("v").alias("v")), f"mass{turn}")

    def arrays(self) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        keys = np.array(sorted(self.values), np.int64)
        return keys, np.array([self.values[k] for k in keys.tolist()], float), self.places


def _round(blocks: DataFrame, pairs: DataFrame, known: _Known, level: float) -> DataFrame:
    """The takings of every block, and for each block a row (without id) with the highest gain left in it."""
    if known.little:
        shared, rows = blocks.sparkSession.sparkContext.broadcast(known.arrays()), blocks
    else:
        shared = None
        lists = pairs.join(known.mass, "f").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("x")).select("block", F.transform("x", lambda x: x["f"]).alias("known"), F.transform("x", lambda x: x["v"]).alias("values"))
        gone = known.taken.groupBy("block").agg(F.collect_list("place").alias("gone"))
        rows = blocks.join(lists, "block", "left").join(gone, "block", "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                column = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                array = lambda name, kind, column=column: np.asarray(column[name].values.to_numpy(zero_copy_only=False) if column[name].is_valid else [], kind)
                block = batch.column(0)[i].as_py()
                row = {"sizes": array("sizes", np.int64), "at": array("at", np.int64), "mass": array("mass", float), "features": array("features", np.int64), "times": array("times", float)}
                if shared is not None:
                    keys, values, gone = shared.value[0], shared.value[1], shared.value[2].get(block, [])
                else:
                    keys, values, gone = array("known", np.int64), array("values", float), array("gone", np.int64)
                f = row["features"]
                j = np.minimum(np.searchsorted(keys, f), max(len(keys) - 1, 0))
                now = np.where(keys[j] == f, values[j], 0.0) if len(keys) and len(f) else np.zeros(len(f))
                found, best, offsets, at = _step(row, now, np.asarray(gone, np.int64), level)
                ids, u = batch.column(1)[i].values, batch.column(2)[i].values
                places = np.array([p for _, p in found], np.int64)
                lists = [slice(offsets[p], offsets[p + 1]) for p in places.tolist()]
                columns = [
                    pa.array(np.full(len(found) + 1, block)), pa.array([*places.tolist(), None], pa.int32()), pa.concat_arrays([ids.take(pa.array(places)), pa.nulls(1, ids.type)]), pa.concat_arrays([u.take(pa.array(places)), pa.nulls(1, u.type)]),
                    pa.array([*[g for g, _ in found], None], pa.float64()), pa.array([*[f[at[x]] for x in lists], None], pa.list_(pa.int64())), pa.array([*[row["mass"][x] for x in lists], None], pa.list_(pa.float64())), pa.array([None] * len(found) + [best], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "id", "u", "gain", "features", "mass", "best"])

    return rows.mapInArrow(take, _TAKEN)


#: Bits of the order that a level of ``_first`` looks at, and levels.
BITS, LEVELS = 12, 5


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the highest gain, equal ones by ``u``: their order is a number, whose bits are decided by histograms; nothing is sorted."""
    top = rows.agg(F.max("gain")).first()[0] or 1.0
    scaled = F.floor((top - F.col("gain")) / max(top, 1e-300) * float((1 << 26) - 1)).cast("long")
    ranked = rows.withColumn("h", F.shiftleft(F.greatest(scaled, F.lit(0)), 34).bitwiseOR(F.shiftrightunsigned("u", 30)))
    prefix, left = 0, n
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = ranked.where(F.shiftright("h", shift + BITS) == prefix) if level else ranked
        for bucket, m in sorted(tuple(x) for x in inside.groupBy(F.shiftright("h", shift)).count().collect()):
            if m >= left:
                prefix = bucket
                break
            left -= m
    equal = ranked.where(F.col("h") == prefix).orderBy("u", "id").limit(left)  # but for chance, one row
    return ranked.where(F.col("h") < prefix).unionAll(equal).drop("h")


def varied_subset(df: DataFrame, record: str, features: str, size: int, near: str | None = None, most_sent: int = MOST_SENT, scratch: Scratch | None = None) -> DataFrame:
    """``record, round, gain`` of ``size`` records (all, if there are fewer) that cover the features well.

    ``features`` is an array of names, each of mass 1, or of structs of a name and its mass. ``gain`` is the record's
    marginal gain when it was taken. ``near`` names a column (a source) whose equal values share a block if they fit.

    * Records with a null id are left out; of records with the same id the features are joined.
    * A record without features (null or empty) gains nothing and is taken last.
    * A feature that a record has several times counts once, with its greatest mass; a null name, or a mass that is
      null, NaN or not positive, is no feature. Equal gains are resolved by a hash of the id, then the id.
    * ``size`` < 1 and empty tables give no rows. Other columns are never read.
    """
    scratch = scratch or Scratch(df.sparkSession, "varied")
    base = df.where(F.col(f"`{record}`").isNotNull()).select(F.col(f"`{record}`").cast("string").alias("id"), (F.col(f"`{near}`").cast("string") if near else F.lit(None).cast("string")).alias("near"), _masses(F.col(f"`{features}`"), df.schema[features].dataType).alias("x"))
    once = base.groupBy("id").agg(F.min("near").alias("near"), F.array_sort(F.flatten(F.collect_list("x"))).alias("x"))
    last = F.filter("x", lambda y, i: (i == F.size("x") - 1) | (F.get("x", i + 1)["f"] != y["f"]))  # sorted by feature, then mass
    u = F.xxhash64("id", F.lit(5))
    rows = once.select("id", last.alias("x"), u.alias("u"), F.coalesce("near", F.concat(F.lit("~"), F.col("id"))).alias("near"))
    rows = scratch.put(rows.select("id", "near", "u", F.transform("x", lambda y: y["f"]).alias("fs"), F.transform("x", lambda y: y["m"]).alias("ms")), "records")
    count, level = rows.agg(F.count("*"), F.max(F.aggregate("ms", F.lit(0.0), lambda s, m: s + F.sqrt(m)))).first()
    empty = rows.select(F.col("id").alias(record), F.lit(0).alias("round"), F.lit(0.0).alias("gain")).limit(0)
    if size < 1 or not count:
        return empty
    blocks, pairs = _blocks(rows, count, scratch)
    open_size, turn, known = min(size, count), 0, _Known(most_sent)
    picked: list[DataFrame] = []
    while open_size:
        level = level * FALL if level > NOTHING else -1.0
        made = scratch.put(_round(blocks, pairs, known, level), f"round{turn}")
        got, best = made.agg(F.count("id"), F.max("best")).first()
        if not got:
            level = best if best > NOTHING else 0.0
            continue
        new = made.where("id is not null")
        if got > open_size:
            new, got = scratch.put(_first(new, open_size), "last"), open_size
        open_size -= got
        picked.append(new.withColumn("round", F.lit(turn)))
        if open_size:
            known.add(new, got, scratch, turn)
        turn += 1
    for p in picked[1:]:
        picked[0] = picked[0].unionByName(p)
    return picked[0].select(F.col("id").alias(record), "round", "gain")


def coverage(df: DataFrame, record: str, features: str, subset: DataFrame) -> DataFrame:
    """``value, features_covered``: the concave coverage of a subset, and how many features it touches."""
    inside = df.join(subset.select(record).distinct(), record, "left_semi").select(record, F.explode(_masses(F.col(features), df.schema[features].dataType)).alias("x")).groupBy(record, "x.f").agg(F.max("x.m").alias("m"))
    return inside.groupBy("f").agg(F.sum("m").alias("m")).agg(F.sum(F.sqrt("m")).alias("value"), F.count("*").alias("features_covered"))


def queue_features(labels: str, categories: str, source: str) -> Column:
    """The features of a queue row, with their masses: its labels (as often as they were seen), its categories and its source (once each).

    ``labels`` is ``name:count|name:count``, ``categories`` is ``a|b``. Spellings of one
    name are one feature; blank and placeholder names are none; a name without a count has mass 1.
    """
    count = r":\s*(\d+)\s*$"

    def parts(c: Column) -> Column:
        wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
        flat = F.translate(F.coalesce(c, F.lit("")), wide, "".join(chr(0x21 + i) for i in range(94)) + " ")
        return F.split(F.lower(flat), r"\|")

    def pair(kind: str, name: Column, mass: Column) -> Column:
        return F.struct(F.concat(F.lit(kind), name).alias("name"), mass.alias("mass"))

    def named(kind: str, c: Column) -> Column:
        name = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, count, ""), r"(?U)[\s_\-]+", " "))
        known = F.filter(parts(c), lambda x: ~name(x).isin("", "none", "null", "nan", "[]"))
        return F.transform(known, lambda x: pair(kind, name(x), F.greatest(F.coalesce(F.regexp_extract(x, count, 1).try_cast("double"), F.lit(1.0)), F.lit(1.0))))

    own = F.when(F.col(source).isNotNull(), F.array(pair("source:", F.col(source), F.lit(1.0)))).otherwise(F.array().cast("array<struct<name:string,mass:double>>"))
    return F.concat(named("label:", F.col(labels)), named("category:", F.col(categories)), own)

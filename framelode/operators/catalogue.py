"""Views of identity, text evidence, audits and pages of a catalogue: projections and aggregates over keyed tables."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelode.functions import hashing
from framelode.functions.text import reasons


def visual_identity(members: DataFrame, unit: str, canonical: str, digest: str, failed: str) -> DataFrame:
    """Every unit with its status among those of one canonical unit, whether heavy stages may see it, and its group.

    ``duplicate_type`` of a group is exact if all members share the canonical unit's digest. A unit that couldn't be decoded passes.
    """
    own = members.select(F.col(unit).alias("unit"), F.coalesce(canonical, unit).alias("canonical"), F.col(digest).alias("digest"), F.coalesce(F.col(failed), F.lit(False)).alias("failed"))
    head = own.where("unit = canonical").select("canonical", F.col("digest").alias("head"))
    met = own.join(head, "canonical", "left").withColumn("same", F.coalesce((F.col("digest") != "") & (F.col("digest") == F.col("head")), F.lit(False)))
    sizes = met.groupBy("canonical").agg(F.count("*").alias("members"), F.bool_and(F.col("same") | (F.col("unit") == F.col("canonical"))).alias("exact"))
    status = (
        F.when(F.col("failed"), "blocked_decoder").when(F.col("members") == 1, "unique").when(F.col("unit") == F.col("canonical"), "canonical")
        .when(F.col("same"), "exact_duplicate").otherwise("near_duplicate")
    )
    group = F.when(F.col("members") > 1, hashing.stable_id("vdg_", [F.col("canonical")]))
    kind = F.when(F.col("members") > 1, F.when(F.col("exact"), "exact_duplicate").otherwise("near_duplicate"))
    return met.join(sizes, "canonical").select("unit", "canonical", status.alias("status"), status.isin("blocked_decoder", "unique", "canonical").alias("eligible"), group.alias("group_id"), kind.alias("duplicate_type"), "members")


def canonical_view(identity: DataFrame, statuses: tuple[str, ...] = ("unique", "canonical", "blocked_decoder")) -> DataFrame:
    """What heavy stages may see."""
    return identity.where(F.col("eligible") & F.col("status").isin(*statuses))


def expand(identity: DataFrame, canonical: DataFrame) -> DataFrame:
    """All units behind the given canonical ones (a column ``canonical``), and back."""
    return identity.join(canonical.select("canonical").distinct(), "canonical", "left_semi")


def leaks(used: DataFrame, key: str, allowed: DataFrame, allowed_key: str) -> DataFrame:
    """Keys that a heavy stage used though the canonical view lacks them: must be empty."""
    return used.where(F.col(key).isNotNull()).select(key).distinct().join(allowed.select(F.col(allowed_key).alias(key)), key, "left_anti")


def assert_no_leaks(used: DataFrame, key: str, allowed: DataFrame, allowed_key: str) -> None:
    if some := [r[0] for r in leaks(used, key, allowed, allowed_key).limit(5).collect()]:
        raise ValueError(f"not canonical: {', '.join(map(str, some))}")


def text_evidence(labels: DataFrame, unit: str, bearing: tuple[str, ...], weak: tuple[str, ...]) -> DataFrame:
    """Per unit, from ``label, confidence, area``: what its text-bearing labels amount to, weak carriers left out."""
    strong = F.col("label").isin(*bearing) & ~F.col("label").isin(*weak)
    of = lambda c: F.coalesce(F.when(strong, F.coalesce(c, F.lit(0.0))), F.lit(0.0))
    return labels.groupBy(unit).agg(
        F.bool_or(strong).alias("has_strong_text"), F.max(of("confidence")).alias("max_confidence"), F.max(of("area")).alias("max_area"), F.sum(of("area")).alias("aggregate_area"),
        F.array_join(F.array_sort(F.collect_set(F.when(strong, F.col("label")))), "|").alias("labels"),
    )


def video_text_frames(frames: DataFrame, source: str, time: str, unit: str, confidence: float, area: float, aggregate: float, cap: int) -> DataFrame:
    """Of each source the ``cap`` frames with the most text among sound ones (``sound``, and the columns of ``text_evidence``)."""
    fit = F.col("sound") & F.col("has_strong_text") & (F.col("max_confidence") >= confidence) & ((F.col("max_area") >= area) | (F.col("aggregate_area") >= aggregate))
    order = Window.partitionBy(source).orderBy(F.desc("aggregate_area"), F.desc("max_confidence"), time, unit)
    return frames.where(fit).withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap)


def tail_remap(frames: DataFrame, source: str, time: str, unit: str, anchors: DataFrame, tail_start: str, short: str, radius: int) -> DataFrame:
    """Anchors (source, ``anchor``: a rank from 0, the source's ``tail_start`` and ``short``) moved off the tail.

    An anchor whose neighbours within ``radius`` ranks all lie in the tail (unknown times aside) goes to the last frame before
    it; if there is none it fails (-1). Short films and films without a tail stay. A rank interval meets frames by an equi-join.
    """
    w = Window.partitionBy("s").orderBy("t", "u")
    ranked = frames.select(F.col(source).alias("s"), F.coalesce(F.col(time), F.lit(-1)).alias("t"), F.col(unit).alias("u")).withColumn("r", F.row_number().over(w) - 1)
    ends = anchors.select(F.col(source).alias("s"), "anchor", F.col(tail_start).alias("tail"), F.col(short).alias("short"))
    near = ends.withColumn("r", F.explode(F.sequence(F.col("anchor") - radius, F.col("anchor") + radius))).join(ranked, ["s", "r"]).where("t >= 0")
    lying = near.groupBy("s", "anchor").agg(F.bool_and(F.col("t") >= F.col("tail")).alias("in_tail"))
    last = ends.select("s", "tail").distinct().join(ranked, "s").where("t >= 0 and t < tail").groupBy("s", "tail").agg(F.max("r").alias("last"))
    size = ranked.groupBy("s").agg(F.count("*").alias("n"))
    joined = ends.join(lying, ["s", "anchor"], "left").join(last, ["s", "tail"], "left").join(size, "s")
    moved = ~F.col("short") & F.col("tail").isNotNull() & F.coalesce("in_tail", F.lit(False))
    effective = F.when(moved, F.coalesce("last", F.lit(-1))).otherwise(F.col("anchor"))
    edge = lambda c: F.when(effective < 0, -1).otherwise(c)
    return joined.select(F.col("s").alias(source), "anchor", moved.alias("tail_only"), effective.alias("effective"), edge(F.greatest(F.lit(0), effective - radius)).alias("from_rank"), edge(F.least(F.col("n") - 1, effective + radius)).alias("to_rank"))


def ocr_audit(results: DataFrame, queue: DataFrame, key: str, lineage: tuple[str, ...], least_chars: int = 4, least_confidence: float = 0.8) -> DataFrame:
    """Quality status of recognised texts with its reasons: against the queue, their digest and their lines.

    Columns: ``item_status, result_status, ocr_text, ocr_text_sha256, ocr_lines_json, ocr_line_count, mean_confidence`` and the lineage.
    """
    own = queue.select(F.col(key), *[F.col(c).alias(f"q_{c}") for c in lineage], F.lit(True).alias("_queued"))
    text = F.coalesce("ocr_text", F.lit(""))
    normal = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    lines = F.from_json("ocr_lines_json", "array<string>")
    repeated = results.withColumn("_n", normal).where("_n <> ''").groupBy("_n").agg(F.count_distinct(key).alias("_c")).where("_c > 1")
    met = results.withColumn("_n", normal).join(own, key, "left").join(repeated, "_n", "left")
    good = lambda c: F.coalesce(F.col(c).isin("success", "no_text"), F.lit(False))
    queued = F.col("_queued").isNotNull()
    listed = F.coalesce(F.rlike(F.trim("ocr_lines_json"), F.lit(r"(?s)^\[.*\]$")), F.lit(False)) & lines.isNotNull()
    hard = [
        (~queued, "candidate_missing_from_frozen_ocr_queue"), *[(queued & ~F.col(c).eqNullSafe(F.col(f"q_{c}")), f"lineage_{c}") for c in lineage],
        (~good("item_status"), "run_item_non_terminal_success"), (~good("result_status"), "result_non_terminal_success"), (F.col("result_status").eqNullSafe("success") & (F.trim(text) == ""), "empty_ocr_success"),
        (~F.sha2(text, 256).eqNullSafe(F.col("ocr_text_sha256")), "ocr_text_sha256_mismatch"), (~listed, "ocr_lines_json_invalid"), (listed & (F.size(lines) != F.col("ocr_line_count")), "ocr_line_count_mismatch"),
    ]
    soft = [(F.length(text) < least_chars, "ocr_text_short"), (F.col("mean_confidence").isNull() | (F.col("mean_confidence") < least_confidence), "ocr_mean_confidence_low"), (F.col("_c").isNotNull(), "ocr_exact_normalized_text_duplicate")]
    bad, odd = reasons(hard), reasons(soft)
    return met.select(key, F.when(bad != "", "FAIL").when(odd != "", "REVIEW").otherwise("PASS").alias("quality_status"), bad.alias("hard_fail_reasons"), odd.alias("review_reasons"))


def joint_status(audits: DataFrame, sets_equal: Column, ids: list[str], flags_allowed: bool = True) -> DataFrame:
    """One row: technical and policy status and readiness for staging of audited rows (``quality_status`` and id columns that must be unique)."""
    unique = [F.count(F.col(c)) == F.count_distinct(F.col(c)) for c in ids]
    one = audits.agg(F.count(F.when(F.col("quality_status") == "FAIL", 1)).alias("failed"), F.count(F.when(F.col("quality_status") == "REVIEW", 1)).alias("review"), reduce(lambda a, b: a & b, unique, F.lit(True)).alias("unique"))
    technical = F.when(sets_equal & F.col("unique") & (F.col("failed") == 0), "PASS").otherwise("FAIL")
    flagged = (F.col("review") > 0) & F.lit(flags_allowed)
    staging = F.when(technical == "FAIL", "DO_NOT_STAGE").when(flagged, "READY_WITH_QUALITY_FLAGS").otherwise("READY")
    policy = F.when(F.col("review") > 0, "REVIEW").otherwise("PASS")
    status = F.when((technical == "PASS") & (policy == "PASS"), "PASS").when(staging == "READY_WITH_QUALITY_FLAGS", "PASS_WITH_REVIEW").otherwise("FAIL")
    return one.select(status.alias("status"), technical.alias("technical_status"), policy.alias("policy_status"), staging.alias("staging"), "failed", "review")


def reliable_members(members: DataFrame) -> DataFrame:
    """Members of person clusters that may be shown: of two frames or more, over two sources and of high confidence unless a person confirmed them."""
    confirmed = F.coalesce(F.col("human_review_status") == "confirmed", F.lit(False))
    return members.where((F.col("member_count") > 1) & ((F.col("distinct_source_count") >= 2) | confirmed) & ((F.col("cluster_confidence") == "high") | confirmed))


def person_results(members: DataFrame, cluster: str, offset: int, limit: int, media: str = "all") -> DataFrame:
    """A page of one cluster: each unit once, by its most similar face, most similar units first."""
    own = reliable_members(members).where((F.col("person_cluster_id") == cluster) & (F.lit(media == "all") | (F.col("media_type") == media)))
    best = own.groupBy("visual_unit_id").agg(F.max(F.struct("similarity_to_representative", F.col("face_id"))).alias("x"))
    rows = best.select("visual_unit_id", F.col("x.similarity_to_representative").alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "visual_unit_id").limit(offset + limit).offset(offset)


def person_catalogue(members: DataFrame, offset: int, limit: int) -> DataFrame:
    """Reliable clusters by their representative face, large ones first."""
    rows = reliable_members(members).where("face_id = representative_face_id").select("person_cluster_id", "visual_unit_id", "member_count", "distinct_source_count").distinct()
    return rows.orderBy(F.desc("member_count"), "person_cluster_id").limit(offset + limit).offset(offset)


def clusters_of_units(members: DataFrame, units: DataFrame) -> DataFrame:
    """The reliable clusters of given units (a column ``visual_unit_id``), each once a unit."""
    return reliable_members(members).join(units.select("visual_unit_id").distinct(), "visual_unit_id", "left_semi").select("visual_unit_id", "person_cluster_id", "member_count").distinct()


def transitions(df: DataFrame, source: str, order: list[str], classes: list[str]) -> DataFrame:
    """For each class column, how often it has changed so far in its source."""
    w = Window.partitionBy(source).orderBy(*order)
    changed = {c: F.coalesce((F.col(c) != F.lag(c).over(w)).cast("int"), F.lit(0)) for c in classes}
    marked = df.select("*", *[x.alias(f"_{c}") for c, x in changed.items()])
    return marked.select(*df.columns, *[F.sum(f"_{c}").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{c}_transitions") for c in classes])


def suppressed_boxes(boxes: DataFrame, image: str, key: str, most: float) -> DataFrame:
    """Boxes (x1, y1, x2, y2, score; pixels inclusive) that stay when, best first, those are dropped that overlap a kept one by more than ``most``. An image's boxes fit a task."""

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", key], ascending=[False, True], kind="stable").reset_index(drop=True)
        x1, y1, x2, y2 = (g[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
        area = (x2 - x1 + 1) * (y2 - y1 + 1)
        kept: list[int] = []
        for i in range(len(g)):
            inner = np.maximum(0, np.minimum(x2[i], x2[kept]) - np.maximum(x1[i], x1[kept]) + 1) * np.maximum(0, np.minimum(y2[i], y2[kept]) - np.maximum(y1[i], y1[kept]) + 1)
            if not len(kept) or (inner / (area[i] + area[kept] - inner) <= most).all():
                kept.append(i)
        return g.loc[kept, [image, key]]

    schema = T.StructType([boxes.schema[image], boxes.schema[key]])
    return boxes.groupBy(image).applyInPandas(choose, schema)


_LINES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("box", T.StringType())]))


@F.pandas_udf(_LINES)
def recognised_lines(blobs: pd.Series) -> pd.Series:
    """The text lines in a JSON of any shape: every object with a ``text``, in order, equal ones once. Broken JSON and null have none."""

    def lines(blob: str | None) -> list[dict]:
        found: dict[str, dict] = {}

        def walk(x) -> None:
            if isinstance(x, dict):
                if isinstance(x.get("text"), str) and x["text"].strip():
                    score = x.get("confidence", x.get("score"))
                    box = x.get("box", x.get("bbox"))
                    line = {"text": x["text"].strip(), "confidence": float(score) if isinstance(score, (int, float)) else None, "box": None if box is None else json.dumps(box, sort_keys=True, separators=(",", ":"))}
                    found.setdefault(json.dumps(line, sort_keys=True), line)
                for value in x.values():
                    walk(value)
            elif isinstance(x, list):
                for value in x:
                    walk(value)

        try:
            walk(json.loads(blob or "null"))
        except ValueError:
            return []
        return list(found.values())

    return blobs.map(lines)


@F.pandas_udf(T.StringType())
def without_keys(blobs: pd.Series, names: pd.Series) -> pd.Series:
    """JSON without the keys of ``names`` (joined by ``|``) at any depth, keys sorted; null if it is broken."""

    def strip(x, drop: set[str]):
        if isinstance(x, dict):
            return {k: strip(v, drop) for k, v in x.items() if k not in drop}
        return [strip(v, drop) for v in x] if isinstance(x, list) else x

    def cut(blob: str | None, keys: str) -> str | None:
        try:
            return json.dumps(strip(json.loads(blob), set(keys.split("|"))), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return pd.Series([cut(b, k) for b, k in zip(blobs, names, strict=True)], dtype=object)

"""Propagation of labels between neighbouring frames, evidence staging and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import hashing, vectors
from framelode.functions.text import strip
from framelode.runtime import bounded_broadcast, spread


def neighbours(frames: DataFrame, source: str, time: str, key: str, radius: int = 3, anchors: DataFrame | None = None) -> DataFrame:
    """Every frame (or those whose keys ``anchors`` lists) with those up to ``radius`` ranks away in its source: an equi-join on (source, rank), not a range join."""
    w = Window.partitionBy("s").orderBy("t", "id")
    ranked = frames.select(F.col(source).alias("s"), F.col(key).alias("id"), F.col(time).alias("t")).withColumn("r", F.row_number().over(w))
    steps = F.array(*[F.lit(i) for i in range(-radius, radius + 1) if i])
    own = ranked if anchors is None else ranked.join(anchors.select(F.col(anchors.columns[0]).alias("id")), "id", "left_semi")
    left = own.select("s", F.col("id").alias("anchor"), F.explode(steps).alias("step"), "r").select("s", "anchor", "step", (F.col("r") + F.col("step")).alias("r"))
    return left.join(ranked.select("s", "r", F.col("id").alias("target")), ["s", "r"]).select(F.col("s").alias(source), "anchor", "target", F.abs("step").alias("step"))


def confident_labels(labels: DataFrame, unit: str, label: str, confidence: str | None = None, least: float = 0.35) -> DataFrame:
    """``unit, label`` (in lower case) of each label whose best confidence in the unit is at least ``least``; all of them where none is given."""
    named = labels.select(F.col(unit).alias("unit"), F.lower(label).alias("label"), *([F.col(confidence).alias("c")] if confidence else []))
    if not confidence:
        return named.distinct()
    return named.groupBy("unit", "label").agg(F.max("c").alias("c")).where(F.col("c") >= least).select("unit", "label")


def anchor_texts(evidence: DataFrame, unit: str, text: str, modality: str, status: str, modalities: tuple[str, ...] = ("qwenvl",), statuses: tuple[str, ...] = ("PASS",)) -> DataFrame:
    """``unit, text`` of the evidence that labels may leave: captions that passed. Recognised text, notes and what was propagated before are none, so nothing is carried twice."""
    sound = F.col(modality).isin(*modalities) & F.col(status).isin(*statuses) & F.col(unit).isNotNull() & F.col(text).isNotNull()
    return evidence.where(sound).select(F.col(unit).alias("unit"), F.col(text).alias("text"))


def propagate(pairs: DataFrame, mentioned: DataFrame, labels: DataFrame, own: bool = False) -> DataFrame:
    """A label goes from anchor to target if the anchor's text mentions it and both frames have it; once, never further.

    ``own``: what is mentioned are labels of the anchor already.
    """
    carried = pairs.join(mentioned.select(F.col("unit").alias("anchor"), "label"), "anchor")
    if not own:
        carried = carried.join(labels.select(F.col("unit").alias("anchor"), "label"), ["anchor", "label"], "left_semi")
    shared = carried.join(labels.select(F.col("unit").alias("target"), "label"), ["target", "label"], "left_semi")
    overlap = shared.groupBy("anchor", "target", "step").agg(F.collect_set("label").alias("ls"))
    flat = overlap.select("anchor", "target", "step", F.size("ls").alias("overlap"), F.explode("ls").alias("label"))
    return flat.withColumn("confidence", vectors.step_confidence(F.col("step"), F.col("overlap")))


def mentions(docs: DataFrame, doc: str, body: str, terms: DataFrame) -> DataFrame:
    """``doc, term`` for each term that a document's text mentions; ``doc`` is unique.

    Terms that begin with a letter a-z or digit meet texts by an equi-join on their first word, others on their first two
    signs (or their only one). Only keys are repeated and shuffled so; texts are fetched for the pairs that need a look.
    """
    from framelode.functions.text import term_matches

    known = terms.select(F.lower(F.trim(terms[terms.columns[0]])).alias("term")).where("term <> ''").distinct()
    word = F.regexp_extract("term", "^[a-z0-9]+", 0)
    keyed = known.withColumn("key", F.when(word != "", word).otherwise(F.substring("term", 1, 2)))
    text = spread(docs.where(F.col(body).isNotNull()).select(F.col(doc), F.lower(body).alias("x")), doc)
    found = lambda p, group: F.regexp_extract_all("x", F.lit(p), F.lit(group))
    keys = F.concat(found("[a-z0-9]+", 0), found(r"[^a-z0-9\s]", 0), found(r"(?s)(?=([^a-z0-9\s].))", 1))
    met = text.select(doc, F.explode(F.array_distinct(keys)).alias("key")).join(bounded_broadcast(keyed, keyed.count()), "key").select(doc, "term", "key").distinct()
    # A term that is its own key is mentioned, but for terms that need boundaries and begin with another sign.
    whole = met.where((F.col("key") == F.col("term")) & (~F.col("term").rlike("[a-z0-9]") | F.col("term").rlike("^[a-z0-9]"))).select(doc, "term")
    rest = met.select(doc, "term").join(whole, [doc, "term"], "left_anti")
    return whole.unionAll(rest.join(text, doc).where(term_matches(F.col("x"), F.col("term"))).select(doc, "term"))


def roll_up(items: DataFrame) -> DataFrame:
    """One row per target: its labels and anchors, sorted and joined, and the best confidence."""
    return items.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"), F.array_join(F.array_sort(F.collect_set("anchor")), "|").alias("anchors"), F.max("confidence").alias("confidence"))


def stage(captions: DataFrame, texts: DataFrame) -> DataFrame:
    """Caption and recognised-text rows as one table of evidence with a stable key."""
    both = captions.withColumn("modality", F.lit("caption")).unionByName(texts.withColumn("modality", F.lit("ocr")), allowMissingColumns=True)
    return both.withColumn("evidence_key", hashing.stable_id("ev_", [F.col("modality"), F.col("unit"), F.col("text")], "\x1f", 28))


def merge_supplement(base: DataFrame, supplement: DataFrame, key: str, evidence: str, newest: str) -> DataFrame:
    """The newest supplement per key joins the base unless the base has its key or its evidence."""
    from framelode.operators.tables import newest as first

    latest = first(supplement, [key], [F.desc(newest), F.desc(evidence)])
    return base.unionByName(latest.join(base.select(key), key, "left_anti").join(base.select(evidence), evidence, "left_anti"), allowMissingColumns=True)


def documents(evidence: DataFrame, unit: str, text: str) -> DataFrame:
    """One document per unit: its distinct texts in order of their digest, divided by blank lines."""
    hashed = evidence.where(strip(F.coalesce(F.col(text), F.lit(""))) != "").select(unit, F.sha2(F.col(text), 256).alias("sha"), F.col(text).alias("text"))
    return hashed.groupBy(unit).agg(F.array_sort(F.collect_set(F.struct("sha", "text"))).alias("parts")).select(unit, F.size("parts").alias("parts"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("document"))


def document_kind(direct, propagated):
    return F.when(direct & propagated, "direct_and_propagation").when(direct, "direct_only").otherwise("propagation_only")


def reuse_jobs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One job per distinct text: its digest, how many documents share it and the smallest of them."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha")).agg(F.count("*").alias("documents"), F.min(key).alias("first_document"))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: must be empty before documents are built."""
    return df.groupBy(key).agg(F.min(value).alias("a"), F.max(value).alias("b")).where("a <> b").select(key, "a", "b")

"""Retrieval: exact vector scan, text evidence and labels, fused by weighted reciprocal rank."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import hashing, text, vectors
from framelode.operators import windows
from framelode.runtime import BROADCAST_ROWS, Scratch, bounded_broadcast

K = 60
WEIGHTS = {"visual": 1.0, "text": 0.8, "object": 0.4}


@dataclass(frozen=True)
class SearchConfig:
    """Thresholds of a search, checked when made."""

    k: int = K
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    visual: float = 0.34
    text: float = 0.48
    combined: tuple[float, float] = (0.24, 0.40)
    label: tuple[float, float, float] = (0.55, 0.33, 0.40)

    def __post_init__(self):
        if set(self.weights) != set(WEIGHTS) or min(self.weights.values()) <= 0:
            raise ValueError("a positive weight is needed for each of " + ", ".join(WEIGHTS))
        if not isinstance(self.k, int) or self.k < 1:
            raise ValueError("k must be an integer of 1 or more")
        if not all(-1 <= x <= 1 for x in (self.visual, self.text, *self.combined, *self.label)):
            raise ValueError("thresholds lie in [-1, 1]")


def check_queries(queries: list[str], most: int = 512) -> list[str]:
    """The normal forms of queries: 1 to ``most`` signs, none twice."""
    normal = [text.normalize_query(q) for q in queries]
    if any(not 1 <= len(q) <= most for q in normal):
        raise ValueError(f"a query has 1 to {most} signs")
    if len(set(normal)) != len(normal):
        raise ValueError("two queries are the same")
    return normal


def request_id(identity: dict[str, Column]) -> Column:
    return F.substring(F.sha2(hashing.canonical_json(identity), 256), 1, 24)


def scan(items: DataFrame, key: str, vector: str, query: list[float] | DataFrame, name: str = "score") -> DataFrame:
    """The product with the query for every item: one pass, no shuffle; the query is a constant of the plan, or the first row of a table with one column."""
    if isinstance(query, DataFrame):
        one = query.select(F.col(query.columns[0]).alias("_q")).limit(1)
        return items.join(F.broadcast(one)).select(key, vectors.dot(F.col(vector), F.col("_q")).alias(name))
    return items.select(key, vectors.dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias(name))


def top(scored: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """Each task keeps its n best; one merge follows."""
    return scored.orderBy(F.desc(score), key).limit(n)


def text_evidence(docs: DataFrame, unit: str, doc: str, text_col: str, score: str, exact: str) -> DataFrame:
    """Per unit: the best score, whether any document matches exactly, and a preview: the last exact document, else the first of best score."""
    shown = F.substring(F.col(text_col), 1, 500)
    rank = F.struct(F.col(exact).alias("e"), F.when(F.col(exact), F.lit(0.0)).otherwise(F.col(score)).alias("s"), F.when(F.col(exact), F.col(doc)).otherwise(-F.col(doc)).alias("d"))
    return docs.groupBy(unit).agg(F.max(score).alias("text_score"), F.max(exact).alias("exact_text"), F.max_by(shown, rank).alias("preview"))


def registry_terms(registry: DataFrame) -> DataFrame:
    """``label, term`` of a registry: each label, its translation, its search terms (a JSON list; broken ones have none) and the words of its embedding text."""
    listed = F.coalesce(F.from_json("search_terms_json", "array<string>"), F.array().cast("array<string>"))
    words = F.split(F.trim(F.regexp_replace(F.coalesce("embedding_text", F.lit("")), r"(?U)\s+", " ")), " ")
    terms = F.explode(F.concat(F.array("label", "label_zh"), listed, words))
    return registry.select("label", terms.alias("term")).where("term is not null and term <> ''").distinct()


def object_evidence(labels: DataFrame, terms: DataFrame, query: str, unit: str) -> DataFrame:
    """Units with a label one of whose terms equals the query in normal form without regard to case, with the best confidence."""
    wanted = text.normalize_query(query).casefold()
    hit = terms.where(text.folded_query(F.col("term")) == wanted).select("label").distinct() if wanted else terms.select("label").limit(0)
    return labels.join(bounded_broadcast(hit, hit.limit(BROADCAST_ROWS + 1).count()), "label", "left_semi").groupBy(unit).agg(F.max("confidence").alias("confidence"))


def fuse(hits: DataFrame, key: str, config: SearchConfig, scratch: Scratch | None = None) -> DataFrame:
    """Weighted reciprocal rank over the channels ``visual, text, object`` (null: not found there). Scores must be finite.

    Each channel's hits are ranked by range partitions, so no task sorts a whole channel, and one aggregate by key adds
    the parts up. Rows with a score that isn't finite end the search with an error.
    """
    scratch = scratch or Scratch(hits.sparkSession, "fuse")
    finite = lambda c: F.when(F.isnan(F.col(c)) | (F.abs(c) == float("inf")), F.raise_error(F.lit("a score isn't finite")).cast("double")).otherwise(F.col(c)).alias(c)
    table = scratch.put(hits.select(*[finite(c) if c in config.weights else F.col(c) for c in hits.columns]), "hits")
    # All channels are ranked at once, one after the other; a channel's ranks begin behind the hits of those before it.
    listed = F.filter(F.array(*[F.struct(F.lit(i).alias("channel"), F.col(c).alias("score")) for i, c in enumerate(config.weights)]), lambda x: x["score"].isNotNull())
    ranked = windows.global_rank(table.select(key, F.explode(listed).alias("x")).select(key, "x.channel", "x.score"), [F.asc("channel"), F.desc("score"), F.asc(key)], "place")
    sizes = table.agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(config.weights)]).first()
    before = F.array(*[F.lit(sum(sizes[:i])) for i in range(len(sizes))])
    own = ranked.groupBy(key).agg(*[F.max(F.when(F.col("channel") == i, F.col("place") - before[i])).alias(f"rank_{c}") for i, c in enumerate(config.weights)])
    score = reduce(lambda a, b: a + b, [F.coalesce(F.lit(w) / (config.k + F.col(f"rank_{c}")), F.lit(0.0)) for c, w in config.weights.items()])
    return table.join(own, key, "left").withColumn("rrf", score)


def reranked(key: str) -> list[Column]:
    """The order of relevant hits: relevance, then reciprocal rank, then id."""
    return [F.desc("relevance"), F.desc("rrf"), F.asc(key)]


def media_counts(relevant: DataFrame, media: str, page: DataFrame | None = None) -> DataFrame:
    """Hits by kind of media, and how many of them a page shows."""
    counted = relevant.groupBy(media).agg(F.count("*").alias("hits"))
    if page is None:
        return counted
    return counted.join(page.groupBy(media).agg(F.count("*").alias("shown")), media, "left").withColumn("shown", F.coalesce("shown", F.lit(0)))


def exact_first(groups: DataFrame, key: str, score: str, exact: str, n: int, offset: int = 0) -> DataFrame:
    """A page of hits, exact ones first, then by score, then by key. Only offset + n rows are kept while sorting."""
    return groups.orderBy(F.desc(exact), F.desc(score), key).limit(offset + n).offset(offset)


def text_groups(docs: DataFrame, digest: str, doc: str, score: str, exact: str, most: int) -> DataFrame:
    """One hit for each distinct text: its best score, whether a document of it matches exactly, how many documents have it, and the ``most`` smallest of them.

    Scores outside [-1.001, 1.001] are no products of unit vectors: such a search ends with an error when it is read.
    """
    sound = F.when(F.col(score).between(-1.001, 1.001), F.col(score)).otherwise(F.raise_error(F.lit("a score lies outside [-1.001, 1.001]")).cast("double"))
    ranked = docs.withColumn("_s", sound).withColumn("_n", F.row_number().over(Window.partitionBy(digest).orderBy(doc)))
    shown = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col(doc))))
    return ranked.groupBy(digest).agg(F.max("_s").alias("score"), F.max(exact).alias("exact"), F.count("*").alias("documents"), shown.alias("shown"))


# The field in which a reason of relevance lies.
HIT_FIELDS = {"exact_text": "text", "exact_object_label": "object_label", "visual": "visual_vector", "text": "semantic_text", "combined_visual_text": "visual_and_text"}


def hit_fields(reasons: Column) -> Column:
    """The fields of ``a|b`` reasons, each once, in order; ``visual_vector`` if there is none."""
    named = F.transform(F.filter(F.split(reasons, r"\|"), lambda x: x != ""), lambda x: F.coalesce(F.create_map(*[F.lit(v) for kv in HIT_FIELDS.items() for v in kv])[x], x))
    return F.coalesce(F.nullif(F.array_join(F.array_distinct(named), ","), F.lit("")), F.lit("visual_vector"))


def gate(config: SearchConfig) -> Column:
    """The reasons for which a hit is relevant; none means it is dropped. Columns: visual, text, object, exact_text."""
    v, t, o = F.coalesce("visual", F.lit(-1.0)), F.coalesce("text", F.lit(-1.0)), F.coalesce("object", F.lit(-1.0))
    c = config
    return text.reasons([
        (F.coalesce("exact_text", F.lit(False)), "exact_text"), ((o >= c.label[0]) & ((v >= c.label[1]) | (t >= c.label[2])), "exact_object_label"),
        (v >= c.visual, "visual"), (t >= c.text, "text"), ((v >= c.combined[0]) & (t >= c.combined[1]), "combined_visual_text"),
    ])


def relevance() -> Column:
    """The best of five estimates, a little more for each further one that holds, at most 0.99."""
    v, t, o = F.coalesce("visual", F.lit(-1.0)), F.coalesce("text", F.lit(-1.0)), F.coalesce("object", F.lit(-1.0))
    reasons = F.split("reasons", r"\|")
    has = lambda r: F.array_contains(reasons, r)
    best = F.greatest(
        F.when(has("exact_text"), 0.88).otherwise(0.0),
        F.when(has("exact_object_label"), F.least(F.lit(0.92), 0.55 + 0.4 * o)).otherwise(0.0),
        F.when(has("visual"), F.least(F.lit(0.90), (v + 1) / 2)).otherwise(0.0),
        F.when(has("text"), F.least(F.lit(0.92), (t + 1) / 2)).otherwise(0.0),
        F.when(has("combined_visual_text"), F.least(F.lit(0.94), ((v + 1) / 2 + (t + 1) / 2) / 2 + 0.08)).otherwise(0.0),
    )
    return F.least(F.lit(0.99), best + F.least(F.lit(0.08), 0.02 * (F.size(reasons) - 1)))


# Words that tell where and when a scene is.
SCENE = {
    "indoor": ("室内", "房间", "客厅", "卧室", "办公室", "会议室", "店内", "车内", "棚内", "indoor"),
    "night": ("夜间", "夜晚", "夜景", "夜空", "深夜", "黑夜", "night"),
    "outdoor": ("户外", "室外", "街道", "道路", "广场", "海边", "湖边", "山野", "建筑外墙", "城市建筑", "outdoor"),
    "day": ("白天", "日间", "晴天", "阳光", "日光", "蓝天", "daytime", "daylight"),
}


def scene_flags(c: Column) -> dict[str, Column]:
    return {k: F.lower(c).rlike("|".join(words)) for k, words in SCENE.items()}


def scene_code(indoor: Column, night: Column, outdoor: Column, day: Column) -> Column:
    return (
        F.when(indoor & night, "night_or_indoor").when(indoor & outdoor, "indoor_or_outdoor").when(night & outdoor, "outdoor_night").when(indoor, "indoor")
        .when(outdoor & day, "outdoor_day").when(outdoor, "outdoor").when(night, "night_or_indoor").otherwise("unknown")
    )


def nearest_rows(left: DataFrame, right: DataFrame, on: str, time: str, key: str, n: int) -> DataFrame:
    """For each left row the ``n`` right rows of its source nearest in time, however far.

    Both sides lie on one line of time: of the right rows only the ``n`` last before a left row and the ``n`` first after
    it can be near. Their ranks follow from one ordered count in the source, so each left row meets 2 n ranks by an equi-join.
    """
    kind = left.schema[key].dataType
    a = left.select(F.col(on).alias("s"), F.col(time).alias("t"), F.col(key).cast("string").alias("id"), F.lit(1).alias("mine"))
    b = right.select(F.col(on).alias("s"), F.col(time).alias("t"), F.col(key).alias("near"))
    line = Window.partitionBy("s").orderBy("t", "mine").rowsBetween(Window.unboundedPreceding, 0)
    placed = a.unionAll(b.select("s", "t", F.lit(None).cast("string"), F.lit(0))).withColumn("r", F.sum(1 - F.col("mine")).over(line)).where("mine = 1")
    met = None
    for order, steps in (([F.asc("t"), F.desc("near")], range(1 - n, 1)), ([F.asc("t"), F.asc("near")], range(1, n + 1))):  # of rows at one time the smallest key is nearest, on either side
        ranked = b.select("s", "near", F.col("t").alias("u"), F.row_number().over(Window.partitionBy("s").orderBy(*order)).alias("r"))
        side = placed.select("s", "id", "t", F.explode(F.array(*[F.col("r") + i for i in steps])).alias("r")).join(ranked, ["s", "r"])
        met = side if met is None else met.unionByName(side)
    w = Window.partitionBy("s", "id").orderBy(F.abs(F.col("t") - F.col("u")), "u", "near")
    return met.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select(F.col("id").cast(kind).alias("id"), "near", "position", F.abs(F.col("t") - F.col("u")).alias("distance"))

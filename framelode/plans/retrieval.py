"""Search, identity, selection, evidence and status queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import hashing, text, times, vectors
from framelode.operators import audit, components, evidence, greedy, identity, search, selection, tables, windows
from framelode.plans.base import FILES, FRAMES, HASHED, LABELS, LISTED, NOVEL, QUEUE, SQUEEZED, Tables, narrow, query
from framelode.plans.texts import QUALITY, STRIP
from framelode.runtime import Scratch

#: The vectors that stand for the embedded query of the visual and of the text channel: models are not run here.
VISUAL, TEXT = 7, 11


def _vector(t: Tables, key: int) -> list[float]:
    return [float(x) for x in t.embeddings.where(F.col("vec_id") == key).select("embedding").first()[0]]


_DOT = "list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {0}))"


@query(f"SELECT vec_id, round({_DOT.format(VISUAL)}, 5) AS score FROM embeddings ORDER BY {_DOT.format(VISUAL)} DESC, vec_id LIMIT 50")
def vector_top(t: Tables) -> DataFrame:
    return search.top(search.scan(t.embeddings, "vec_id", "embedding", t.embeddings.where(F.col("vec_id") == VISUAL).select("embedding")), "vec_id", "score", 50).select("vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {TEXT})), 5) AS cosine, abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.001 AS valid FROM embeddings")
def vector_checks(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _vector(t, TEXT)])
    return t.embeddings.select("vec_id", F.round(vectors.cosine(F.col("embedding"), q), 5).alias("cosine"), vectors.is_valid(F.col("embedding"), 64).alias("valid"))


_SEARCH = f"""WITH {FRAMES}, u AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM f), v AS (SELECT vec_id, {_DOT.format(VISUAL)} AS visual, {_DOT.format(TEXT)} AS txt, label FROM embeddings),
  h AS (SELECT vec_id, visual, CASE WHEN txt > 0 THEN txt END AS text, CASE WHEN label = 3 THEN 0.5::DOUBLE + 0.4 * abs(visual) END AS object FROM v),
  r AS (SELECT *, row_number() OVER (ORDER BY visual DESC, vec_id) AS rv, CASE WHEN text IS NOT NULL THEN row_number() OVER (ORDER BY text DESC NULLS LAST, vec_id) END AS rt, CASE WHEN object IS NOT NULL THEN row_number() OVER (ORDER BY object DESC NULLS LAST, vec_id) END AS ro FROM h),
  s AS (SELECT *, coalesce(1.0::DOUBLE / (60 + rv), 0) + coalesce(0.8::DOUBLE / (60 + rt), 0) + coalesce(0.4::DOUBLE / (60 + ro), 0) AS rrf FROM r),
  g AS (SELECT *, coalesce(object, -1) >= 0.55 AND (visual >= 0.33 OR coalesce(text, -1) >= 0.40) AS a, visual >= 0.34 AS b, coalesce(text, -1) >= 0.48 AS c, visual >= 0.24 AND coalesce(text, -1) >= 0.40 AS d FROM s)"""


def _relevant(t: Tables) -> DataFrame:
    config = search.SearchConfig()
    fused = search.fuse(_hits(t), "vec_id", config).withColumn("reasons", search.gate(config)).where("reasons <> ''")
    return fused.select("vec_id", F.round("rrf", 9).alias("rrf"), "reasons", F.round(search.relevance(), 5).alias("relevance"))


def _hits(t: Tables) -> DataFrame:
    """Scores of three channels for every vector; the object channel stands for labels with a confidence."""
    q, p = (F.array(*[F.lit(x) for x in _vector(t, k)]) for k in (VISUAL, TEXT))
    both = t.embeddings.select("vec_id", "label", vectors.dot(F.col("embedding"), q).alias("visual"), vectors.dot(F.col("embedding"), p).alias("txt"))
    return both.select("vec_id", "visual", F.when(F.col("txt") > 0, F.col("txt")).alias("text"), F.when(F.col("label") == 3, 0.5 + 0.4 * F.abs("visual")).alias("object"), F.lit(False).alias("exact_text"))


@query(_SEARCH + """ SELECT vec_id, round(rrf, 9) AS rrf, concat_ws('|', CASE WHEN a THEN 'exact_object_label' END, CASE WHEN b THEN 'visual' END, CASE WHEN c THEN 'text' END, CASE WHEN d THEN 'combined_visual_text' END) AS reasons,
    round(least(0.99, greatest(CASE WHEN a THEN least(0.92, 0.55 + 0.4 * object) ELSE 0 END, CASE WHEN b THEN least(0.90, (visual + 1) / 2) ELSE 0 END, CASE WHEN c THEN least(0.92, (text + 1) / 2) ELSE 0 END, CASE WHEN d THEN least(0.94, ((visual + 1) / 2 + (text + 1) / 2) / 2 + 0.08) ELSE 0 END)
      + least(0.08, 0.02 * (a::INT + b::INT + c::INT + d::INT - 1))), 5) AS relevance FROM g WHERE a OR b OR c OR d""")
def hybrid_search(t: Tables) -> DataFrame:
    """Three channels fused by reciprocal rank, gated, with a relevance, in the order of a result list."""
    return _relevant(t).orderBy(*search.reranked("vec_id"))


@query("""WITH d AS (SELECT visual_unit_id AS unit, doc_id, text, (n_chars % 97) / 97.0::DOUBLE AS score, contains(lower(text), 'tent') AS exact FROM documents WHERE visual_unit_id IS NOT NULL AND text IS NOT NULL)
    SELECT unit, round(max(score), 9) AS text_score, bool_or(exact) AS exact_text, max_by(substring(text, 1, 500), (exact, CASE WHEN exact THEN 0 ELSE score END, CASE WHEN exact THEN doc_id ELSE -doc_id END)) AS preview FROM d GROUP BY unit""")
def text_channel(t: Tables) -> DataFrame:
    """Evidence per unit from its documents; the score is a stand-in for that of an embedded query."""
    d = t.documents.where("visual_unit_id is not null and text is not null").select(F.col("visual_unit_id").alias("unit"), "doc_id", "text", (F.col("n_chars") % 97 / 97.0).alias("score"), text.has_exact_query(F.col("text"), "tent").alias("exact"))
    return search.text_evidence(d, "unit", "doc_id", "text", "score", "exact").withColumn("text_score", F.round("text_score", 9))


@query(f"""WITH {LABELS}, v AS (SELECT label, unnest(list_concat(list_concat([label, label_zh], {LISTED}), string_split_regex(coalesce(embedding_text, ''), '[\\s\\p{{Z}}]+'))) AS term FROM visual_label_terms),
    h AS (SELECT DISTINCT lower(trim(label)) AS label FROM v WHERE {SQUEEZED.format(narrow("term"))} = 'person')
    SELECT DISTINCT unit, 0.9::DOUBLE AS confidence FROM l WHERE label IN (SELECT label FROM h)""")
def object_channel(t: Tables) -> DataFrame:
    """Units with a label that the query names by any term of the registry; the tables have no confidence, so each label counts as 0.9."""
    terms = search.registry_terms(t.visual_label_terms).withColumn("label", F.lower(F.trim("label")))
    return search.object_evidence(t.labels.withColumn("confidence", F.lit(0.9)), terms, " Ｐｅｒｓｏｎ ", "unit")


@query(f"WITH {LABELS} SELECT (SELECT count(*) FROM (SELECT DISTINCT visual_unit_id FROM visual_units WHERE visual_unit_id NOT IN (SELECT unit FROM l))) AS uncovered, (SELECT count(DISTINCT visual_unit_id) FROM visual_units) AS units")
def coverage_preflight(t: Tables) -> DataFrame:
    units = t.visual_units.select(F.col("visual_unit_id").alias("unit")).where("unit is not null").distinct()
    return units.join(t.labels.select("unit", F.lit(1).alias("has")).distinct(), "unit", "left").agg(F.sum(F.col("has").isNull().cast("int")).cast("bigint").alias("uncovered"), F.count("*").alias("units"))


_FLAGS = ", ".join(f"regexp_matches(lower(text), '{'|'.join(words)}') AS {k}" for k, words in search.SCENE.items())


@query(f"""WITH d AS (SELECT source_content_id AS src, {_FLAGS} FROM documents WHERE text IS NOT NULL AND source_content_id IS NOT NULL), g AS (SELECT src, bool_or(indoor) AS i, bool_or(night) AS n, bool_or(outdoor) AS o, bool_or(day) AS d FROM d GROUP BY src)
    SELECT src, CASE WHEN i AND n THEN 'night_or_indoor' WHEN i AND o THEN 'indoor_or_outdoor' WHEN n AND o THEN 'outdoor_night' WHEN i THEN 'indoor' WHEN o AND d THEN 'outdoor_day' WHEN o THEN 'outdoor' WHEN n THEN 'night_or_indoor' ELSE 'unknown' END AS scene FROM g""")
def scene_consensus(t: Tables) -> DataFrame:
    flags = search.scene_flags(F.col("text"))
    d = t.documents.where("text is not null and source_content_id is not null").groupBy(F.col("source_content_id").alias("src")).agg(*[F.bool_or(c).alias(k) for k, c in flags.items()])
    return d.select("src", search.scene_code(*[F.col(k) for k in search.SCENE]).alias("scene"))


@query(f"""WITH RECURSIVE {QUEUE}, r AS (SELECT source_content_id AS src, candidate_id, time_position_ms AS t, max(CASE WHEN candidate_score IS NULL OR isnan(candidate_score) THEN -1 ELSE candidate_score END) AS score, bool_or(coalesce(lower(trim(media_type)) = 'video', false)) AS video
      FROM q WHERE source_content_id IS NOT NULL AND candidate_id IS NOT NULL AND time_position_ms >= 0 GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, candidate_id, t) AS n FROM r WHERE video),
    g AS (SELECT src, n, candidate_id, t, true AS stays, [t] AS kept FROM v WHERE n = 1 UNION ALL SELECT src, n, candidate_id, t, ok, CASE WHEN ok THEN list_append(kept, t) ELSE kept END
      FROM (SELECT v.*, g.kept, len(list_filter(g.kept, lambda x: abs(x - v.t) < 5000)) = 0 AS ok FROM g JOIN v ON v.src = g.src AND v.n = g.n + 1) w)
    SELECT src, candidate_id, t FROM g WHERE stays UNION ALL SELECT src, candidate_id, t FROM r WHERE NOT video""")
def temporal_dedup(t: Tables) -> DataFrame:
    """Candidates in order of score; of those closer than 5 s to one kept before, in their source, none stays."""
    rows = t.queue.where("source_content_id is not null and candidate_id is not null and time_position_ms >= 0").groupBy(F.col("source_content_id").alias("src"), "candidate_id", F.col("time_position_ms").alias("t")).agg(F.max(F.coalesce(F.nanvl("candidate_score", F.lit(None).cast("double")), F.lit(-1.0))).alias("score"), F.max(F.coalesce(F.lower(F.trim("media_type")) == "video", F.lit(False))).alias("video"))
    kept = greedy.keep_apart(rows.where("video"), "src", "t", [("score", False), ("candidate_id", True), ("t", True)], 5000, "src string, candidate_id string, t bigint")
    return kept.unionAll(rows.where("not video").select("src", "candidate_id", "t"))


@query(f"WITH {FILES} SELECT source_file_id, min(source_file_id) OVER (PARTITION BY absolute_path) AS canonical_id, count(*) OVER (PARTITION BY absolute_path) AS members FROM s WHERE absolute_path IS NOT NULL")
def path_duplicates(t: Tables) -> DataFrame:
    return identity.path_duplicates(t.files.where("absolute_path is not null"), "absolute_path", "source_file_id").select("source_file_id", "canonical_id", "members")


@query(f"WITH {FILES} SELECT source_file_id FROM s WHERE size_bytes IN (SELECT size_bytes FROM s GROUP BY size_bytes HAVING count(*) > 1)")
def files_to_hash(t: Tables) -> DataFrame:
    return identity.hash_wanted(t.files, "size_bytes").select("source_file_id")


@query(f"""WITH {FILES}, {HASHED}, h AS (SELECT * FROM hashed WHERE d IS NOT NULL) SELECT source_file_id, first_value(source_file_id) OVER (PARTITION BY d ORDER BY length(relative_path) NULLS FIRST, relative_path NULLS FIRST, absolute_path NULLS FIRST, source_file_id) AS canonical_id, count(*) OVER (PARTITION BY d) AS members FROM h""")
def content_duplicates(t: Tables) -> DataFrame:
    h = t.files.withColumn("d", hashing.valid_hash(F.col("content_sha256"))).where("d is not null")
    return identity.content_canonical(h, "d", "relative_path", "absolute_path", "source_file_id").select("source_file_id", "canonical_id", "members")


@query(f"""WITH {FILES}, {HASHED}, c AS (SELECT source_file_id, lower(trim(support_status)) = 'supported' AS ok, count(*) OVER (PARTITION BY absolute_path) > 1 AND source_file_id > min(source_file_id) OVER (PARTITION BY absolute_path) AS p, d IS NOT NULL AND source_file_id > min(source_file_id) OVER (PARTITION BY d) AS c FROM hashed WHERE absolute_path IS NOT NULL)
    SELECT source_file_id, CASE WHEN NOT coalesce(ok, false) THEN 'unsupported_or_blocked' WHEN p THEN 'path_duplicate_alias' WHEN c THEN 'content_duplicate_alias' ELSE 'canonical' END AS role FROM c""")
def dedup_roles(t: Tables) -> DataFrame:
    f = t.files.where("absolute_path is not null")
    p = f.groupBy("absolute_path").agg(F.min("source_file_id").alias("p"))
    f = f.withColumn("d", hashing.valid_hash(F.col("content_sha256")))
    c = f.where("d is not null").groupBy("d").agg(F.min("source_file_id").alias("c"))
    j = f.join(p, "absolute_path").join(c, "d", "left")
    role = identity.dedup_role(F.coalesce(F.lower(F.trim("support_status")) == "supported", F.lit(False)), F.col("source_file_id") > F.col("p"), F.coalesce(F.col("source_file_id") > F.col("c"), F.lit(False)))
    return j.select("source_file_id", role.alias("role"))


@query(f"""WITH {FILES}, {HASHED}, k AS (SELECT source_file_id, size_bytes::VARCHAR || '/' || coalesce(stem_key, '') AS q, d AS h, absolute_path AS p FROM hashed WHERE size_bytes IS NOT NULL AND absolute_path IS NOT NULL),
    x AS (SELECT *, count(*) OVER (PARTITION BY q) AS peers, sum(CASE WHEN h IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY q) AS failed, count(*) OVER (PARTITION BY q, h) AS same, first_value(source_file_id) OVER (PARTITION BY q, h ORDER BY len(string_split(p, '/')), p, source_file_id) AS c FROM k),
    y AS (SELECT *, CASE WHEN peers = 1 THEN 'unique' WHEN failed > 0 THEN 'blocked_peer_failure' WHEN same = 1 THEN 'unique' WHEN c = source_file_id THEN 'canonical' ELSE 'exact_duplicate' END AS status FROM x)
    SELECT source_file_id, status, CASE WHEN status = 'exact_duplicate' THEN c ELSE source_file_id END AS canonical_id FROM y""")
def two_stage_identity(t: Tables) -> DataFrame:
    """Size and stem stand for the quick hash, since the tables hold no bytes."""
    f = t.files.where("size_bytes is not null and absolute_path is not null").withColumn("q", F.concat(F.col("size_bytes").cast("string"), F.lit("/"), F.coalesce("stem_key", F.lit(""))))
    f = f.withColumn("h", hashing.valid_hash(F.col("content_sha256")))
    return identity.two_stage_identity(f, "q", "h", "absolute_path", "source_file_id")


@query("WITH h AS (SELECT doc_id, sha256(text) AS text_sha FROM documents WHERE text IS NOT NULL) SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY text_sha) AS documents FROM h) WHERE documents > 1")
def exact_text_duplicates(t: Tables) -> DataFrame:
    return identity.exact_text_duplicates(t.documents.where("text is not null"), F.col("text"), "doc_id")


def _leaders(t: Tables) -> DataFrame:
    rows = t.frames.select("src", "id", "t", "luma", "std")
    near = lambda a, b: (abs(a["t"] - b["t"]) <= 30_000) & (abs(a["luma"] - b["luma"]) <= 1.0) & (abs(a["std"] - b["std"]) <= 1.0)
    return greedy.leaders(rows, "src", "src string, id string, leader string", [("std", False), ("t", True), ("id", True)], near, "id", "t", 30_000)


@query(f"""WITH RECURSIVE {FRAMES}, v AS (SELECT src, id, t, luma, std, row_number() OVER (PARTITION BY src ORDER BY std DESC, t, id) AS n FROM f),
    g AS (SELECT src, n, id, id AS leader, [{{'t': t, 'luma': luma, 'std': std, 'id': id}}] AS heads FROM v WHERE n = 1
      UNION ALL SELECT src, n, id, coalesce(met[1].id, id), CASE WHEN len(met) = 0 THEN list_append(heads, {{'t': t, 'luma': luma, 'std': std, 'id': id}}) ELSE heads END
      FROM (SELECT v.*, g.heads, list_filter(g.heads, lambda x: abs(x.t - v.t) <= 30000 AND abs(x.luma - v.luma) <= 1.0 AND abs(x.std - v.std) <= 1.0) AS met FROM g JOIN v ON v.src = g.src AND v.n = g.n + 1) w)
    SELECT src, id, leader FROM g""")
def leader_clusters(t: Tables) -> DataFrame:
    """Frames join the first leader that they resemble within 30 s; the sharpest come first."""
    return _leaders(t)


@query("SELECT a.vec_id AS query, b.vec_id AS item, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2")
def similar_vectors(t: Tables) -> DataFrame:
    """The stated queries (every id divisible by 100) against all vectors, in blocks of queries."""
    found = identity.scan_queries(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.2)
    return found.where("query <> item").select("query", "item", F.round("similarity", 4).alias("similarity"))


@query()
def identity_clusters(t: Tables) -> DataFrame:
    """All vectors, merged where centroids stay similar, in each component of the graph of all pairs of at least 0.5.

    The pairs are found exactly, in blocks. They are taken a little below the limit, as rounding differs by block; the merge tests the limit itself.
    """
    scratch = Scratch(t.spark, "identity")
    nodes = t.embeddings.select("vec_id", F.concat_ws("-", "label", (F.col("vec_id") % 7).cast("string")).alias("unit"), "embedding")
    edges = identity.scan_queries(nodes, nodes, "vec_id", "embedding", 0.5 - 1e-9).where("query < item").select(F.col("query").alias("a"), F.col("item").alias("b"))
    found = components.connected_components(edges, scratch=scratch).select(F.col("node").alias("vec_id"), F.col("label").alias("component"))
    placed = nodes.join(found, "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))
    return greedy.constrained_clusters(placed, "component", "vec_id", "unit", "embedding", 0.5)


@query(f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS rank, count(*) OVER (PARTITION BY src) AS n FROM f), m AS (SELECT *, least(n, greatest(1, ceil(round(n * 0.15::DOUBLE, 6))::BIGINT)) AS bins FROM r), b AS (SELECT *, (rank * bins + bins - 1) // n AS bin FROM m)
    SELECT src, bin, id FROM (SELECT *, row_number() OVER (PARTITION BY src, bin ORDER BY std > 40 DESC, std DESC, t, id) AS rn FROM b) WHERE rn = 1""")
def density_selection(t: Tables) -> DataFrame:
    return selection.density_selection(t.frames.withColumn("high", F.col("std") > 40), "src", "t", "id", "std", "high", 0.15).select("src", "bin", "id")


@query(f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS rank, count(*) OVER (PARTITION BY src) AS n FROM f), k AS (SELECT *, rank - n // 2 AS far FROM r WHERE (((rank - n // 2) % 6) + 6) % 6 = 0)
    SELECT src, id, row_number() OVER (PARTITION BY src ORDER BY abs(far), far) - 1 AS anchor, greatest(0, rank - 3) AS from_rank, least(n - 1, rank + 3) AS to_rank FROM k""")
def coverage_anchors(t: Tables) -> DataFrame:
    return selection.anchors(t.frames, "src", "t", "id").select("src", "id", "anchor", "from_rank", "to_rank")


_SIGNAL = f"""WITH {FRAMES}, {LABELS}, n AS (SELECT unit, count(*) AS k, bool_or(label = 'text') AS txt FROM l GROUP BY unit), j AS (SELECT f.*, coalesce(k, 0) AS k, coalesce(txt, false) AS txt FROM f LEFT JOIN n ON unit = id),
    c AS (SELECT *, greatest(coalesce(abs(luma - lag(luma) OVER w), 0), coalesce(abs(lead(luma) OVER w - luma), 0)) / 32.0::DOUBLE AS gc FROM j WINDOW w AS (PARTITION BY src ORDER BY t, id))"""


@query(_SIGNAL + " SELECT id, round(least(3.0, 0.9::DOUBLE * least(k, 4)) + least(2.0, k * 0.2::DOUBLE) + least(1.0, std / 24.0::DOUBLE) + least(1.0, gc) + CASE WHEN txt THEN 0.5::DOUBLE ELSE 0 END, 6) AS score FROM c")
def signal_scores(t: Tables) -> DataFrame:
    """The score of a frame from its labels and its change; detectors' areas and vectors aren't in the tables and count as none."""
    n = t.labels.groupBy("unit").agg(F.count("*").alias("k"), F.bool_or(F.col("label") == "text").alias("txt"))
    j = t.frames.join(n, F.col("id") == F.col("unit"), "left").withColumn("k", F.coalesce("k", F.lit(0))).withColumn("txt", F.coalesce("txt", F.lit(False)))
    c = windows.neighbour_max(j, "src", ["t", "id"], "luma", "gc")
    zero = F.lit(0.0)
    score = selection.signal_score(F.least(F.col("k"), F.lit(4)), F.col("k"), zero, zero, F.col("std"), zero, zero, F.col("gc") / 32.0, F.col("txt"))
    return c.select("id", score.alias("score"))


def _in_time(t: Tables) -> DataFrame:
    return t.frames.select("src", "id", "t", "std")


@query(f"""WITH RECURSIVE {FRAMES}, o AS (SELECT src, id, t, row_number() OVER (PARTITION BY src ORDER BY t, id) AS i FROM f), l AS (SELECT src, list({{'i': i, 't': t}} ORDER BY i) AS rows, min(t) AS first, max(t) AS last, count(*) AS n FROM o GROUP BY src),
    a AS (SELECT src, rows, unnest(generate_series(first + 6000, last, 6000)) AS anchor FROM l WHERE last - first > 6000),
    c AS (SELECT src, 1 AS i FROM l UNION SELECT src, n FROM l WHERE n > 1 AND last - first <= 6000 UNION SELECT src, list_sort(list_transform(rows, lambda x: {{'d': abs(x.t - anchor), 'i': x.i}}))[1].i FROM a),
    p AS (SELECT src, i AS lo, lead(i) OVER (PARTITION BY src ORDER BY i) AS hi FROM c),
    g AS (SELECT src, rows, lo, hi, false AS made FROM p JOIN l USING (src) WHERE hi IS NOT NULL
      UNION ALL SELECT src, rows, s.lo, s.hi, s.made FROM (SELECT src, rows, unnest([{{'lo': lo, 'hi': m, 'made': true}}, {{'lo': m, 'hi': hi, 'made': false}}]) AS s
        FROM (SELECT *, list_sort(list_transform(list_filter(rows, lambda x: x.t > rows[lo].t AND x.t < rows[hi].t), lambda x: {{'d': abs(x.t - (rows[lo].t + rows[hi].t) // 2), 't': x.t, 'i': x.i}}))[1].i AS m FROM g WHERE rows[hi].t - rows[lo].t > 10000) w WHERE m IS NOT NULL) z)
    SELECT src, id, t FROM o JOIN (SELECT src, i FROM c UNION SELECT src, hi FROM g WHERE made) USING (src, i)""")
def time_coverage(t: Tables) -> DataFrame:
    """A frame near every 6 s, and no gap over 10 s that a frame could fill."""
    return greedy.time_coverage(_in_time(t), "src", "t", "id", 6000, 10_000, "src string, id string, t bigint")


@query(f"""WITH RECURSIVE {FRAMES}, o AS (SELECT src, id, t, row_number() OVER (PARTITION BY src ORDER BY t, id) AS i FROM f), l AS (SELECT src, list({{'i': i, 't': t, 'id': id}} ORDER BY i) AS rows, min(t) AS first, max(t) AS last, count(*) AS n, (max(t) - min(t)) / 1000.0::DOUBLE AS s FROM o GROUP BY src),
    b AS (SELECT *, (CASE WHEN s < 20 THEN 1 WHEN s < 60 THEN 2 WHEN s < 180 THEN least(3, ceil(s / 60)) WHEN s < 600 THEN least(5, ceil(s / 60)) ELSE least(10, ceil(s / 60)) END)::INT AS budget FROM l),
    g AS (SELECT src, 0 AS step, budget, first, last, rows, CASE WHEN budget = 1 THEN [rows[n // 2 + 1]] ELSE rows[1:0] END AS chosen FROM b
      UNION ALL SELECT src, step + 1, budget, first, last, rows, CASE WHEN len(free) = 0 THEN chosen ELSE list_append(chosen, list_sort(list_transform(free, lambda x: {{'d': abs(x.t - anchor), 't': x.t, 'i': x.i, 'row': x}}))[1].row) END
      FROM (SELECT *, round_even(first + (last - first) * step / (budget - 1)::DOUBLE, 0)::BIGINT AS anchor, list_filter(rows, lambda x: len(list_filter(chosen, lambda c: abs(c.t - x.t) < 20000)) = 0) AS free FROM g WHERE budget > 1 AND step < budget) w)
    SELECT src, c.id AS id, c.t AS t FROM (SELECT src, unnest(chosen) AS c FROM g WHERE budget = 1 OR step = budget)""")
def spaced_representatives(t: Tables) -> DataFrame:
    """As many frames as a film's length is worth, 20 s apart."""
    w = Window.partitionBy("src")
    budget = selection.duration_budget((F.max("t").over(w) - F.min("t").over(w)) / 1000)
    return greedy.spaced_representatives(_in_time(t).withColumn("budget", budget.cast("int")), "src", "t", "id", "budget", 20_000, "src string, id string, t bigint")


@query(f"""WITH RECURSIVE {FRAMES}, v AS (SELECT src, id, t, std, row_number() OVER (PARTITION BY src ORDER BY t, id) AS n FROM f),
    g AS (SELECT src, n, 1 AS place, id, t, std FROM v WHERE n = 1 UNION ALL SELECT v.src, v.n, CASE WHEN v.t - g.t < 18000 THEN place ELSE place + 1 END, CASE WHEN v.t - g.t >= 18000 OR v.std > g.std THEN v.id ELSE g.id END,
      CASE WHEN v.t - g.t >= 18000 OR v.std > g.std THEN v.t ELSE g.t END, CASE WHEN v.t - g.t >= 18000 OR v.std > g.std THEN v.std ELSE g.std END FROM g JOIN v ON v.src = g.src AND v.n = g.n + 1)
    SELECT src, max_by(id, n) AS id, max_by(t, n) AS t FROM g GROUP BY src, place""")
def better_of_near(t: Tables) -> DataFrame:
    return greedy.better_of_near(_in_time(t), "src", "t", "std", "id", 18_000, "src string, id string, t bigint")


@query("WITH RECURSIVE" + NOVEL.format(rows=f"{FRAMES}, r AS (SELECT src, id, t, luma, std FROM f)", alike="abs(x.t - v.t) <= 12000 AND abs(x.std - v.std) <= 2.0", cap=5))
def coverage_novel(t: Tables) -> DataFrame:
    """Up to five frames of a source, sharpest first, that resemble none chosen before."""
    alike = lambda a, b: (abs(a["t"] - b["t"]) <= 12_000) & (abs(a["std"] - b["std"]) <= 2.0)
    return greedy.novel_first(_in_time(t), "src", "src string, id string, t bigint", [("std", False), ("t", True), ("id", True)], alike, 5, "t", 12_000)


@query(f"""WITH {FRAMES}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 60000 THEN 1 ELSE 0 END AS s FROM f WINDOW w AS (PARTITION BY src ORDER BY t, id)), i AS (SELECT *, sum(s) OVER (PARTITION BY src ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g),
    d AS (SELECT *, CASE WHEN lag(island) OVER w = island THEN t - lag(t) OVER w END AS gap FROM i WINDOW w AS (PARTITION BY src ORDER BY t, id))
    SELECT src, island, count(*) AS images, median(gap) AS median_gap, round(avg(CASE WHEN gap IS NULL THEN NULL WHEN gap BETWEEN 100 AND 20000 THEN 1 ELSE 0 END), 6) AS valid_ratio, min(t) AS start_ms, max(t) AS end_ms FROM d GROUP BY src, island
    HAVING count(*) >= 10 AND median(gap) BETWEEN 100 AND 20000 AND avg(CASE WHEN gap IS NULL THEN NULL WHEN gap BETWEEN 100 AND 20000 THEN 1 ELSE 0 END) >= 0.85""")
def timelapse_groups(t: Tables) -> DataFrame:
    return selection.timelapse(t.frames, "src", "t", "id", 10, 60_000, 100, 20_000).withColumn("valid_ratio", F.round("valid_ratio", 6))


@query(f"""WITH {FILES}, x AS (SELECT source_file_id AS id, 100 AS p FROM s WHERE finder_tags_json LIKE '["%' UNION ALL SELECT source_file_id, 90 FROM s WHERE lower(trim(dedup_role)) = 'canonical' UNION ALL SELECT source_file_id, 80 FROM s WHERE lower(trim(media_kind)) = 'image') SELECT id, max(p) AS priority FROM x GROUP BY id""")
def seed_images(t: Tables) -> DataFrame:
    f = t.files.withColumnRenamed("source_file_id", "id")
    return selection.seed_union({100: f.where("finder_tags_json like '[\"%'"), 90: f.where(F.lower(F.trim("dedup_role")) == "canonical"), 80: f.where(F.lower(F.trim("media_kind")) == "image")}, "id")


@query(f"""WITH {FILES} SELECT source_file_id, CASE WHEN finder_tags_json IS NULL OR finder_tags_json NOT LIKE '["%' THEN 'untagged' WHEN lower(trim(media_kind)) IS DISTINCT FROM 'image' THEN 'non_image' WHEN a.source_content_id IS NULL THEN 'unmapped' WHEN coalesce(is_deleted_or_missing, 0) = 1 THEN 'unavailable' ELSE 'mapped' END AS class FROM s LEFT JOIN source_assets a USING (source_content_id)""")
def tag_audit(t: Tables) -> DataFrame:
    a = t.source_assets.select("source_content_id", F.coalesce("is_deleted_or_missing", F.lit(0)).alias("gone"))
    tagged = F.coalesce(F.col("finder_tags_json").like('["%'), F.lit(False))
    cls = F.when(~tagged, "untagged").when(~F.lower(F.trim("media_kind")).eqNullSafe("image"), "non_image").when(F.col("gone").isNull(), "unmapped").when(F.col("gone") == 1, "unavailable").otherwise("mapped")
    return t.files.join(a, "source_content_id", "left").select("source_file_id", cls.alias("class"))


_NAME = r"trim(regexp_replace(lower(" + narrow("label") + r"), '[\s\x0b\x85\p{Z}_-]+', ' ', 'g'))"
_PAIRS = f"""WITH {FRAMES}, {LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) AS r FROM f), p AS (SELECT a.id AS anchor, b.id AS target, abs(a.r - b.r) AS step FROM r a JOIN r b ON a.src = b.src AND a.r <> b.r AND abs(a.r - b.r) <= 3),
    g AS (SELECT {_NAME} AS n, unnest(list_concat([label, label_zh], {LISTED})) AS term FROM visual_label_terms),
    y AS (SELECT label, {_NAME} AS n FROM (SELECT DISTINCT label FROM l)),
    z AS (SELECT DISTINCT label, {SQUEEZED.format('term')} AS term FROM (SELECT label, term FROM y JOIN g USING (n) WHERE n <> '' UNION ALL SELECT label, label FROM y)),
    o AS (SELECT DISTINCT visual_unit_id AS unit, {SQUEEZED.format('text')} AS x FROM documents WHERE visual_unit_id IS NOT NULL AND text IS NOT NULL AND {STRIP.format("lower(source)")} = 'qwenvl_caption'),
    m AS (SELECT DISTINCT unit, label FROM o JOIN l USING (unit) JOIN z USING (label) WHERE term NOT IN ('', '人', '车') AND CASE WHEN regexp_matches(term, '[a-z0-9]') THEN regexp_matches(x, '(^|[^a-z0-9])' || regexp_escape(term) || '($|[^a-z0-9])') ELSE contains(x, term) END),
    c AS (SELECT anchor, target, step, label FROM p JOIN m ON m.unit = anchor WHERE EXISTS (SELECT 1 FROM l WHERE l.unit = anchor AND l.label = m.label) AND EXISTS (SELECT 1 FROM l WHERE l.unit = target AND l.label = m.label)),
    i AS (SELECT *, count(*) OVER (PARTITION BY anchor, target) AS overlap FROM c),
    e AS (SELECT *, round(greatest(0.1, least(0.95, CASE step WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END + CASE WHEN overlap <= 1 THEN -0.05::DOUBLE WHEN overlap >= 3 THEN 0.03::DOUBLE ELSE 0 END)), 3) AS confidence FROM i)"""


#: Signs that occur inside too many other words to be a mention by themselves.
AMBIGUOUS = ("人", "车")


def _label_terms(t: Tables) -> DataFrame:
    """``label, term`` of every label that a unit has: its own spelling, and what the registry lists for its normal form.

    The registry is found by NFKC, lower case and single blanks for ``_`` and ``-``, so each spelling of a label has all of its terms.
    """
    normal = lambda c: F.trim(F.regexp_replace(F.lower(text.nfkc(F.col(c))), r"(?U)[\s_-]+", " "))
    listed = F.coalesce(F.from_json("search_terms_json", "array<string>"), F.array().cast("array<string>"))
    registry = t.visual_label_terms.select(normal("label").alias("n"), F.explode(F.concat(F.array("label", "label_zh"), listed)).alias("term")).where("n <> ''")
    known = t.labels.select("label").distinct()
    every = known.withColumn("n", normal("label")).join(registry, "n").select("label", "term").unionAll(known.select("label", F.col("label").alias("term")))
    return every.select("label", _squeezed("term").alias("term")).where((F.col("term") != "") & ~F.col("term").isin(*AMBIGUOUS)).distinct()


def _squeezed(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[\s\x1c-\x1f]+", " "))


def _propagated(t: Tables) -> DataFrame:
    """Captions are the anchors (the tables have no status or confidence: each caption passed, each label was seen).

    Only labels of a text's own unit can leave it, so texts meet these by an equi-join on the unit; then each of their terms is tested.
    """
    texts = t.documents.select("visual_unit_id", _squeezed("text").alias("text"), F.lower(text.strip(F.col("source"))).alias("modality"), F.lit("PASS").alias("status"))
    own = evidence.anchor_texts(texts, "visual_unit_id", "text", "modality", "status", ("qwenvl_caption",)).distinct()
    met = own.join(t.labels, "unit").join(_label_terms(t), "label").where(text.term_matches(F.col("text"), F.col("term")))
    said = Scratch(t.spark, "propagated").put(met.select("unit", "label").distinct(), "said")
    return evidence.propagate(evidence.neighbours(t.frames, "src", "t", "id", anchors=said), said, t.labels, own=True)


@query(_PAIRS + " SELECT anchor, target, step, overlap, label, confidence FROM e")
def propagated_labels(t: Tables) -> DataFrame:
    return _propagated(t)


@query(_PAIRS + " SELECT target, string_agg(DISTINCT label, '|' ORDER BY label) AS labels, string_agg(DISTINCT anchor, '|' ORDER BY anchor) AS anchors, max(confidence) AS confidence FROM e GROUP BY target")
def propagation_targets(t: Tables) -> DataFrame:
    return evidence.roll_up(_propagated(t))


_EV = "SELECT visual_unit_id AS unit, text, doc_id, '{0}' AS modality FROM documents WHERE lower(trim(source)) = '{1}'"


@query(f"SELECT unit, doc_id, modality, 'ev_' || substring(sha256(concat_ws(chr(31), modality, coalesce(unit, ''), coalesce(text, ''))), 1, 28) AS evidence_key FROM ({_EV.format('caption', 'qwenvl_caption')} UNION ALL {_EV.format('ocr', 'ocr_text')})")
def staged_evidence(t: Tables) -> DataFrame:
    of = lambda s: t.documents.where(F.lower(F.trim("source")) == s).select(F.col("visual_unit_id").alias("unit"), "text", "doc_id")
    return evidence.stage(of("qwenvl_caption"), of("ocr_text")).select("unit", "doc_id", "modality", "evidence_key")


@query("WITH d AS (SELECT DISTINCT visual_unit_id AS unit, sha256(text) AS sha, text FROM documents WHERE visual_unit_id IS NOT NULL AND " + STRIP.format('text') + " <> '') SELECT unit, count(*) AS parts, string_agg(text, chr(10) || chr(10) ORDER BY sha) AS document FROM d GROUP BY unit")
def unit_documents(t: Tables) -> DataFrame:
    return evidence.documents(t.documents.where("visual_unit_id is not null"), "visual_unit_id", "text").select(F.col("visual_unit_id").alias("unit"), "parts", "document")


@query("SELECT sha256(coalesce(text, '')) AS text_sha, count(*) AS documents, min(doc_id) AS first_document FROM documents GROUP BY 1")
def reuse_jobs(t: Tables) -> DataFrame:
    return evidence.reuse_jobs(t.documents, "doc_id", "text")


@query("SELECT visual_unit_id AS unit, min(source_content_id) AS a, max(source_content_id) AS b FROM documents WHERE visual_unit_id IS NOT NULL GROUP BY 1 HAVING min(source_content_id) <> max(source_content_id)")
def identity_conflicts(t: Tables) -> DataFrame:
    return evidence.conflicts(t.documents.where("visual_unit_id is not null").withColumnRenamed("visual_unit_id", "unit"), "unit", "source_content_id")


@query("WITH k AS (SELECT visual_unit_id AS unit, bool_or(document_kind LIKE 'direct%') AS d, bool_or(document_kind LIKE '%propagation%') AS p FROM documents WHERE visual_unit_id IS NOT NULL GROUP BY 1) SELECT unit, CASE WHEN d AND p THEN 'direct_and_propagation' WHEN d THEN 'direct_only' ELSE 'propagation_only' END AS kind FROM k")
def document_kinds(t: Tables) -> DataFrame:
    k = t.documents.where("visual_unit_id is not null").groupBy(F.col("visual_unit_id").alias("unit")).agg(F.bool_or(F.startswith("document_kind", F.lit("direct"))).alias("d"), F.bool_or(F.contains("document_kind", F.lit("propagation"))).alias("p"))
    return k.select("unit", evidence.document_kind(F.col("d"), F.col("p")).alias("kind"))


@query(f"WITH {QUEUE} SELECT sum(CASE WHEN candidate_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, count(*) AS rows, (SELECT count(*) FROM (SELECT candidate_id FROM q WHERE candidate_id IS NOT NULL GROUP BY candidate_id HAVING count(*) > 1)) AS repeated FROM q")
def queue_validation(t: Tables) -> DataFrame:
    return audit.unique_and_present(t.queue, "candidate_id").withColumn("repeated", F.coalesce("repeated", F.lit(0)))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, count(l_orderkey) AS items, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS ok FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderkey, items FROM o WHERE items = ok""")
def complete_runs(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linestatus") == "F").alias("ok"))
    runs = t.orders.select("o_orderkey").join(items.groupBy("o_orderkey").agg(F.count("*").alias("planned")), "o_orderkey")
    return audit.balanced_runs(runs, items, "o_orderkey").select("o_orderkey", "items")


@query(f"""WITH {FRAMES} SELECT (SELECT count(*) FROM source_assets) AS assets, (SELECT coalesce(sum(size_bytes), 0)::BIGINT FROM source_assets) AS bytes, (SELECT count(*) FROM f) AS frames, (SELECT count(DISTINCT src) FROM f) AS sources, (SELECT count(*) FROM documents) AS documents""")
def overview(t: Tables) -> DataFrame:
    parts = [
        t.source_assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")),
        t.frames.agg(F.count("*").alias("frames"), F.countDistinct("src").alias("sources")), t.documents.agg(F.count("*").alias("documents")),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each


@query(f"""WITH {FRAMES}, {LABELS}, s AS (SELECT 1 AS stage, count(DISTINCT source_content_id) AS total, count(DISTINCT CASE WHEN size_bytes IS NOT NULL THEN source_content_id END) AS done FROM source_assets
    UNION ALL SELECT 2, count(*), count(*) FILTER (WHERE id IN (SELECT unit FROM l)) FROM f UNION ALL SELECT 3, count(*), count(*) FILTER (WHERE id IN (SELECT visual_unit_id FROM documents)) FROM f)
    SELECT stage, total, done, round(100.0 * done / total, 2) AS percent FROM s""")
def stage_progress(t: Tables) -> DataFrame:
    of = lambda n, df: df.select(F.lit(n).alias("stage"), F.col("total").cast("bigint"), F.col("done").cast("bigint"))
    got = lambda other: t.frames.join(other.distinct().withColumn("has", F.lit(1)), "id", "left").agg(F.count("*").alias("total"), F.count("has").alias("done"))
    assets = t.source_assets.agg(F.countDistinct("source_content_id").alias("total"), F.countDistinct(F.when(F.col("size_bytes").isNotNull(), F.col("source_content_id"))).alias("done"))
    s = of(1, assets).unionAll(of(2, got(t.labels.select(F.col("unit").alias("id"))))).unionAll(of(3, got(t.documents.select(F.col("visual_unit_id").alias("id")))))
    return s.withColumn("percent", F.round(100.0 * F.col("done") / F.col("total"), 2))


@query("""WITH i AS (SELECT l_orderkey, count(*) AS total, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS done FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, round(CASE WHEN done > 0 THEN 60.0::DOUBLE / done * greatest(total - done, 0) ELSE 13.0::DOUBLE / 3 * greatest(total - done, 0) END, 6) AS eta FROM orders JOIN i ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'""")
def active_runs(t: Tables) -> DataFrame:
    """What is left of each run: from a minute's pace so far, or 13 s an item with three workers."""
    i = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("total"), F.sum((F.col("l_linestatus") == "F").cast("int")).alias("done"))
    eta = times.eta_seconds(F.lit(60.0), F.col("done"), F.col("total"), F.lit(13.0), F.lit(3))
    return t.orders.where("o_orderstatus <> 'F'").join(i, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.round(eta, 6).alias("eta"))


@query("SELECT 'documents' AS child, count(*) AS orphans FROM documents WHERE source_content_id IS NOT NULL AND source_content_id NOT IN (SELECT source_content_id FROM source_assets WHERE source_content_id IS NOT NULL) UNION ALL SELECT 'labels', count(*) FROM yolo_visual_unit_label WHERE visual_unit_id IS NOT NULL AND visual_unit_id NOT IN (SELECT visual_unit_id FROM visual_units WHERE visual_unit_id IS NOT NULL)")
def integrity(t: Tables) -> DataFrame:
    count = lambda n, df: df.agg(F.count("*").alias("orphans")).select(F.lit(n).alias("child"), "orphans")
    return count("documents", tables.orphans(t.documents, "source_content_id", t.source_assets, "source_content_id")).unionAll(count("labels", tables.orphans(t.yolo_visual_unit_label, "visual_unit_id", t.visual_units, "visual_unit_id")))


@query(QUALITY.replace("coalesce(lower(trim(source)) = 'ocr_text', false) AS ocr", "false AS ocr").replace("SELECT doc_id, longest_run, degenerate, quality_score, CASE", """, x AS (SELECT q.doc_id, lower(trim(d.source)) AS src, quality_score AS score, length(d.text) AS n FROM q JOIN documents d USING (doc_id)),
    u AS ((SELECT doc_id, 1 AS p, score FROM x ORDER BY score DESC, doc_id LIMIT 20) UNION ALL (SELECT doc_id, 2, score FROM x ORDER BY n DESC, doc_id LIMIT 20) UNION ALL (SELECT doc_id, 3, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, doc_id) AS k FROM x) WHERE k = 1) UNION ALL (SELECT doc_id, 4, score FROM x ORDER BY score DESC, doc_id LIMIT 60))
    SELECT doc_id, min(p) AS reason, max(score) AS score FROM u GROUP BY doc_id ORDER BY reason, score DESC, doc_id LIMIT 60 --"""))
def review_sample(t: Tables) -> DataFrame:
    """Sixty documents to look at: the worst, the longest, the worst of each source, then more of the worst."""
    q = text.text_quality(F.col("text"), F.lit(False))
    scored = t.documents.where("text is not null").select("doc_id", F.lower(F.trim("source")).alias("src"), q["quality_score"].alias("score"), F.length("text").alias("length"))
    return audit.review_sample(scored, "doc_id", "src", "score", "length", 20, 20, 60).select("doc_id", "reason", "score")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS begins FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, sum(begins)::BIGINT AS sessions, count(*) AS events FROM e GROUP BY user_id""")
def streamed_sessions(t: Tables) -> DataFrame:
    """The event table as a stream: sessions with gaps under eight hours. Each batch's result replaces the one before in the shared folder; nothing goes through the driver."""
    from framelode.streaming import streams

    root = Scratch(t.spark, "sessions").root
    events = t.spark.readStream.schema(t.events.schema).format("parquet").option("pathGlobFilter", "events.parquet").load(t.d)
    made = streams.sessions(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "8 hours", "1 hour")
    streams.write_latest(made, f"{root}/out", f"{root}/state").awaitTermination()
    return t.spark.read.schema(made.schema).parquet(f"{root}/out").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))

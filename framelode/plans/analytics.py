"""Aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode.functions import hashing
from framelode.operators import aggregates, audit, windows
from framelode.plans.base import FILES, FRAMES, LABELS, QUEUE, Tables, query

#: Bands into which the span of a source is cut.
BANDS = 3

W = "WINDOW w AS (PARTITION BY src ORDER BY t, id)"


@query("SELECT media_type, count(*) AS n, count(DISTINCT source_content_id) AS assets, coalesce(sum(size_bytes), 0)::BIGINT AS bytes, min(coalesce(mtime, 0)) AS oldest, max(coalesce(mtime, 0)) AS newest FROM source_assets GROUP BY media_type")
def assets_by_media(t: Tables) -> DataFrame:
    return t.source_assets.groupBy("media_type").agg(F.count("*").alias("n"), F.countDistinct("source_content_id").alias("assets"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.min(F.coalesce("mtime", F.lit(0))).alias("oldest"), F.max(F.coalesce("mtime", F.lit(0))).alias("newest"))


@query(f"WITH {LABELS}, c AS (SELECT label, count(*) AS units FROM l GROUP BY label HAVING count(*) >= 20) SELECT * FROM c")
def frequent_labels(t: Tables) -> DataFrame:
    return t.labels.groupBy("label").agg(F.count("*").alias("units")).where("units >= 20")


@query("SELECT count(*) AS repeated FROM (SELECT visual_unit_id FROM visual_units GROUP BY visual_unit_id HAVING count(*) > 1)")
def repeated_units(t: Tables) -> DataFrame:
    return t.visual_units.groupBy("visual_unit_id").count().where("count > 1").agg(F.count("*").alias("repeated"))


@query(f"WITH {LABELS} SELECT unit, string_agg(label, '|' ORDER BY label) AS labels, count(*) AS n FROM l GROUP BY unit")
def label_lists(t: Tables) -> DataFrame:
    return t.labels.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("labels"), F.count("*").alias("n"))


@query(f"WITH {QUEUE} SELECT canonical_visual_unit_id AS canonical, min(coalesce(time_position_ms, -1)) AS first_ms, count(DISTINCT visual_unit_id) AS members, (count(visual_unit_id) - count(DISTINCT visual_unit_id)) AS collapsed FROM q GROUP BY canonical_visual_unit_id")
def alias_groups(t: Tables) -> DataFrame:
    return t.queue.groupBy(F.col("canonical_visual_unit_id").alias("canonical")).agg(F.min(F.coalesce("time_position_ms", F.lit(-1))).alias("first_ms"), F.countDistinct("visual_unit_id").alias("members"), (F.count("visual_unit_id") - F.countDistinct("visual_unit_id")).alias("collapsed"))


@query("SELECT l_returnflag AS flag, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_F, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS n_O, count(*) AS total FROM lineitem GROUP BY l_returnflag")
def item_status(t: Tables) -> DataFrame:
    return aggregates.status_pivot(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"]).withColumnRenamed("l_returnflag", "flag")


@query("SELECT event_type, round(avg(value), 2) AS mean, round(max(value), 2) AS most, round(avg(CASE WHEN value > 50 THEN value END), 2) AS mean_high FROM events GROUP BY event_type")
def event_means(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("mean"), F.round(F.max("value"), 2).alias("most"), F.round(F.avg(F.when(F.col("value") > 50, F.col("value"))), 2).alias("mean_high"))


@query("SELECT reason, count(*) AS n FROM (SELECT trim(unnest(string_split(reason_codes, '|'))) AS reason FROM stop03_2_candidate_queue_items) WHERE reason <> '' GROUP BY reason")
def reason_counts(t: Tables) -> DataFrame:
    return aggregates.reason_counts(t.stop03_2_candidate_queue_items, "reason_codes")


@query(f"""WITH {FILES}, k AS (SELECT folder_path AS folder, media_kind AS kind, count(*) AS n FROM s WHERE folder_path IS NOT NULL AND media_kind IS NOT NULL GROUP BY ALL)
    SELECT folder, string_agg(kind || '=' || n, '|' ORDER BY kind) AS kinds FROM k GROUP BY folder""")
def media_by_folder(t: Tables) -> DataFrame:
    """Counts per kind as one text; ``map_from_entries`` of the same pairs gives a map."""
    k = t.files.where("folder_path is not null and media_kind is not null").groupBy(F.col("folder_path").alias("folder"), "media_kind").agg(F.count("*").alias("n"))
    return k.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "media_kind", F.col("n").cast("string")))), "|").alias("kinds"))


@query(f"WITH {QUEUE} SELECT source_content_id, max(candidate_score) AS best, max_by(candidate_id, (candidate_score, candidate_id)) AS candidate_id, bool_or(black_frame_status = 'near_black') AS any_black FROM q WHERE candidate_score IS NOT NULL AND NOT isnan(candidate_score) GROUP BY source_content_id")
def best_candidate(t: Tables) -> DataFrame:
    rows = t.queue.where("candidate_score is not null and not isnan(candidate_score)")
    return rows.groupBy("source_content_id").agg(F.max("candidate_score").alias("best"), F.max_by("candidate_id", F.struct("candidate_score", "candidate_id")).alias("candidate_id"), F.bool_or(F.col("black_frame_status") == "near_black").alias("any_black"))


@query(f"WITH {FRAMES} SELECT src, string_agg(id, '|' ORDER BY t, id) AS members FROM f GROUP BY src")
def member_lists(t: Tables) -> DataFrame:
    return t.frames.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]), "|").alias("members"))


_P = "SELECT l_returnflag AS flag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem"


@query(f"SELECT flag, v AS value FROM ({_P}) WHERE r = ceil(0.9 * n) - 1")
def percentile_nearest(t: Tables) -> DataFrame:
    return aggregates.percentile_nearest(t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), ["flag"], "l_extendedprice", 0.9)


@query(f"SELECT flag, v AS value FROM ({_P}) WHERE r = round_even((n - 1) * 0.9, 0)")
def percentile_round(t: Tables) -> DataFrame:
    return aggregates.percentile_round(t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), ["flag"], "l_extendedprice", 0.9)


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(median(l_quantity), 4) AS middle FROM lineitem GROUP BY l_returnflag")
def percentile_linear(t: Tables) -> DataFrame:
    flagged = t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_extendedprice", "l_quantity")
    price = aggregates.percentiles_linear(flagged, ["flag"], "l_extendedprice", {"p90": 0.9})
    quantity = aggregates.percentiles_linear(flagged, ["flag"], "l_quantity", {"middle": 0.5})
    return price.join(quantity, "flag").select("flag", F.round("p90", 4).alias("p90"), F.round("middle", 4).alias("middle"))


@query(f"WITH {FRAMES} SELECT src, min(luma) AS least, round(quantile_cont(luma, 0.5), 6) AS p50, round(quantile_cont(luma, 0.9), 6) AS p90, max(luma) AS most, count(luma) AS n FROM f GROUP BY src")
def luma_summary(t: Tables) -> DataFrame:
    s = aggregates.percentiles_linear(t.frames, ["src"], "luma", {"least": 0.0, "p50": 0.5, "p90": 0.9, "most": 1.0})
    return s.select("src", "least", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), "most", "n")


@query(f"""WITH {QUEUE}, c AS (SELECT count(candidate_id) AS k FROM source_assets a LEFT JOIN q USING (source_content_id) GROUP BY a.source_content_id),
    b AS (SELECT CASE WHEN k <= 5 THEN k::VARCHAR WHEN k <= 10 THEN '6-10' WHEN k <= 20 THEN '11-20' ELSE '>20' END AS bucket, count(*) AS n FROM c GROUP BY 1)
    SELECT bucket, position, coalesce(n, 0) AS n FROM (SELECT unnest(['0', '1', '2', '3', '4', '5', '6-10', '11-20', '>20']) AS bucket, unnest(generate_series(0, 8)) AS position) LEFT JOIN b USING (bucket)""")
def candidates_per_source(t: Tables) -> DataFrame:
    k = t.source_assets.select("source_content_id").join(t.queue.select("source_content_id", "candidate_id"), "source_content_id", "left").groupBy("source_content_id").agg(F.count("candidate_id").alias("k"))
    return aggregates.bucket_histogram(k, "k")


@query("""WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
    SELECT round(sum(CASE WHEN r <= 1 THEN v END) / sum(v), 9) AS top1_share, round(sum(CASE WHEN r <= 5 THEN v END) / sum(v), 9) AS top5_share, round(sum(CASE WHEN r <= 10 THEN v END) / sum(v), 9) AS top10_share FROM r""")
def top_order_share(t: Tables) -> DataFrame:
    s = aggregates.top_share(t.orders, "o_totalprice", "o_orderkey")
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query(f"WITH {FRAMES}, c AS (SELECT src, count(*) AS part FROM f GROUP BY src) SELECT src, round(part / (SELECT sum(part) FROM c), 9) AS share FROM c WHERE part > 0.05 * (SELECT sum(part) FROM c)")
def source_concentration(t: Tables) -> DataFrame:
    return aggregates.concentration(t.frames.withColumn("one", F.lit(1)), "src", "one", 0.05).select("src", F.round("share", 9).alias("share"))


@query(f"WITH {QUEUE}, g AS (SELECT media_type, count(*) AS n, sum(CASE WHEN black_frame_status = 'near_black' THEN 1 ELSE 0 END)::BIGINT AS black, sum(CASE WHEN candidate_score > 3 THEN 1 ELSE 0 END)::BIGINT AS high FROM q GROUP BY media_type) SELECT *, round(n / sum(n) OVER (), 6) AS share FROM g")
def candidate_shares(t: Tables) -> DataFrame:
    return audit.shares(t.queue, "media_type", {"black": F.coalesce(F.col("black_frame_status") == "near_black", F.lit(False)), "high": F.coalesce(F.col("candidate_score") > 3, F.lit(False))})


@query(f"WITH {QUEUE} SELECT kind, sha256(string_agg(candidate_id, chr(10) ORDER BY candidate_id)) AS digest, count(candidate_id) AS n FROM q GROUP BY kind")
def queue_digests(t: Tables) -> DataFrame:
    return t.queue.groupBy("kind").agg(hashing.set_digest(F.col("candidate_id")).alias("digest"), F.count("candidate_id").alias("n"))


@query(f"""WITH {QUEUE}, d AS (SELECT candidate_id, kind, sha256('{{"kind":' || coalesce('"' || kind || '"', 'null') || ',"unit":' || coalesce('"' || visual_unit_id || '"', 'null') || '}}') AS d FROM q WHERE candidate_id IS NOT NULL)
    SELECT kind, sha256(string_agg(d, chr(10) ORDER BY candidate_id, d)) AS digest FROM d GROUP BY kind""")
def queue_semantic_digest(t: Tables) -> DataFrame:
    rows = t.queue.where("candidate_id is not null").select("candidate_id", "kind", hashing.row_digest({"kind": F.col("kind"), "unit": F.col("visual_unit_id")}).alias("d"))
    return rows.groupBy("kind").agg(hashing.ordered_digest(F.struct("candidate_id", "d"), F.col("d")).alias("digest"))


@query(f"""WITH a AS (SELECT DISTINCT visual_unit_id AS id FROM visual_units WHERE visual_unit_id IS NOT NULL), b AS (SELECT DISTINCT visual_unit_id AS id FROM yolo_visual_unit_label WHERE visual_unit_id IS NOT NULL), c AS (SELECT DISTINCT visual_unit_id AS id FROM documents WHERE visual_unit_id IS NOT NULL),
    i AS (SELECT id, max(x) AS units, max(y) AS labels, max(z) AS documents FROM (SELECT id, 1 AS x, 0 AS y, 0 AS z FROM a UNION ALL SELECT id, 0, 1, 0 FROM b UNION ALL SELECT id, 0, 0, 1 FROM c) GROUP BY id) SELECT units, labels, documents, count(*) AS n FROM i GROUP BY ALL""")
def unit_overlap(t: Tables) -> DataFrame:
    ids = lambda df: df.where("visual_unit_id is not null").select(F.col("visual_unit_id").alias("id"))
    return aggregates.venn({"units": ids(t.visual_units), "labels": ids(t.yolo_visual_unit_label), "documents": ids(t.documents)}, "id")


@query(f"""WITH {FILES} SELECT split_part(relative_path, '/', 1) AS top, lower(extension) AS ext, sum(size_bytes)::BIGINT AS bytes, count(*) AS files FROM s GROUP BY ALL ORDER BY bytes DESC NULLS LAST, top NULLS LAST, ext NULLS LAST LIMIT 20""")
def storage_by_folder(t: Tables) -> DataFrame:
    g = t.files.groupBy(F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("top"), F.lower("extension").alias("ext")).agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("files"))
    return g.orderBy(F.desc_nulls_last("bytes"), F.asc_nulls_last("top"), F.asc_nulls_last("ext")).limit(20)


@query(f"WITH {FRAMES}, {LABELS} SELECT src, label FROM f JOIN l ON unit = id GROUP BY src, label HAVING count(*) = 1")
def rare_labels(t: Tables) -> DataFrame:
    return aggregates.rare_values(t.frames.join(t.labels, F.col("id") == F.col("unit")), ["src"], "label")


@query("SELECT coalesce(media_type, 'all') AS media_type, coalesce(extension, 'all') AS extension, count(*) AS n, count(DISTINCT volume_id) AS volumes FROM (SELECT coalesce(media_type, '?') AS media_type, coalesce(lower(extension), '?') AS extension, volume_id FROM source_assets) GROUP BY CUBE (media_type, extension)")
def asset_cube(t: Tables) -> DataFrame:
    a = t.source_assets.select(F.coalesce("media_type", F.lit("?")).alias("media_type"), F.coalesce(F.lower("extension"), F.lit("?")).alias("extension"), "volume_id")
    c = a.cube("media_type", "extension").agg(F.count("*").alias("n"), F.countDistinct("volume_id").alias("volumes"))
    return c.select(F.coalesce("media_type", F.lit("all")).alias("media_type"), F.coalesce("extension", F.lit("all")).alias("extension"), "n", "volumes")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_snapshot(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id")


@query(f"WITH {FRAMES} SELECT id, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS sampled_index, row_number() OVER (PARTITION BY src ORDER BY luma DESC, id) AS luma_rank, round(cume_dist() OVER (PARTITION BY src ORDER BY std), 9) AS relative_std FROM f")
def frame_indexes(t: Tables) -> DataFrame:
    p = Window.partitionBy("src")
    return t.frames.select("id", (F.row_number().over(p.orderBy("t", "id")) - 1).alias("sampled_index"), F.row_number().over(p.orderBy(F.desc("luma"), "id")).alias("luma_rank"), F.round(F.cume_dist().over(p.orderBy("std")), 9).alias("relative_std"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders")
def global_rank(t: Tables) -> DataFrame:
    return windows.global_rank(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "position").select("o_orderkey", "position")


@query(f"WITH {FRAMES} SELECT id, round(abs(luma - lag(luma) OVER w), 6) AS change, greatest(coalesce(abs(luma - lag(luma) OVER w), 0), coalesce(abs(lead(luma) OVER w - luma), 0)) > 20 AS is_change, luma >= coalesce(lag(luma) OVER w, luma) AND luma >= coalesce(lead(luma) OVER w, luma) AS is_peak FROM f {W}")
def luma_changes(t: Tables) -> DataFrame:
    x = windows.neighbour_max(windows.local_peaks(t.frames, "src", ["t", "id"], "luma"), "src", ["t", "id"], "luma", "novelty")
    lag = F.lag("luma").over(windows.in_source("src", "t", "id"))
    return x.select("id", F.round(F.abs(F.col("luma") - lag), 6).alias("change"), (F.col("novelty") > 20).alias("is_change"), "is_peak")


@query(f"""WITH {FRAMES}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 30000 THEN 1 ELSE 0 END AS s FROM f {W}), i AS (SELECT *, sum(s) OVER (PARTITION BY src ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g)
    SELECT src, island, count(*) AS frames, min(t) AS start_ms, max(t) AS end_ms, max(t) - min(t) AS span_ms FROM i GROUP BY src, island""")
def gap_sessions(t: Tables) -> DataFrame:
    return windows.island_sizes(windows.gap_islands(t.frames, "src", "t", "id", 30_000), ["src", "island"], "t")


@query(f"""WITH {FRAMES}, c AS (SELECT *, CASE WHEN luma < 60 THEN 'dark' WHEN luma > 160 THEN 'bright' ELSE 'mid' END AS k FROM f), g AS (SELECT *, CASE WHEN lag(k) OVER w IS NOT NULL AND k <> lag(k) OVER w AND k <> 'mid' THEN 1 ELSE 0 END AS s FROM c {W})
    SELECT id, k AS kind, sum(s) OVER (PARTITION BY src ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g""")
def brightness_stages(t: Tables) -> DataFrame:
    k = F.when(F.col("luma") < 60, "dark").when(F.col("luma") > 160, "bright").otherwise("mid")
    return windows.change_islands(t.frames.withColumn("kind", k), "src", ["t", "id"], "kind", ("mid",)).select("id", "kind", "island")


@query(f"WITH {FRAMES}, g AS (SELECT *, t - lag(t) OVER w AS gap FROM f {W}) SELECT src, median(gap) AS median_gap, round(avg(CASE WHEN gap BETWEEN 500 AND 5000 THEN 1 ELSE 0 END), 9) AS valid_ratio, max(gap) AS max_gap, count(*) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY src")
def interval_statistics(t: Tables) -> DataFrame:
    return windows.interval_stats(t.frames, "src", "t", "id", 500, 5000).withColumn("valid_ratio", F.round("valid_ratio", 9))


@query(f"WITH {FRAMES}, g AS (SELECT src, luma, lag(luma) OVER w AS b FROM f {W}) SELECT src, round(avg(CASE WHEN luma >= b THEN 1 ELSE 0 END), 9) AS monotonic_ratio FROM g WHERE b IS NOT NULL GROUP BY src")
def luma_monotonic(t: Tables) -> DataFrame:
    return windows.monotonic_ratio(t.frames, "src", ["t", "id"], "luma").withColumn("monotonic_ratio", F.round("monotonic_ratio", 9))


@query(f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM f) SELECT src, id FROM r WHERE r IN (0, round_even((n - 1) * 0.5, 0), n - 1)")
def first_middle_last(t: Tables) -> DataFrame:
    return windows.pick_positions(t.frames, "src", [F.col("t"), F.col("id")], [0.0, 0.5, 1.0]).select("src", "id")


@query(f"""WITH {FRAMES}, g AS (SELECT *, min(t) OVER p AS a, max(t) OVER p AS z FROM f WINDOW p AS (PARTITION BY src)), c AS (SELECT *, greatest(1, (z - a) // 18000) AS n FROM g)
    SELECT src, least(n - 1, (t - a) // 18000) AS win, count(*) AS frames FROM c GROUP BY ALL""")
def tumbling_windows(t: Tables) -> DataFrame:
    return windows.tumbling(t.frames, "src", "t", 18_000).groupBy("src", F.col("window").alias("win")).agg(F.count("*").alias("frames"))


@query(f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, id) AS r FROM f)
    SELECT a.id, round(min(abs(a.luma - b.luma)), 6) AS least_difference, round(avg(abs(a.luma - b.luma)), 6) AS mean_difference FROM r a LEFT JOIN r b ON a.src = b.src AND a.r <> b.r AND abs(a.r - b.r) <= 3 GROUP BY a.id""")
def luma_around(t: Tables) -> DataFrame:
    return windows.around(t.frames, "src", ["t", "id"], "luma").select("id", F.round("least_difference", 6).alias("least_difference"), F.round("mean_difference", 6).alias("mean_difference"))


@query(f"""WITH {FRAMES} SELECT src, id, std FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.src = f.src AND abs(g.t - f.t) <= 6000 AND (g.std > f.std OR (g.std = f.std AND (g.t < f.t OR (g.t = f.t AND g.id < f.id)))))""")
def local_best(t: Tables) -> DataFrame:
    return windows.local_argmax(t.frames, "src", "t", "id", "std", 6000)


@query(f"""WITH {FRAMES}, s AS (SELECT src, min(t) AS first, greatest(1, max(t) - min(t)) AS span FROM f GROUP BY src), b AS (SELECT src, band, first + span * band / 3.0::DOUBLE AS low, first + span * (band + 1) / 3.0::DOUBLE AS high FROM s, (VALUES (0), (1), (2)) v(band))
    SELECT b.src, low, max_by(id, (std, -t, id)) AS id FROM f JOIN b ON f.src = b.src AND t BETWEEN low AND high GROUP BY b.src, band, low""")
def best_in_bands(t: Tables) -> DataFrame:
    """The span of a source, from its first to its last frame, in BANDS equal bands. They share their ends, so a frame on one counts in both."""
    span = t.frames.groupBy("src").agg(F.min("t").alias("first"), F.greatest(F.lit(1), F.max("t") - F.min("t")).alias("span"))
    end = lambda k: F.col("first") + F.col("span") * k / F.lit(float(BANDS))
    bands = t.frames.join(span, "src").withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("low", end(F.col("band"))).where((F.col("t") >= F.col("low")) & (F.col("t") <= end(F.col("band") + 1)))
    return bands.groupBy("src", "band", "low").agg(F.max_by("id", F.struct(F.col("std"), -F.col("t"), F.col("id"))).alias("id")).select("src", "low", "id")

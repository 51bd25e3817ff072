"""Text, hash, time and JSON functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.functions import hashing, text, times, vectors
from framelode.operators import audit, evidence
from framelode.plans.base import FILES, HASHED, LABELS, LISTED, QUEUE, SQUEEZED, Tables, narrow, query

STRIP = r"regexp_replace({0}, '^[\s\x0b\x85\p{{Z}}]+|[\s\x0b\x85\p{{Z}}]+$', '', 'g')"
_LINES = "list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: " + STRIP.format("regexp_replace(x, '[ \\t]+', ' ', 'g')") + "), lambda x: x <> '')"


@query(f"SELECT doc_id, array_to_string({_LINES}, chr(10)) AS normal FROM documents WHERE text IS NOT NULL")
def normal_texts(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query("SELECT doc_id, trim(regexp_replace(replace(text, '\\n', chr(10)), '[\\s\\x0b\\x85\\p{Z}]+', ' ', 'g')) AS flat FROM documents WHERE text IS NOT NULL")
def flat_texts(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", text.norm_text(F.col("text")).alias("flat"))


@query()
def nfkc_texts(t: Tables) -> DataFrame:
    """The normal form in which queries are compared with texts, and its case folding. SQL has neither."""
    d = t.documents.where("text is not null").select("doc_id", text.normal_query_column(F.col("text")).alias("normal"))
    return d.withColumn("folded", text.casefold("normal"))


_FOLDED = f"lower({narrow('text')})"


@query(f"SELECT doc_id, contains({_FOLDED}, 'tent') AS has_word, list_contains(regexp_split_to_array({_FOLDED}, '[\\s\\x0b\\x85\\p{{Z}},，。:：;；/|()（）\\[\\]{{}}<>《》]+'), '人') AS has_sign FROM documents WHERE text IS NOT NULL")
def exact_queries(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null")
    return d.select("doc_id", text.has_exact_query(F.col("text"), " Ｔｅｎｔ ").alias("has_word"), text.has_exact_query(F.col("text"), "人").alias("has_sign"))


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS x FROM documents WHERE text IS NOT NULL), v AS (SELECT DISTINCT term FROM (SELECT {SQUEEZED.format("unnest(list_concat([label, label_zh], " + LISTED + "))")} AS term FROM visual_label_terms) WHERE term <> '')
    SELECT doc_id, term FROM d JOIN v ON regexp_matches(x, '(^|[^a-z0-9])' || regexp_escape(term) || '($|[^a-z0-9])') WHERE regexp_matches(term, '[a-z0-9]') UNION ALL SELECT doc_id, term FROM d JOIN v ON contains(x, term) WHERE NOT regexp_matches(term, '[a-z0-9]')""")
def mentioned_terms(t: Tables) -> DataFrame:
    """Terms of the registry (labels, translations, search terms) against every document."""
    listed = F.coalesce(F.from_json("search_terms_json", "array<string>"), F.array().cast("array<string>"))
    terms = t.visual_label_terms.select(F.explode(F.concat(F.array("label", "label_zh"), listed)).alias("term"))
    return evidence.mentions(t.documents, "doc_id", "text", terms.select(F.trim(F.regexp_replace(F.lower("term"), r"(?U)[\s\x1c-\x1f]+", " ")).alias("term")))


_CJK = "[\\x{3400}-\\x{9FFF}]"
_COUNT = lambda p: f"length(regexp_replace(text, '[^{p}]', '', 'g'))"  # noqa: E731
_METRICS = rf"""SELECT doc_id, text, source, length(text) AS text_len, {_COUNT(_CJK[1:-1])} AS cjk_count, {_COUNT('A-Za-z')} AS latin_count, {_COUNT('0-9')} AS digit_count,
    len(list_distinct(list_filter(regexp_split_to_array(text, ''), lambda x: x <> ''))) AS unique_char_count, list_filter(list_transform(regexp_split_to_array(text, '[\n;；|]'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS lines FROM documents WHERE text IS NOT NULL"""


@query(f"""SELECT doc_id, text_len, cjk_count, latin_count, digit_count, len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]+')) AS punct_count, CASE WHEN text_len > 0 THEN round(cjk_count / text_len, 4) ELSE 0 END AS cjk_ratio,
    len(lines) AS line_count, len(list_distinct(lines)) AS unique_line_count, CASE WHEN len(lines) > 0 THEN round(1 - len(list_distinct(lines)) / len(lines), 4) ELSE 0 END AS repeat_line_ratio FROM ({_METRICS})""")
def character_metrics(t: Tables) -> DataFrame:
    m = text.char_metrics(F.col("text"))
    keep = ("text_len", "cjk_count", "latin_count", "digit_count", "punct_count", "cjk_ratio", "line_count", "unique_line_count", "repeat_line_ratio")
    return t.documents.where("text is not null").select("doc_id", *[m[k].alias(k) for k in keep])


QUALITY = rf"""WITH c AS (SELECT *, list_filter(regexp_split_to_array(text, ''), lambda x: x <> '') AS chars, coalesce(lower(trim(source)) = 'ocr_text', false) AS ocr FROM ({_METRICS})),
    b AS (SELECT *, CASE WHEN len(chars) = 0 THEN 0 ELSE list_reduce(list_transform(chars, lambda x: {{{{'c': x, 'n': 1, 'm': 1}}}}), lambda a, x: CASE WHEN a.c = x.c THEN {{{{'c': x.c, 'n': a.n + 1, 'm': greatest(a.m, a.n + 1)}}}} ELSE {{{{'c': x.c, 'n': 1, 'm': a.m}}}} END).m END AS longest_run,
      regexp_split_to_array(regexp_replace(text, '[ 	

]+', '', 'g'), '') AS solid FROM c),
    s AS (SELECT *, CASE WHEN text_len > 0 THEN round(unique_char_count / text_len, 4) ELSE 0 END AS unique_share, CASE WHEN len(lines) > 0 THEN round(1 - len(list_distinct(lines)) / len(lines), 4) ELSE 0 END AS repeat_share, CASE WHEN text_len > 0 THEN round(digit_count / text_len, 4) ELSE 0 END AS digit_share FROM b),
    p AS (SELECT doc_id, longest_run, len(list_distinct(solid)) = 1 AND len(solid) >= 64 AS degenerate, [
      {{{{'w': text_len = 0, 'r': 'empty_text', 'p': 100}}}}, {{{{'w': text_len < CASE WHEN ocr THEN 8 ELSE 20 END, 'r': 'too_short', 'p': 25}}}}, {{{{'w': text_len > 3000, 'r': 'very_long_text', 'p': 10}}}}, {{{{'w': unique_share < 0.08 AND text_len >= 40, 'r': 'low_unique_char_ratio', 'p': 30}}}},
      {{{{'w': repeat_share > 0.5 AND len(lines) >= 4, 'r': 'repeated_lines', 'p': 30}}}}, {{{{'w': longest_run >= 8, 'r': 'long_repeated_char_run', 'p': 25}}}},
      {{{{'w': ocr AND (regexp_full_match(text, '[^\p{{L}}\p{{N}}]+') OR (text_len >= 9 AND longest_run = text_len) OR regexp_full_match(text, '[0-9 	

:：./\\-_,，。]+')), 'r': 'ocr_noise_pattern', 'p': 35}}}}, {{{{'w': ocr AND digit_share > 0.85 AND text_len >= 20, 'r': 'mostly_digits', 'p': 15}}}},
      {{{{'w': ocr AND cjk_count + latin_count = 0 AND text_len > 0, 'r': 'no_language_chars', 'p': 35}}}}, {{{{'w': NOT ocr AND text_len < 80 AND regexp_matches(text, '这是一张图片|这张图片|图中显示|画面中|可以看到|无法确定|无法判断|不清楚|看起来像'), 'r': 'generic_short_caption', 'p': 25}}}},
      {{{{'w': NOT ocr AND contains(text, '无法') AND regexp_matches(text, '识别|确定|判断'), 'r': 'uncertain_or_refusal_like', 'p': 25}}}}] AS rules FROM s),
    q AS (SELECT *, coalesce(list_sum(list_transform(list_filter(rules, lambda x: x.w), lambda x: x.p)), 0)::INT AS quality_score FROM p)
    SELECT doc_id, longest_run, degenerate, quality_score, CASE WHEN quality_score >= 60 THEN 'suspicious_high' WHEN quality_score >= 30 THEN 'suspicious_medium' WHEN quality_score > 0 THEN 'review_low' ELSE 'ok' END AS quality_status, array_to_string(list_transform(list_filter(rules, lambda x: x.w), lambda x: x.r), '|') AS quality_reasons FROM q""".replace("{{", "{").replace("}}", "}")


@query(QUALITY)
def text_quality(t: Tables) -> DataFrame:
    q = text.text_quality(F.col("text"), F.coalesce(F.lower(F.trim("source")) == "ocr_text", F.lit(False)))
    return t.documents.where("text is not null").select("doc_id", text.longest_run(F.col("text")).alias("longest_run"), text.is_degenerate(F.col("text")).alias("degenerate"), *[c.alias(k) for k, c in q.items()])


@query("SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？；;])', '\\1' || chr(10), 'g'), chr(10)), lambda x: " + STRIP.format('x') + "), lambda x: x <> ''), '¶') AS parts FROM documents WHERE text IS NOT NULL")
def zh_sentences(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.array_join(text.split_sentences_zh(F.col("text")), "¶").alias("parts"))


@query("SELECT doc_id, array_to_string(list_filter(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？；;])', '\\1' || chr(10), 'g'), chr(10)), lambda x: " + STRIP.format('x') + "), lambda x: x <> ''), lambda x: contains(lower(x), 'tent') OR contains(x, '帐篷')), ' ') AS kept FROM documents WHERE text IS NOT NULL")
def supported_sentences(t: Tables) -> DataFrame:
    kept = text.supported_text(F.col("text"), F.array(F.lit("tent"), F.lit("帐篷")), 10**6)
    return t.documents.where("text is not null").select("doc_id", kept.alias("kept"))


_COMPACT = "regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', '', 'g')"


@query(f"""SELECT doc_id, CASE WHEN length({_COMPACT}) < 40 THEN 'source_text_too_short' WHEN regexp_matches({_COMPACT}, '{"|".join(text.EMPTY_FRAME)}') THEN 'black_or_empty_frame_text' ELSE '' END AS bad,
    CASE WHEN {_COMPACT} = '' THEN 'failed' WHEN regexp_matches(text, '/Users/|Files:|Prompt:|Peak memory:') OR regexp_matches({_COMPACT}, '({"|".join(text.CUT_TAILS).replace("(", chr(92) + "(")})$') OR length({_COMPACT}) < 80 THEN 'review' ELSE 'ok' END AS status FROM documents WHERE text IS NOT NULL""")
def text_issues(t: Tables) -> DataFrame:
    status, _ = text.text_issues(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", text.bad_source_text(F.col("text"), 40).alias("bad"), status.alias("status"))


@query("""SELECT source_file_id, lower(regexp_replace(relative_path, '\\.[^./]*$', '')) AS stem, regexp_replace(relative_path, '/?[^/]*$', '') AS folder, lower(regexp_extract(relative_path, '\\.[^./]+$')) AS ext,
    TRY_CAST(list_extract(regexp_extract_all(regexp_replace(string_split(relative_path, '/')[-1], '\\.[^.]*$', ''), '(\\d+)', 1), -1) AS BIGINT) AS number,
    CASE WHEN len(string_split(relative_path, '/')) >= 4 THEN array_to_string(list_slice(string_split(relative_path, '/'), -4, -2), '/') ELSE regexp_replace(relative_path, '/?[^/]*$', '') END AS bucket FROM source_file_records WHERE relative_path IS NOT NULL""")
def path_parts(t: Tables) -> DataFrame:
    p = F.col("relative_path")
    rows = t.source_file_records.where(p.isNotNull())
    return rows.select("source_file_id", text.stem_key(p).alias("stem"), text.folder(p).alias("folder"), text.extension(p).alias("ext"), text.numeric_tail(p).alias("number"), text.source_bucket(p).alias("bucket"))


@query("SELECT source_file_id, tag FROM (SELECT source_file_id, unnest(TRY_CAST(finder_tags_json AS VARCHAR[])) AS tag FROM source_file_records WHERE finder_tags_json LIKE '[\"%') GROUP BY ALL")
def file_tags(t: Tables) -> DataFrame:
    """Tags of each file; text that isn't a JSON list has none."""
    tags = F.coalesce(F.from_json("finder_tags_json", "array<string>"), F.array().cast("array<string>"))
    return t.source_file_records.where("finder_tags_json like '[\"%'").select("source_file_id", F.explode(tags).alias("raw")).select("source_file_id", text.tag_color(F.col("raw"))[0].alias("tag")).distinct()


@query("""SELECT label, array_to_string(list_filter([CASE WHEN trim(coalesce(label_zh, '')) <> '' THEN 'Name' || chr(10) || trim(label_zh) END, CASE WHEN trim(coalesce(category_zh, '')) <> '' THEN 'Category' || chr(10) || trim(category_zh) END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS document FROM visual_label_terms""")
def term_documents(t: Tables) -> DataFrame:
    return t.visual_label_terms.select("label", text.compose_text([("Name", F.col("label_zh")), ("Category", F.col("category_zh"))]).alias("document"))


@query("""SELECT label, CASE WHEN coalesce(label_zh, '') = '' OR label_zh = label THEN label ELSE label || '|' || label_zh END AS terms FROM visual_label_terms WHERE label IS NOT NULL AND label <> ''""")
def search_terms(t: Tables) -> DataFrame:
    return t.visual_label_terms.where("label <> ''").select("label", text.ordered_unique(F.array("label", "label_zh")).alias("terms"))


@query(f"WITH {QUEUE} SELECT candidate_id, kind, 'c_' || substring(sha256(concat_ws('|', coalesce(candidate_id, ''), coalesce(kind, ''), coalesce(visual_unit_id, ''))), 1, 24) AS stable, sha256(concat_ws('|', coalesce(run_id, ''), coalesce(candidate_id, ''), coalesce(policy_version, ''))) AS key FROM q")
def candidate_keys(t: Tables) -> DataFrame:
    return t.queue.select("candidate_id", "kind", hashing.stable_id("c_", [F.col("candidate_id"), F.col("kind"), F.col("visual_unit_id")]).alias("stable"), hashing.execution_key([F.col("run_id"), F.col("candidate_id"), F.col("policy_version")]).alias("key"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def text_digests(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"""WITH {FILES}, {HASHED}, h AS (SELECT source_file_id, substring(d, 1, 16) AS a, substring(d, 17, 16) AS b FROM hashed WHERE d IS NOT NULL)
    SELECT source_file_id, bit_count(xor(('0x' || a)::UBIGINT, ('0x' || b)::UBIGINT))::INT AS distance FROM h""")
def hash_distances(t: Tables) -> DataFrame:
    h = t.files.withColumn("d", hashing.valid_hash(F.col("content_sha256"))).where("d is not null")
    return h.select("source_file_id", hashing.hamming_hex(F.substring("d", 1, 16), F.substring("d", 17, 16)).alias("distance"))


@query(f"""WITH {QUEUE} SELECT candidate_id, CASE WHEN time_position_ms >= 3600000 THEN printf('%02d:%02d:%02d', time_position_ms // 3600000, time_position_ms // 60000 % 60, time_position_ms // 1000 % 60) WHEN time_position_ms >= 0 THEN printf('%02d:%02d', time_position_ms // 60000, time_position_ms // 1000 % 60) ELSE '--:--' END AS code,
    greatest(0, time_position_ms - 2000) AS preview_start, greatest(0, time_position_ms - 2000) + 5000 AS preview_end,
    greatest(time_position_ms - 10000, group_start_ms, 0) AS search_start, least(time_position_ms + 10000, coalesce(group_end_ms, time_position_ms + 10000)) AS search_end FROM q WHERE time_position_ms IS NOT NULL""")
def candidate_times(t: Tables) -> DataFrame:
    x = F.col("time_position_ms")
    a, b = times.preview_segment(x)
    c, d = times.search_segment(x, F.col("group_start_ms"), F.col("group_end_ms"))
    return t.queue.where(x.isNotNull()).select("candidate_id", times.timecode(x).alias("code"), a.alias("preview_start"), b.alias("preview_end"), c.alias("search_start"), d.alias("search_end"))


@query(f"WITH {QUEUE} SELECT candidate_id, epoch(TRY_CAST(created_at AS TIMESTAMPTZ))::BIGINT AS seconds, strftime(TRY_CAST(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso FROM q")
def created_times(t: Tables) -> DataFrame:
    at = F.col("created_at").try_cast("timestamp")
    return t.queue.select("candidate_id", F.unix_seconds(at).alias("seconds"), times.iso(at).alias("iso"))


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_properties(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT source_file_id, '{\"ext\":' || coalesce(to_json(extension)::VARCHAR, 'null') || ',\"size\":' || coalesce(size_bytes::VARCHAR, 'null') || '}' AS json FROM source_file_records")
def canonical_rows(t: Tables) -> DataFrame:
    return t.source_file_records.select("source_file_id", hashing.canonical_json({"size": F.col("size_bytes"), "ext": F.col("extension")}).alias("json"))


_FAMILIES = {"human": ["person", "face", "body"], "vehicle": ["car", "truck", "bus", "train"], "animal": ["dog", "cow", "sheep", "cat"]}


@query(f"WITH {LABELS} SELECT DISTINCT label, CASE WHEN label IN ('sky', 'wall') THEN 'weak' " + " ".join(f"WHEN {' OR '.join(f'contains(label, {x!r})' for x in xs)} THEN '{k}'" for k, xs in _FAMILIES.items()) + " ELSE 'other' END AS category FROM l")
def label_categories(t: Tables) -> DataFrame:
    """Substrings count, so a label that holds a family's term belongs to it."""
    return t.labels.select("label", vectors.category_for(F.col("label"), _FAMILIES, ("sky", "wall")).alias("category")).distinct()


@query("""SELECT doc_id, CASE WHEN text IS NULL OR text = '' OR n_chars <> length(text) THEN 'FAIL' WHEN length(text) < 80 OR length(text) > 2000 OR regexp_matches(text, '[,，、:：(（-]\\s*$') THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM documents""")
def caption_audit(t: Tables) -> DataFrame:
    verdict, _ = audit.caption_verdict(F.col("text"), F.coalesce(F.col("n_chars") == F.length("text"), F.lit(False)), F.lit(True))
    return t.documents.select("doc_id", verdict.alias("verdict"))

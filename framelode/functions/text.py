"""Text functions on columns. Everything runs in the JVM but Unicode normal forms, which Spark lacks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding, which ``lower`` isn't."""
    return s.map(lambda x: None if x is None else x.casefold())


def normalize_query(text: str) -> str:
    """A query as it is compared: NFKC, white space runs as one blank, trimmed. Runs on the driver."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()


@F.pandas_udf(T.StringType())
def folded_query(s: pd.Series) -> pd.Series:
    """The normal form of a query without regard to case, in one pass."""
    return s.map(lambda x: None if x is None else normalize_query(x).casefold())


def normal_query_column(c: Column) -> Column:
    return F.trim(F.regexp_replace(nfkc(c), r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Line ends as ``\\n``; per line, tabs and blanks collapsed and trimmed; empty lines dropped."""
    lines = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), "\n")


def norm_text(c: Column) -> Column:
    """A written-out ``\\n`` counts as a line end; white space runs become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\\n", "\n"), r"(?U)\s+", " "))


CJK = r"[\x{3400}-\x{9FFF}]"
# What parts the words of a text, for queries of a single sign.
_PARTS = r"[\s,，。:：;；/|()（）\[\]{}<>《》]+"


def has_exact_query(text: Column, query: str) -> Column:
    """Substring match of normal forms without regard to case; a single CJK sign must stand alone between white space and marks."""
    q = normalize_query(query).casefold()
    if not q:
        return F.lit(False)
    folded = folded_query(text)
    return F.array_contains(F.split(folded, _PARTS), q) if len(q) == 1 and "\u3400" <= q <= "\u9fff" else F.contains(folded, F.lit(q))


def term_matches(text: Column, term: Column, ambiguous: tuple[str, ...] = ()) -> Column:
    """Whether ``term`` occurs: terms with a-z or 0-9 need boundaries, others are substrings; empty and ambiguous ones never match."""
    t, x = F.lower(F.trim(term)), F.lower(text)
    quoted = F.concat(F.lit("(?<![a-z0-9])"), F.lit("\\Q"), t, F.lit("\\E"), F.lit("(?![a-z0-9])"))
    found = F.when(t.rlike("[a-z0-9]"), F.regexp_like(x, quoted)).otherwise(F.contains(x, t))
    return F.when((t == "") | t.isin(*ambiguous, "\0"), F.lit(False)).otherwise(F.coalesce(found, F.lit(False)))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def char_metrics(text: Column) -> dict[str, Column]:
    """Counts and shares of kinds of signs, and how much lines repeat."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    n = F.length(text)
    lines = F.filter(F.transform(F.split(text, r"[\n;；|]"), lambda x: strip(x)), lambda x: x != "")
    distinct = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda x: x != "")))
    total, unique = F.size(lines), F.size(F.array_distinct(lines))
    return {
        "text_len": n, "cjk_count": count(CJK), "latin_count": count("[A-Za-z]"), "digit_count": count("[0-9]"), "punct_count": count(r"[^\p{L}\p{N}]+"), "space_count": count(r"\s"),
        "unique_char_count": distinct, "unique_char_ratio": ratio(distinct, n), "line_count": total, "unique_line_count": unique,
        "repeat_line_ratio": F.when(total > 0, F.round(1 - unique / total, 4)).otherwise(0.0),
        "cjk_ratio": ratio(count(CJK), n), "latin_ratio": ratio(count("[A-Za-z]"), n), "digit_ratio": ratio(count("[0-9]"), n),
    }


def longest_run(text: Column) -> Column:
    """The length of the longest run of one repeated sign."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda x: F.length(x))), F.lit(0))


def is_degenerate(text: Column, least: int = 64) -> Column:
    """At least ``least`` signs that aren't white space, all equal."""
    return F.regexp_replace(text, r"\s+", "").rlike(rf"^(?s)(.)\1{{{least - 1},}}$")


# Recognised text that is noise, and phrases of captions that say little.
NOISE = (r"^[^\p{L}\p{N}]+$", r"^(.)\1{8,}$", r"^[0-9\s:：./\\\-_,，。]+$")
GENERIC = ("这是一张图片", "这张图片", "图中显示", "画面中", "可以看到", "无法确定", "无法判断", "不清楚", "看起来像")


def text_quality(text: Column, ocr: Column) -> dict[str, Column]:
    """Additive penalties with their reasons and a status."""
    m = char_metrics(text)
    run = longest_run(text)
    rules = [
        (m["text_len"] == 0, "empty_text", 100),
        (m["text_len"] < F.when(ocr, 8).otherwise(20), "too_short", 25),
        (m["text_len"] > 3000, "very_long_text", 10),
        ((m["unique_char_ratio"] < 0.08) & (m["text_len"] >= 40), "low_unique_char_ratio", 30),
        ((m["repeat_line_ratio"] > 0.5) & (m["line_count"] >= 4), "repeated_lines", 30),
        (run >= 8, "long_repeated_char_run", 25),
        (ocr & text.rlike("|".join(f"(?:{p})" for p in NOISE[:1] + NOISE[2:]) + "|" + NOISE[1]), "ocr_noise_pattern", 35),
        (ocr & (m["digit_ratio"] > 0.85) & (m["text_len"] >= 20), "mostly_digits", 15),
        (ocr & (m["cjk_count"] + m["latin_count"] == 0) & (m["text_len"] > 0), "no_language_chars", 35),
        (~ocr & text.rlike("|".join(GENERIC)) & (m["text_len"] < 80), "generic_short_caption", 25),
        (~ocr & F.contains(text, F.lit("无法")) & text.rlike("识别|确定|判断"), "uncertain_or_refusal_like", 25),
    ]
    score = sum((F.when(when, points).otherwise(0) for when, _, points in rules), F.lit(0))
    status = F.when(score >= 60, "suspicious_high").when(score >= 30, "suspicious_medium").when(score > 0, "review_low").otherwise("ok")
    return {"quality_score": score, "quality_status": status, "quality_reasons": reasons([(when, name) for when, name, _ in rules])}


def reasons(rules: list[tuple[Column, str]], sep: str = "|") -> Column:
    """The names of the rules that hold, joined in order."""
    return F.array_join(F.filter(F.array(*[F.when(when, F.lit(name)) for when, name in rules]), lambda x: x.isNotNull()), sep)


def ordered_unique(parts: Column, sep: str = "|") -> Column:
    """Distinct non-empty parts in first-seen order, joined."""
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), sep)


def split_sentences_zh(text: Column) -> Column:
    """Cut after ``。！？；;`` or at line ends; parts trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？；;])|\n"), lambda x: strip(x)), lambda x: x != "")


def supported_text(text: Column, terms: Column, cap: int = 600) -> Column:
    """The sentences that hold any of ``terms``, joined, cut at ``cap`` signs with an ellipsis."""
    kept = F.array_join(F.filter(split_sentences_zh(text), lambda s: F.exists(terms, lambda t: F.contains(F.lower(s), F.lower(t)))), " ")
    return F.when(F.length(kept) > cap, F.concat(F.substring(kept, 1, cap), F.lit("…"))).otherwise(kept)


# Phrases that describe an empty frame, and tails of texts that were cut off.
EMPTY_FRAME = ("纯黑", "一片黑", "无任何可见内容", "检索价值：无", "画面为黑")
CUT_TAILS = ("应为", "因为", "包括", "例如", "主要为", "可见", "背景为", "前景为", "疑似", "可能", "有", "和", "与", "及", "为", "：", "，", "、", "-", "（", "(", ";", "；")


def bad_source_text(text: Column, least: int) -> Column:
    """Why a text can't be a source: too short without white space, or that of a black frame; '' if it can."""
    t = F.regexp_replace(text, r"\s+", "")
    return F.when(F.length(t) < least, "source_text_too_short").when(t.rlike("|".join(EMPTY_FRAME)), "black_or_empty_frame_text").otherwise("")


def text_issues(text: Column, tokens: Column | None = None, most: int | None = None) -> tuple[Column, Column]:
    """Status (ok, review, failed) and warnings of a cleaned answer."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    rules = [
        (t == "", "empty_clean_text"),
        (text.rlike("/Users/|Files:|Prompt:|Peak memory:"), "wrapper_or_internal_text_remains"),
        (t.rlike("(" + "|".join(re.escape(x) for x in CUT_TAILS) + ")$"), "likely_truncated_by_sentence_tail"),
        (F.length(t) < 80, "too_short"),
    ]
    if tokens is not None and most is not None:
        rules.append((tokens >= most, "generation_reached_max_tokens"))
    found = reasons(rules)
    return F.when(F.startswith(found, F.lit("empty_clean_text")), "failed").when(found != "", "review").otherwise("ok"), found


# What an answer follows.
ANSWER = ("<|im_start|>assistant", "assistant\n", "Assistant:\n", "ASSISTANT:\n")


def clean_answer(raw: Column) -> Column:
    """The answer in the output of a captioning run: without wrapper, end marks, run metrics and local paths."""
    t = F.regexp_replace(raw, "\r\n?", "\n")
    plain = F.regexp_replace(F.regexp_replace(t, r"(?s)^=+\s*\nFiles:\s*\[.*?\]\s*\n+", ""), r"(?s)^Files:\s*\[.*?\]\s*\n+", "")
    # The first of the markers that occurs at all, at its first place.
    for marker in reversed(ANSWER):
        at = F.locate(marker, t)
        plain = F.when(at > 0, F.substring(t, at + len(marker), F.length(t))).otherwise(plain)
    t = F.regexp_replace(plain, r"(?s)(<\|im_end\|>|<\|endoftext\|>|\n==========|==========\n).*$", "")
    t = F.regexp_replace(t, r"(?is)\n(Prompt|Generation|Peak memory):\s.*$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"<\|[^>]+\|>", ""), r"/Users/[^\s\])}。，,;；]+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?im)^\s*(Prompt|Files):.*$", ""), r"(?m)[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), "\n{3,}", "\n\n")


def run_metrics(raw: Column) -> dict[str, Column]:
    """Numbers that a captioning run prints; null where absent."""
    number = lambda p, kind: F.nullif(F.regexp_extract(raw, p, 1), F.lit("")).try_cast(kind)
    return {
        "prompt_tokens": number(r"(?i)Prompt:\s*(\d+)\s*tokens", "int"), "prompt_tps": number(r"(?i)Prompt:.*?([\d.]+)\s*tokens-per-sec", "double"),
        "generation_tokens": number(r"(?i)Generation:\s*(\d+)\s*tokens", "int"), "generation_tps": number(r"(?i)Generation:.*?([\d.]+)\s*tokens-per-sec", "double"),
        "peak_memory_gb": number(r"(?i)Peak memory:\s*([\d.]+)\s*GB", "double"),
    }


def stem_key(path: Column) -> Column:
    """The path without its suffix, in lower case."""
    return F.lower(F.regexp_replace(path, r"\.[^./]*$", ""))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def numeric_tail(path: Column) -> Column:
    """The last group of digits in the stem, as a number; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(F.regexp_replace(file_name(path), r"\.[^.]*$", ""), F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("bigint")


def source_bucket(path: Column) -> Column:
    """The last three folders of a path that has at least four parts; else its folder."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, F.size(parts) - 3, F.lit(3)), "/")).otherwise(folder(path))


def tag_color(tag: Column) -> tuple[Column, Column]:
    """A file tag's name and the colour number behind it (null if none)."""
    return F.regexp_replace(tag, r"\n\d+$", ""), F.nullif(F.regexp_extract(tag, r"\n(\d+)$", 1), F.lit("")).try_cast("int")


def compose_text(parts: list[tuple[str, Column]]) -> Column:
    """Titled sections joined by a blank line; empty ones are left out."""
    made = F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(title + "\n"), F.trim(c))) for title, c in parts])
    return F.array_join(F.filter(made, lambda x: x.isNotNull()), "\n\n")


def labels_in_blob(blob: Column) -> Column:
    """Label names in a JSON text of any shape: the strings of its ``label`` keys, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(blob, F.lit(r'"label"\s*:\s*"([^"]+)"'), F.lit(1)), lambda x: F.lower(F.trim(x)))))

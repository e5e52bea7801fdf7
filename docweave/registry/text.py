"""Registered queries: scalar text cleaning over ``documents.text``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.registry.sqlfrag import WORD, WS, normalize_ws, sql_list, ustrip
from docweave.plans.parallel import spread
from docweave.session import table

LINE_BREAK = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _docs(spark, sf):
    # regex chains are CPU-bound per row: use every core on small inputs
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _col_query(fn, name="out"):
    def q(spark, sf):
        return _docs(spark, sf).select("doc_id", fn(F.col("text")).alias(name))
    return q


def drop_boilerplate_lines(c):
    """Split into lines (Python ``splitlines`` breaks), strip, drop blanks and
    exact boilerplate lines, re-join in order. Inside the row: no shuffle."""
    phrases = F.array(*[F.lit(p) for p in tx.BOILERPLATE_LINES])
    lines = F.transform(F.split(c, LINE_BREAK), tx.ustrip)
    return F.array_join(F.filter(lines, lambda l: (l != "") & ~F.array_contains(phrases, l)), "\n")


def q_split_sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(tx.split_sentences(F.col("text")))
                                   .alias("sent_no", "sentence"))


def q_null_to_empty(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    score = F.when(F.col("toxic") == 1, F.lit(float("nan"))).otherwise(F.col("quality").cast("double"))
    return j.select("doc_id", tx.null_to_empty(F.col("quality")).alias("quality"),
                    tx.null_to_empty(F.col("toxic")).alias("toxic"), tx.null_to_empty(score).alias("score"))


def q_tokenize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


QUERIES = {
    "normalize_whitespace": _col_query(tx.normalize_whitespace),
    "squeeze_blank_lines": _col_query(tx.squeeze_blank_lines),
    "collapse_repeated_phrases": _col_query(tx.collapse_repeated_phrases),
    "strip_fillers": _col_query(tx.strip_fillers),
    "collapse_ellipsis": _col_query(tx.collapse_ellipsis),
    "split_sentences": q_split_sentences,
    "regroup_paragraphs": _col_query(tx.regroup_paragraphs),
    "space_before_url": _col_query(tx.space_before_url),
    "fix_punctuation_spacing": _col_query(tx.fix_punctuation_spacing),
    "drop_filler_sentences": _col_query(tx.drop_filler_sentences),
    "space_entities": _col_query(tx.space_entities),
    "clean_bullets": _col_query(tx.clean_bullets),
    "drop_boilerplate_lines": _col_query(drop_boilerplate_lines),
    "render_answer": _col_query(tx.render_answer),
    "truncate_title": _col_query(tx.truncate_title),
    "null_to_empty": q_null_to_empty,
    "tokenize": q_tokenize,
    "keyword_head": _col_query(tx.keyword_head),
}

_MARK = "\u0001"


def _sentences_sql(x: str) -> str:
    return (f"string_split(regexp_replace({x}, '([.?!]){WS}+', '\\1{_MARK}', 'g'), '{_MARK}')")


def _word_count_sql(s: str) -> str:
    return (f"(CASE WHEN {ustrip(s)} = '' THEN 0 ELSE "
            f"len(regexp_split_to_array({ustrip(s)}, '{WS}+')) END)")


def _content_tokens_sql(x: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), "
            f"lambda t: NOT list_contains({sql_list(tx.STOP_WORDS)}, t))")


def keywords_sql(x: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({x}), '{tx.WRITTEN_TOKEN}'), lambda t: regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+') "
            f"AND NOT list_contains({sql_list(tx.STOP_WORDS)}, t))")


def _sel(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS out FROM documents"


_FILLERS = "|".join(tx.FILLER_PATTERNS).replace("'", "''")
_NAVL = "|".join(tx.NAV_LABELS).replace("'", "''")

ORACLE = {
    "normalize_whitespace": _sel(normalize_ws("text")),
    "squeeze_blank_lines": _sel(f"regexp_replace(text, '\\n{WS}*\\n+', chr(10) || chr(10), 'g')"),
    "strip_fillers": _sel(f"regexp_replace(regexp_replace(text, '{_FILLERS}', '', 'gi'), '{_NAVL}', '', 'gi')"),
    "collapse_ellipsis": _sel(
        "regexp_replace(regexp_replace(text, '\\.{2,}', '.', 'g'), "
        f"'{tx.APOLOGY_PATTERN}', '', 'gi')"),
    "split_sentences": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_no, s[i] AS sentence
FROM (SELECT doc_id, {_sentences_sql('text')} AS s FROM documents), range(1, len(s) + 1) t(i)""",
    "regroup_paragraphs": _sel(
        f"array_to_string(list_filter(list_transform({_sentences_sql('text')}, lambda s: {ustrip('s')}), "
        "lambda s: s <> ''), chr(10) || chr(10))"),
    "space_before_url": _sel("regexp_replace(text, '([a-z])(https?://|www\\.)', '\\1 \\2', 'g')"),
    "fix_punctuation_spacing": _sel(
        f"regexp_replace(regexp_replace(text, '{WS}+([.,!?])', '\\1', 'g'), '([.,!?])({WORD})', '\\1 \\2', 'g')"),
    "drop_filler_sentences": _sel(
        f"array_to_string(list_filter(list_transform({_sentences_sql('text')}, lambda s: {ustrip('s')}), "
        f"lambda s: {_word_count_sql('s')} >= 5 AND NOT starts_with(lower(s), 'did you know')), chr(10))"),
    "space_entities": _sel(
        f"regexp_replace(regexp_replace(text, '(https?://[^\\s]+|www\\.[^\\s]+)', ' \\1 ', 'g'), '{WS}+', ' ', 'g')"),
    "clean_bullets": _sel(
        "array_to_string(list_transform(list_filter(string_split(replace(text, '•', '" + _MARK + "•'), '"
        + _MARK + "'), lambda s: starts_with(s, '•')), lambda s: '• ' || "
        + normalize_ws(f"regexp_replace(regexp_replace(s, '(https?://[^\\s]+|www\\.[^\\s]+)', ' \\1 ', 'g'), '{WS}+', ' ', 'g')")
        + "), chr(10))"),
    "drop_boilerplate_lines": _sel(
        f"array_to_string(list_filter(list_transform(regexp_split_to_array(text, '{LINE_BREAK}'), "
        f"lambda l: {ustrip('l')}), lambda l: l <> '' AND NOT list_contains({sql_list(tx.BOILERPLATE_LINES)}, l)), chr(10))"),
    "render_answer": _sel("replace(regexp_replace(text, '\\*\\*([^\n]*?)\\*\\*', '<b>\\1</b>', 'g'), chr(10), '<br>')"),
    "truncate_title": None,  # filled below
    "null_to_empty": """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality,
       coalesce(CAST(l.toxic AS VARCHAR), '') AS toxic,
       CASE WHEN l.toxic = 1 OR l.quality IS NULL THEN '' ELSE CAST(CAST(l.quality AS DOUBLE) AS VARCHAR) END AS score
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "tokenize": "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') AS tokens FROM documents",
    "keyword_head": _sel(f"array_to_string({keywords_sql('text')}[1:3], ' ')"),
}

from docweave.registry.chat import _truncate_sql  # noqa: E402

ORACLE["truncate_title"] = _sel(_truncate_sql("text"))

"""Registered queries: lexical operators (§2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import lexical as LX
from docweave.registry.chat import messages
from docweave.registry.sqlfrag import WS, sql_list
from docweave.plans.parallel import spread
from docweave.session import reliable_checkpoint, table


def qa_pairs(spark, sf):
    """Each user message with the assistant message right after it."""
    m = messages(spark, sf)
    u = m.filter(F.col("role") == "user").select("session_id", "turn", F.col("content").alias("question"))
    a = m.filter(F.col("role") == "assistant").select(
        "session_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answer"))
    return u.join(a, ["session_id", "turn"])


def q_sentence_overlap_topk(spark, sf):
    p = qa_pairs(spark, sf)
    return p.select("session_id", "turn",
                    LX.sentence_overlap_topk(F.col("answer"), F.col("question")).alias("top_sentences"))


def _questions(spark, sf):
    return messages(spark, sf).filter(F.col("role") == "user")


def q_top_terms(spark, sf):
    return LX.top_terms(_questions(spark, sf), "content", 50)


def q_tfidf_weights(spark, sf):
    qs = _questions(spark, sf).withColumn("q_id", F.concat_ws(":", "session_id", F.col("turn").cast("string")))
    vocab = LX.top_terms(qs, "content", 50)
    return LX.tfidf_weights(qs, "q_id", "content", vocab).withColumn("weight", F.round("weight", 6))


def q_term_dictionary(spark, sf):
    return LX.term_dictionary(spread(table(spark, sf, "documents")), "text")


def q_bag_of_words(spark, sf):
    """Token counts are computed once (written to the shared checkpoint
    folder, since the dictionary and the result both read them)."""
    counts = reliable_checkpoint(LX.term_counts(spread(table(spark, sf, "documents")), "doc_id", "text"))
    return LX.bag_of_words(counts, "doc_id", LX.dictionary_of(counts))


def q_fuzzy_best_match(spark, sf):
    p = table(spark, sf, "part")
    return LX.fuzzy_best_match(p, p, l_id="p_partkey", l_text="p_name", r_id="p_partkey",
                               r_text="p_name", threshold=0.8, exclude_self=True).withColumn(
        "ratio", F.round("ratio", 6))


def eval_pairs(spark, sf):
    """(reference, candidate) pairs: each document against its cleaned form
    (filler sentences dropped)."""
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", F.col("text").alias("reference"),
                    tx.drop_filler_sentences(F.col("text")).alias("candidate"))


def q_bleu(spark, sf):
    return LX.bleu(eval_pairs(spark, sf), "doc_id", "reference", "candidate").withColumn(
        "bleu", F.round("bleu", 6))


def q_rouge_l(spark, sf):
    p = qa_pairs(spark, sf)
    return p.select("session_id", "turn",
                    F.round(LX.rouge_l(F.col("question"), F.col("answer"), stem=True), 6).alias("rouge_l"))


QUERIES = {
    "sentence_overlap_topk": q_sentence_overlap_topk,
    "top_terms": q_top_terms,
    "tfidf_weights": q_tfidf_weights,
    "term_dictionary": q_term_dictionary,
    "bag_of_words": q_bag_of_words,
    "fuzzy_best_match": q_fuzzy_best_match,
    "bleu": q_bleu,
    "rouge_l": q_rouge_l,
}

_MSG = """messages AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text AS content
                      FROM conversations)"""
_QA = f"""{_MSG},
  qa AS (SELECT u.session_id, u.turn, u.content AS question, a.content AS answer
         FROM messages u JOIN messages a ON a.session_id = u.session_id AND a.turn = u.turn + 1
         WHERE u.role = 'user' AND a.role = 'assistant')"""
_MARK = "\u0001"


def _tokens(x):
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def _vocab_tokens(x):
    return f"list_filter({_tokens(x)}, lambda t: length(t) >= 2 AND NOT list_contains({sql_list(tx.STOP_WORDS)}, t))"


def _topic_tokens(x):
    return (f"list_filter(regexp_extract_all(strip_accents(lower({x})), '\\p{{L}}+'), "
            f"lambda t: length(t) BETWEEN 2 AND 15 AND NOT list_contains({sql_list(tx.STOP_WORDS)}, t))")


def _content_tokens(x):
    return (f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), "
            f"lambda t: NOT list_contains({sql_list(tx.STOP_WORDS)}, t))")


_TOP = f"""{_MSG},
  toks AS (SELECT unnest({_vocab_tokens('content')}) AS term FROM messages WHERE role = 'user'),
  top AS (SELECT term, count(*) AS tf FROM toks GROUP BY term ORDER BY tf DESC, term LIMIT 50)"""

_DICT = f"""terms AS (SELECT DISTINCT unnest({_topic_tokens('text')}) AS term FROM documents),
  dict AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM terms)"""

_WSPLIT = f"list_filter(regexp_split_to_array(X, '{WS}+'), lambda w: w <> '')"


def _ngrams_sql(col, side):
    toks = _WSPLIT.replace("X", col)
    parts = []
    for n in range(1, 5):
        parts.append(f"""SELECT doc_id, {n} AS n, array_to_string(t[i:i + {n - 1}], '{_MARK}') AS g
  FROM (SELECT doc_id, {toks} AS t FROM p), range(1, greatest(len(t) - {n} + 2, 1)) r(i)""")
    return f"{side} AS (SELECT doc_id, n, g, count(*) AS c FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"


def _sentences_sql(x):
    return f"string_split(regexp_replace({x}, '([.?!]){WS}+', '\\1{_MARK}', 'g'), '{_MARK}')"


_CLEANED = (f"array_to_string(list_filter(list_transform({_sentences_sql('text')}, "
            f"lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: "
            f"(CASE WHEN regexp_replace(s, '^{WS}+|{WS}+$', '', 'g') = '' THEN 0 ELSE "
            f"len(regexp_split_to_array(regexp_replace(s, '^{WS}+|{WS}+$', '', 'g'), '{WS}+')) END) >= 5 "
            f"AND NOT starts_with(lower(s), 'did you know')), chr(10))")

ORACLE = {
    "sentence_overlap_topk": f"""WITH {_QA},
  s AS (SELECT session_id, turn, question, unnest({_sentences_sql('answer')}) AS s FROM qa),
  sc AS (SELECT session_id, turn, s,
                len(list_intersect(list_distinct({_tokens('question')}), list_distinct({_tokens('s')}))) AS o FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY o DESC, s DESC) AS rn FROM sc)
SELECT session_id, turn, string_agg(s, chr(10) ORDER BY rn) AS top_sentences FROM r WHERE rn <= 5
GROUP BY session_id, turn""",
    "top_terms": f"""WITH {_TOP}
SELECT term, tf, CAST(row_number() OVER (ORDER BY tf DESC, term) AS INTEGER) AS rank FROM top""",
    "tfidf_weights": f"""WITH {_TOP},
  qs AS (SELECT session_id || ':' || CAST(turn AS VARCHAR) AS q_id, content FROM messages WHERE role = 'user'),
  n AS (SELECT count(*) AS n FROM qs),
  tf AS (SELECT q_id, term, count(*) AS tf FROM (SELECT q_id, unnest({_vocab_tokens('content')}) AS term FROM qs)
         WHERE term IN (SELECT term FROM top) GROUP BY q_id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  w AS (SELECT tf.q_id, tf.term, tf.tf * (ln((1 + n.n) / (1 + df.df)) + 1) AS w FROM tf JOIN df USING (term), n),
  nr AS (SELECT q_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY q_id)
SELECT q_id, term, round(w / nrm, 6) AS weight FROM w JOIN nr USING (q_id)""",
    "term_dictionary": f"WITH {_DICT} SELECT term, term_id FROM dict",
    "bag_of_words": f"""WITH {_DICT},
  t AS (SELECT doc_id, unnest({_topic_tokens('text')}) AS term FROM documents)
SELECT doc_id, term_id, count(*) AS count FROM t JOIN dict USING (term) GROUP BY doc_id, term_id""",
    "fuzzy_best_match": """WITH s AS (
  SELECT a.p_partkey, b.p_partkey AS match_id,
         CASE WHEN greatest(length(a.p_name), length(b.p_name)) = 0 THEN 1.0
              ELSE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) END AS ratio
  FROM part a JOIN part b ON a.p_partkey <> b.p_partkey),
  k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY ratio DESC, match_id) AS rn
        FROM s WHERE ratio >= 0.8)
SELECT p.p_partkey, k.match_id, round(k.ratio, 6) AS ratio, k.match_id IS NOT NULL AS matched
FROM part p LEFT JOIN (SELECT * FROM k WHERE rn = 1) k USING (p_partkey)""",
    "bleu": f"""WITH p AS (SELECT doc_id, text AS reference, {_CLEANED} AS candidate FROM documents),
  {_ngrams_sql('candidate', 'c')},
  {_ngrams_sql('reference', 'r')},
  cl AS (SELECT c.doc_id, c.n, sum(least(c.c, coalesce(r.c, 0))) AS m, sum(c.c) AS tot
         FROM c LEFT JOIN r USING (doc_id, n, g) GROUP BY c.doc_id, c.n),
  lg AS (SELECT doc_id, sum(CASE WHEN m > 0 THEN ln(m / tot) END) AS slog,
                count(CASE WHEN m > 0 THEN 1 END) AS n_pos FROM cl GROUP BY doc_id),
  lens AS (SELECT doc_id, len({_WSPLIT.replace('X', 'reference')}) AS r_len,
                  len({_WSPLIT.replace('X', 'candidate')}) AS c_len FROM p)
SELECT lens.doc_id, round(CASE WHEN r_len = 0 OR c_len = 0 OR coalesce(n_pos, 0) < 4 THEN 0.0
  ELSE (CASE WHEN c_len > r_len THEN 1.0 ELSE exp(1 - r_len / c_len) END) * exp(slog / 4) END, 6) AS bleu
FROM lens LEFT JOIN lg USING (doc_id)""",
}


def _rouge_tokens_sql(x: str) -> str:
    """ROUGE tokens in SQL: lower-case ASCII alphanumeric runs, light suffix
    stemmer on tokens longer than 3 chars (same order as ``_light_stem``)."""
    toks = f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
    cases = " ".join(
        f"WHEN length(t) > 3 AND ends_with(t, '{suf}') AND length(t) - {len(suf)} >= 3 "
        f"THEN left(t, length(t) - {len(suf)})"
        for suf in LX.STEM_SUFFIXES)
    return f"list_transform({toks}, lambda t: CASE {cases} ELSE t END)"


ORACLE["rouge_l"] = f"""WITH RECURSIVE {_QA},
  tk AS (SELECT session_id, turn, {_rouge_tokens_sql('question')} AS r, {_rouge_tokens_sql('answer')} AS c FROM qa),
  -- iterate over the longer list, keep DP rows over the shorter one
  p AS (SELECT session_id, turn, len(r) AS nr, len(c) AS nc,
               CASE WHEN len(r) >= len(c) THEN r ELSE c END AS a,
               CASE WHEN len(r) >= len(c) THEN c ELSE r END AS b FROM tk),
  dp(session_id, turn, i, row) AS (
    SELECT session_id, turn, 0, list_transform(range(0, len(b) + 1), lambda x: 0) FROM p
    UNION ALL
    SELECT dp.session_id, dp.turn, dp.i + 1,
           list_concat([0], list_transform(range(1, len(p.b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
             lambda jj: CASE WHEN p.a[dp.i + 1] = p.b[jj] THEN dp.row[jj] + 1 ELSE dp.row[jj + 1] END))))
    FROM dp JOIN p USING (session_id, turn) WHERE dp.i < len(p.a)),
  lcs AS (SELECT dp.session_id, dp.turn, dp.row[len(dp.row)] AS l, p.nr, p.nc
          FROM dp JOIN p USING (session_id, turn) WHERE dp.i = len(p.a))
SELECT session_id, turn,
       round(CASE WHEN l = 0 THEN 0.0 ELSE 2 * (l / nc) * (l / nr) / ((l / nc) + (l / nr)) END, 6) AS rouge_l
FROM lcs"""


"""Registered queries: evaluation pipeline (§2.11) and table utilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import evaluate as EV
from docweave.operators import retrieve as R
from docweave.registry.lexical import qa_pairs
from docweave.session import table


def answer_log(spark, sf):
    """Logged answers: every question/answer pair; the model is
    ``system-prompted`` when its session has a system message."""
    conv = table(spark, sf, "conversations")
    sys_sessions = (conv.filter(F.col("role") == "system")
                    .select(F.col("conv_id").cast("string").alias("session_id")).distinct())
    qa = qa_pairs(spark, sf)
    return (qa.join(sys_sessions.withColumn("has_sys", F.lit(True)), "session_id", "left")
            .select(F.xxhash64("session_id", "turn").alias("log_id"), "question",
                    F.when(F.col("has_sys"), F.lit("system-prompted")).otherwise(F.lit("plain")).alias("model"),
                    F.col("answer").alias("response")))


def expected_table(spark, sf):
    """Expected answers: the last answer to each question of any session."""
    qa = qa_pairs(spark, sf)
    return EV.expected_answers(qa.withColumn("o", F.struct("session_id", "turn")), "question", "answer", "o")


def q_expected_answers(spark, sf):
    return expected_table(spark, sf)


def q_evaluate_answers(spark, sf):
    log = answer_log(spark, sf)
    exp = expected_table(spark, sf)
    emb = R.fit_embedder(exp.select(F.col("question").alias("t")).unionByName(
        exp.select(F.col("expected").alias("t"))), "t")
    return EV.evaluate_answers(log, exp, emb)


def q_model_accuracy(spark, sf):
    flagged = EV.fuzzy_flags(answer_log(spark, sf), expected_table(spark, sf))
    return EV.model_accuracy(flagged).withColumn("accuracy", F.round("accuracy", 6))


def q_matched_count(spark, sf):
    flagged = EV.fuzzy_flags(answer_log(spark, sf), expected_table(spark, sf))
    return EV.matched_count(flagged)


def q_column_widths(spark, sf):
    return EV.column_widths(table(spark, sf, "supplier"))


QUERIES = {
    "expected_answers": q_expected_answers,
    "evaluate_answers": q_evaluate_answers,
    "model_accuracy": q_model_accuracy,
    "matched_count": q_matched_count,
    "column_widths": q_column_widths,
}

_BASE = """messages AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text AS content FROM conversations),
  qa AS (SELECT u.session_id, u.turn, u.content AS question, a.content AS answer
         FROM messages u JOIN messages a ON a.session_id = u.session_id AND a.turn = u.turn + 1
         WHERE u.role = 'user' AND a.role = 'assistant'),
  sys AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id FROM conversations WHERE role = 'system'),
  log AS (SELECT qa.session_id, qa.turn, qa.question,
                 CASE WHEN sys.session_id IS NOT NULL THEN 'system-prompted' ELSE 'plain' END AS model
          FROM qa LEFT JOIN sys USING (session_id)),
  exp AS (SELECT question, arg_max(answer, (session_id, turn)) AS expected FROM qa GROUP BY question),
  fl AS (SELECT l.*, EXISTS (SELECT 1 FROM exp e WHERE
           CASE WHEN greatest(length(l.question), length(e.question)) = 0 THEN 1.0
                ELSE 1 - levenshtein(l.question, e.question) / greatest(length(l.question), length(e.question)) END >= 0.8
         ) AS matched FROM log l)"""

ORACLE = {
    "expected_answers": f"WITH {_BASE} SELECT question, expected FROM exp",
    "model_accuracy": f"""WITH {_BASE}
SELECT model, round(avg(CASE WHEN matched THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM fl GROUP BY model""",
    "matched_count": f"WITH {_BASE} SELECT count(*) FILTER (WHERE matched) AS matched_count FROM fl",
    "column_widths": """SELECT "column", CAST(greatest(coalesce(w, 0), length("column")) + 2 AS INTEGER) AS width FROM (
  SELECT 's_suppkey' AS "column", max(length(CAST(s_suppkey AS VARCHAR))) AS w FROM supplier
  UNION ALL SELECT 's_name', max(length(s_name)) FROM supplier
  UNION ALL SELECT 's_nationkey', max(length(CAST(s_nationkey AS VARCHAR))) FROM supplier
  UNION ALL SELECT 's_acctbal', max(length(CAST(s_acctbal AS VARCHAR))) FROM supplier)""",
}

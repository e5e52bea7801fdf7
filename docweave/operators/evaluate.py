"""Answer-quality evaluation as a DAG of joins: fuzzy flag -> semi-join ->
best semantic match -> BLEU / ROUGE-L -> cosine -> null to empty."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import vectors as V
from docweave.operators import lexical as LX
from docweave.operators import retrieve as R
from docweave.session import reliable_checkpoint


def expected_answers(df: DataFrame, q_col: str, a_col: str, order_col: str) -> DataFrame:
    """question -> expected answer; for repeated questions the last row
    (by ``order_col``) wins. A partial aggregate: hot questions combine
    map-side."""
    return df.groupBy(F.col(q_col).alias("question")).agg(
        F.max_by(F.col(a_col), F.col(order_col)).alias("expected"))


def fuzzy_flags(log: DataFrame, expected: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``log`` rows (``log_id, question, …``) with ``matched``: the question has
    a fuzzy match (ratio >= threshold) among the expected questions."""
    exp = expected.select(F.xxhash64("question").alias("eid"), "question")
    m = LX.fuzzy_best_match(log, exp, l_id="log_id", l_text="question", r_id="eid",
                            r_text="question", threshold=threshold)
    return log.join(m.select("log_id", "matched"), "log_id")


def evaluate_answers(log: DataFrame, expected: DataFrame, embedder: PipelineModel,
                     fuzzy_threshold: float = 0.8, semantic_threshold: float = 0.75) -> DataFrame:
    """Evaluate logged answers against expected ones.

    ``log``: ``(log_id, question, model, response)``; ``expected``:
    ``(question, expected)``. Rows whose question has no fuzzy match are
    dropped; the expected answer comes from the best semantic match of the
    question (cosine >= ``semantic_threshold``, else ``""``); then BLEU,
    ROUGE-L and cosine(response, expected); nulls become ``""``."""
    flagged = reliable_checkpoint(fuzzy_flags(log, expected, fuzzy_threshold).filter(F.col("matched")))
    q_vec = R.embed_text(embedder, flagged, "question", "q_vec")
    e = expected.select(F.xxhash64("question").alias("eid"), "question", "expected")
    e_vec = R.embed_text(embedder, e, "question", "e_vec")
    best = R.best_match_threshold(q_vec, e_vec, q_id="log_id", q_vec="q_vec", c_id="eid",
                                  c_vec="e_vec", c_answer="expected", threshold=semantic_threshold)
    rows = flagged.join(best.select(F.col("q_id").alias("log_id"),
                                    F.col("best_answer").alias("expected_answer")), "log_id")
    bleu = LX.bleu(rows.select("log_id", "expected_answer", "response"), "log_id",
                   "expected_answer", "response")
    scored = (rows.join(bleu, "log_id")
              .withColumn("rouge", LX.rouge_l(F.col("expected_answer"), F.col("response"), stem=True))
              .withColumn("rouge", F.when((F.col("expected_answer") == "") | (F.col("response") == ""),
                                          F.lit(0.0)).otherwise(F.col("rouge"))))
    r_vec = R.embed_text(embedder, scored, "response", "r_vec")
    x_vec = R.embed_text(embedder, r_vec, "expected_answer", "x_vec")
    out = x_vec.withColumn("similarity", V.cosine(F.col("r_vec"), F.col("x_vec")))
    cols = ["log_id", "question", "model", "response", "expected_answer", "bleu", "rouge", "similarity"]
    out = out.select(*cols)
    return out.select("log_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols[1:]])


def model_accuracy(flagged: DataFrame, model_col: str = "model") -> DataFrame:
    """Share of matched questions per model (measured, not placeholders)."""
    return flagged.groupBy(model_col).agg(
        F.avg(F.col("matched").cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def column_widths(df: DataFrame) -> DataFrame:
    """Per column ``max(len(value as text), len(name)) + 2`` as rows
    ``(column, width)``: one aggregate pass, then an unpivot."""
    aggs = [F.max(F.length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))).alias(f"c{i}")
            for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', c{i}" for i, c in enumerate(df.columns))
    long = wide.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column, w)")
    return long.select("column", (F.greatest(F.coalesce("w", F.lit(0)), F.length("column")) + 2).alias("width"))


def matched_count(df: DataFrame, flag_col: str = "matched") -> DataFrame:
    return df.agg(F.count_if(F.col(flag_col)).alias("matched_count"))

"""Hand-made edge rows (FIXTURES §C) for operators not covered elsewhere."""

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import retrieve as R


def test_best_match_threshold_and_empty(spark):
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "q long, v array<double>")
    cands = spark.createDataFrame([(10, [1.0, 0.1], "A"), (11, [0.6, 0.8], "B")], "c long, w array<double>, ans string")
    got = {r.q_id: (r.match_id, r.best_answer) for r in R.best_match_threshold(
        qs, cands, q_id="q", q_vec="v", c_id="c", c_vec="w", c_answer="ans").collect()}
    assert got[1] == (10, "A")       # cosine 0.995
    assert got[2] == (11, "B")       # cosine 0.8 >= 0.75
    low = spark.createDataFrame([(12, [1.0, -1.0], "C")], "c long, w array<double>, ans string")
    got = {r.q_id: r.best_answer for r in R.best_match_threshold(
        qs, low, q_id="q", q_vec="v", c_id="c", c_vec="w", c_answer="ans").collect()}
    assert got == {1: "", 2: ""}     # best cosine 0.707 / -0.707 < 0.75
    none = spark.createDataFrame([], "c long, w array<double>, ans string")
    got = {r.q_id: r.best_answer for r in R.best_match_threshold(
        qs, none, q_id="q", q_vec="v", c_id="c", c_vec="w", c_answer="ans").collect()}
    assert got == {1: "", 2: ""}


def test_body_slice_missing_tags(spark):
    df = spark.createDataFrame([("<html><body>x</body></html>",), ("<p>no body</p>",), ("<body>open",)], "h string")
    got = [(r.b, r.m) for r in df.select(tx.body_slice(F.col("h")).alias("b"),
                                         tx.body_missing(F.col("h")).alias("m")).collect()]
    assert got == [("x", False), ("<p>no body</p>", True), ("open", True)]


def test_four_and_five_word_sentences(spark):
    df = spark.createDataFrame([("One two three four. One two three four five. Did you know this is long.",)], "t string")
    assert df.select(tx.drop_filler_sentences(F.col("t"))).first()[0] == "One two three four five."


def test_cosine_of_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(R.cosine_pair(F.col("a"), F.col("b"))).first()[0] == 0.0

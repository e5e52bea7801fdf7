"""Skew-safe helpers equal plain windows, with tiny buckets so that every
group spans many buckets."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.plans.ordering import dense_index
from docweave.plans.skew import ordered_concat, running_max, seq_number, with_previous


def _df(spark):
    random.seed(3)
    rows = []
    for g in range(4):
        turns = sorted(random.sample(range(0, 200), 30 if g == 0 else 5))  # group 0 is hot
        rows += [(g, t, random.randint(0, 9)) for t in turns]
    return spark.createDataFrame(rows, "g int, t long, v int")


def test_seq_and_previous(spark):
    df = _df(spark)
    got = with_previous(seq_number(df, ["g"], "t", bucket_size=7), ["g"], "seq", ["v"])
    w = Window.partitionBy("g").orderBy("t")
    exp = df.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("prev_v", F.lag("v").over(w))
    assert sorted(got.select("g", "t", "seq", "prev_v").collect()) == \
        sorted(exp.select("g", "t", "seq", "prev_v").collect())


def test_running_max(spark):
    df = _df(spark)
    got = running_max(df, ["g"], "t", F.col("v"), "m", bucket_size=5)
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("m", F.max("v").over(w))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_ordered_concat(spark):
    df = _df(spark).withColumn("s", F.col("v").cast("string"))
    got = {r.g: r.o for r in ordered_concat(df, ["g"], "t", "s", ",", "o", bucket_size=4).collect()}
    for g, rows in df.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("t", "s"))).alias("x")).collect():
        assert got[g] == ",".join(x.s for x in rows)


def test_dense_index(spark):
    words = [f"w{random.randint(0, 10**6):07d}" for _ in range(500)]
    words = sorted(set(words))
    df = spark.createDataFrame([(w,) for w in reversed(words)], "term string")
    got = {r.term: r.i for r in dense_index(df, "term", "i", num_partitions=5).collect()}
    assert got == {w: i for i, w in enumerate(words)}

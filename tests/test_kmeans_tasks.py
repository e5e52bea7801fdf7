"""Tasks of the K-means fits, each of which reports to the driver."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from docweave.operators import topics as TP


def test_fits_take_no_more_tasks_than_cores(spark, monkeypatch):
    parts = []

    class Spy(TP.KMeans):
        def fit(self, df, params=None):
            parts.append(df.rdd.getNumPartitions())
            return super().fit(df, params)

    monkeypatch.setattr(TP, "KMeans", Spy)
    rows = spark.range(0, 600, 1, 50).select("id", array_to_vector(F.array((F.col("id") % 3 * 10).cast("double"), F.lit(1.0))).alias("features"))
    out, _ = TP.kmeans_topics(rows, 3, 42, 2)
    found = {(r["id"] % 3, r["cluster"]) for r in out.select("id", "cluster").collect()}
    assert out.count() == 600 and len(found) == 3 and len({c for _, c in found}) == 3
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism

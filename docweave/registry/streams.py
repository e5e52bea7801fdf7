"""Registered queries: Structured Streaming operators (§2.12). Each query
stages table rows as files under the shared checkpoint folder, runs the
stream to completion (``availableNow``) and reads the sink back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from docweave.operators import retrieve as R
from docweave.registry.retrieval import _CENTROIDS
from docweave.registry.sqlfrag import sq_l2
from docweave.session import scratch_dir, table
from docweave.streaming import pipelines as S


def _stage(df, n_files):
    path = scratch_dir(df.sparkSession, "stream_in")
    df.repartition(n_files).write.parquet(path)
    return path


def q_stream_retrieve(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    cents = R.document_vector(table(spark, sf, "embeddings"), "label", "embedding").select(
        F.col("label").cast("long").alias("c_id"), "doc_vec")
    src = _stage(e, 4)
    out = scratch_dir(spark, "stream_out")
    S.stream_retrieve(spark, src, "vec_id long, embedding array<float>", cents, out,
                      os.path.join(out + "_ckpt"), 3, q_id="vec_id", q_vec="embedding",
                      b_id="c_id", b_vec="doc_vec")
    return spark.read.parquet(out).select("q_id", "b_id", "rank", F.round("score", 6).alias("dist"))


def q_stream_append_log(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    src = scratch_dir(spark, "log_in")
    ev.repartition(2).write.parquet(src)
    ev.repartition(2).write.mode("append").parquet(src)  # a replay of every record
    out = scratch_dir(spark, "log_out")
    S.stream_append_log(spark, src, "event_id long, ts timestamp_ntz, event_type string, value double",
                        out, out + "_ckpt", "event_id", "ts")
    return spark.read.parquet(out).drop("event_day")


def q_stream_corpus_refresh(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    # three micro-batches of several files each: one file would be read, and its
    # pages dealt out, by one task
    files = max(spark.sparkContext.defaultParallelism, -(-pages.rdd.getNumPartitions() // 3))
    src = _stage(pages, 3 * files)
    store = scratch_dir(spark, "vector_store")
    S.stream_corpus_refresh(spark, src, "page_id long, html string", store, store + "_ckpt", files)
    return spark.read.parquet(store).select("content_hash", F.size("embedding").alias("dim"))


QUERIES = {
    "stream_retrieve": q_stream_retrieve,
    "stream_append_log": q_stream_append_log,
    "stream_corpus_refresh": q_stream_corpus_refresh,
}

ORACLE = {
    "stream_retrieve": f"""WITH {_CENTROIDS},
  d AS (SELECT e.vec_id AS q_id, c.c_id AS b_id, {sq_l2('e.embedding', 'c.doc_vec')} AS dist
        FROM embeddings e CROSS JOIN c),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS INTEGER) AS rank FROM d)
SELECT q_id, b_id, rank, round(dist, 6) AS dist FROM r WHERE rank <= 3""",
    "stream_append_log": "SELECT event_id, ts, event_type, value FROM events",
}

"""Structured Streaming operators (re-aimed: the reference answers one
question per thread and rewrites whole files per append).

* ``stream_retrieve``: a file stream of query vectors; each micro-batch is
  ranked against a static base with the same exact top-k as the batch path
  (``foreachBatch``: ranking windows are not allowed on streams) and written
  to a table partitioned by batch id, overwriting only that partition, so a
  replayed batch is idempotent.
* ``stream_append_log``: appends with a checkpoint; duplicates of a record id
  are dropped within the watermark, so a replayed file adds nothing.
* ``stream_corpus_refresh``: new pages are parsed, chunked and embedded with
  a fit-free hashing embedder, and only content not yet in the store is
  appended: incremental equals a full rebuild.
"""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import chunk as C
from docweave.operators import html as H
from docweave.plans.topk import knn
from docweave.sources import sinks as SNK
from docweave.sources.paths import missing_path


def stream_retrieve(spark: SparkSession, queries_dir: str, query_schema: str, base: DataFrame,
                    out_dir: str, checkpoint: str, k: int, *, q_id: str, q_vec: str, b_id: str,
                    b_vec: str, max_files_per_trigger: int = 1) -> None:
    """Run the retrieval stream until the available input is consumed."""
    stream = (spark.readStream.schema(query_schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(queries_dir))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        hits = knn(batch, base, k, q_id=q_id, q_vec=q_vec, b_id=b_id, b_vec=b_vec)
        (hits.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_dir))

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_append_log(spark: SparkSession, in_dir: str, schema: str, out_dir: str, checkpoint: str,
                      id_col: str, ts_col: str, max_files_per_trigger: int = 1) -> None:
    """Append records to ``out_dir``, partitioned by ``event_day``; a record
    whose id has been written for its day is a replay and is left out. No
    record is ever too late and no ids are held as state: each micro-batch is
    compared with the written days it touches (partition pruning), so a retried
    batch doesn't duplicate rows either. Records without a time go to the null
    day."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(in_dir))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("event_day", F.to_date(F.col(ts_col))).dropDuplicates([id_col, "event_day"])
        try:
            written = batch.sparkSession.read.parquet(out_dir).select(F.col(id_col).alias("__id"), F.col("event_day").alias("__day"))
        except AnalysisException as e:
            if not missing_path(e):
                raise
        else:
            same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col("event_day").eqNullSafe(F.col("__day").cast("date"))
            new = new.join(written, same, "left_anti")
        new.write.mode("append").partitionBy("event_day").parquet(out_dir)

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def hashing_embedder(text_col: str = "chunk", dim: int = 512):
    """Fit-free embedder (tokens -> hashed tf -> L2): a batch embeds the same
    way whatever else is in the corpus, so incremental refreshes are exact."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"[\p{L}\p{N}_]+",
                         gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim)
    nrm = Normalizer(inputCol="__tf", outputCol="__vec", p=2.0)

    def embed(df: DataFrame) -> DataFrame:
        out = nrm.transform(tf.transform(tok.transform(df)))
        return out.withColumn("embedding", vector_to_array("__vec", "float32")).drop("__tok", "__tf", "__vec")
    return embed


def page_chunks(pages: DataFrame, size: int = 500) -> DataFrame:
    """pages -> paragraphs -> normalised text -> fixed chunks."""
    parsed = H.parse_pages(pages.select("page_id", "html"), body_only=True)
    docs = parsed.select("page_id", tx.normalize_whitespace(H.paragraphs(F.col("paras"))).alias("text"))
    return C.chunk_fixed(docs, "text", size).withColumn("chunk_id", F.xxhash64("page_id", "chunk_no"))


def page_chunk_vectors(pages: DataFrame, size: int = 500) -> DataFrame:
    """``page_chunks`` with their vectors."""
    return hashing_embedder("chunk")(page_chunks(pages, size))


def stream_corpus_refresh(spark: SparkSession, pages_dir: str, pages_schema: str, store: str,
                          checkpoint: str, max_files_per_trigger: int = 1) -> None:
    """Each micro-batch of new pages is chunked and embedded; only content
    not yet stored is appended to the vector store."""
    stream = (spark.readStream.schema(pages_schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(pages_dir))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        SNK.vector_store_write(batch.sparkSession, page_chunks(batch), store, "chunk", "chunk_id", embed=hashing_embedder("chunk"))

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()

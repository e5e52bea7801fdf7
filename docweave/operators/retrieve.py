"""Embedding, nearest neighbours, routing and context assembly."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import vectors as V
from docweave.plans.topk import knn, knn_routed

EMBED_DIM = 512


# -- embedding ------------------------------------------------------------------

def fit_embedder(corpus: DataFrame, text_col: str = "text", dim: int = EMBED_DIM) -> PipelineModel:
    """Deterministic text embedder: Unicode word tokens -> hashed term
    frequencies -> IDF fitted on the corpus -> L2 normalisation. (Stands in
    for the neural sentence model, which is not available offline.)"""
    stages = [
        RegexTokenizer(inputCol="__text", outputCol="__tok", pattern=r"[\p{L}\p{N}_]+",
                       gaps=False, toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim),
        IDF(inputCol="__tf", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol="__vec", p=2.0),
    ]
    return Pipeline(stages=stages).fit(
        corpus.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text")))


def embed_text(model: PipelineModel, df: DataFrame, text_col: str = "text",
               out_col: str = "embedding") -> DataFrame:
    """Adds ``out_col ARRAY<FLOAT>``; documents and queries go through the
    same fitted model."""
    filled = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    out = model.transform(filled)
    return (out.withColumn(out_col, vector_to_array("__vec", "float32"))
            .drop("__text", "__tok", "__tf", "__idf", "__vec"))


# -- nearest neighbours ---------------------------------------------------------------

def knn_l2(queries: DataFrame, base: DataFrame, k: int = 3, *, q_id: str, q_vec: str,
           b_id: str, b_vec: str, exclude_self: bool = False) -> DataFrame:
    """Exact k nearest by squared L2 (ascending, ties by id):
    ``(q_id, b_id, dist, rank)``."""
    return (knn(queries, base, k, q_id=q_id, q_vec=q_vec, b_id=b_id, b_vec=b_vec,
                exclude_self=exclude_self)
            .withColumnRenamed("score", "dist"))


def knn_ranked(hits: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds the neighbour text and a 2-decimal distance string; columns
    ``q_id, rank, text, distance``."""
    return (hits.join(texts.select(F.col(id_col).alias("b_id"), F.col(text_col).alias("text")), "b_id")
            .select("q_id", "rank", "text", F.format_string("%.2f", F.col("dist")).alias("distance")))


def retrieve_topk(questions: DataFrame, chunks: DataFrame, k: int = 4, *,
                  q_id: str = "q_id", q_vec: str = "embedding",
                  c_id: str = "chunk_id", c_vec: str = "embedding") -> DataFrame:
    """Retriever over chunk vectors: top-``k`` chunks per question."""
    return knn_l2(questions, chunks, k, q_id=q_id, q_vec=q_vec, b_id=c_id, b_vec=c_vec)


def knn_per_document(queries: DataFrame, base: DataFrame, k: int, doc_col: str, *,
                     q_id: str, q_vec: str, b_id: str, b_vec: str,
                     routes: DataFrame | None = None) -> DataFrame:
    """One index per document: top-``k`` within each (query, document). With
    ``routes`` (``(q_id, doc)`` pairs) only the routed documents of each
    query are searched, in skew-split cogroup cells; without, every document
    answers every query (meant for a bounded number of documents)."""
    if routes is not None:
        hits = knn_routed(queries, base, routes, k, q_id=q_id, q_vec=q_vec, b_id=b_id, b_vec=b_vec,
                          group=doc_col, per_group=True)
    else:
        hits = knn(queries, base, k, q_id=q_id, q_vec=q_vec, b_id=b_id, b_vec=b_vec, group=doc_col)
    return hits.withColumnRenamed("score", "dist")


def document_vector(chunks: DataFrame, doc_col: str, vec_col: str) -> DataFrame:
    """Per-document routing vector: element-wise mean of its chunk vectors.
    Aggregates per (document, dimension) first, so a huge document is
    combined map-side and only ``dim`` values per document are collected."""
    per_dim = (chunks.select(doc_col, F.posexplode(vec_col).alias("i", "x"))
               .groupBy(doc_col, "i").agg(F.avg(F.col("x").cast("double")).alias("m")))
    return (per_dim.groupBy(doc_col)
            .agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("__s"))
            .select(doc_col, F.transform("__s", lambda s: s["m"].cast("float")).alias("doc_vec")))


def route_then_rerank(queries: DataFrame, chunks: DataFrame, *, q_id: str, q_vec: str,
                      c_id: str, c_vec: str, doc_col: str, n_docs: int = 10,
                      top_n: int = 5) -> DataFrame:
    """Route each query to its ``n_docs`` nearest documents (by document
    vector), then re-score only the chunks of those documents by exact cosine
    and keep ``top_n``. The second stage scores routed (query, document)
    pairs only, in cogroup cells split by per-document counts, so neither the
    number of documents nor one huge document blows up the work."""
    docs = document_vector(chunks, doc_col, c_vec)
    routed = (knn(queries, docs, n_docs, q_id=q_id, q_vec=q_vec, b_id=doc_col, b_vec="doc_vec")
              .select(F.col("q_id").alias(q_id), F.col("b_id").alias(doc_col)))
    hits = knn_routed(queries, chunks, routed, top_n, q_id=q_id, q_vec=q_vec, b_id=c_id,
                      b_vec=c_vec, group=doc_col, metric="cosine")
    return hits.select("q_id", F.col("b_id").alias(c_id), doc_col, F.col("score").alias("cosine"), "rank")


def cosine_pair(a: Column, b: Column) -> Column:
    return V.cosine(a, b)


def best_match_threshold(questions: DataFrame, candidates: DataFrame, *, q_id: str, q_vec: str,
                         c_id: str, c_vec: str, c_answer: str,
                         threshold: float = 0.75) -> DataFrame:
    """Argmax cosine over candidates (ties -> lowest id); the answer when the
    best score reaches ``threshold``, else ``""``. Questions with no
    candidates get ``""``."""
    best = knn(questions, candidates, 1, q_id=q_id, q_vec=q_vec, b_id=c_id, b_vec=c_vec,
               metric="cosine")
    ans = candidates.select(F.col(c_id).cast("long").alias("b_id"), F.col(c_answer).alias("__ans"))
    scored = best.join(ans, "b_id").select("q_id", "b_id", "score", "__ans")
    return (questions.select(F.col(q_id).cast("long").alias("q_id")).join(scored, "q_id", "left")
            .select("q_id", F.col("b_id").alias("match_id"), F.col("score").alias("best_score"),
                    F.when(F.col("score") >= threshold, F.col("__ans")).otherwise(F.lit(""))
                    .alias("best_answer")))


# -- context and prompt ------------------------------------------------------------------

def assemble_context(hits: DataFrame, texts: DataFrame, id_col: str, text_col: str,
                     bullet: bool = False) -> DataFrame:
    """Retrieved texts per query, newline-joined in rank order (``k`` rows per
    query, so the collected group is bounded by ``k``)."""
    joined = hits.join(texts.select(F.col(id_col).cast("long").alias("b_id"),
                                    F.col(text_col).alias("__t")), "b_id")
    item = F.concat(F.lit("- "), F.col("__t")) if bullet else F.col("__t")
    return (joined.groupBy("q_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("t")))).alias("__s"))
            .select("q_id", F.array_join(F.transform("__s", lambda s: s["t"]), "\n").alias("context")))


# Our own prompt template; slots {question} and {context}.
PROMPT_TEMPLATE = (
    "Answer the question using only the context below. If the context does not "
    "contain the answer, say that you do not know.\n\n"
    "Context:\n{context}\n\nQuestion: {question}\nAnswer:"
)


def build_prompt(question: Column, context: Column, template: str = PROMPT_TEMPLATE) -> Column:
    """Fill ``{question}`` and ``{context}`` in ``template``."""
    t = F.replace(F.lit(template), F.lit("{context}"), F.coalesce(context, F.lit("")))
    return F.replace(t, F.lit("{question}"), F.coalesce(question, F.lit("")))

"""Registered queries: chunking, embedding, nearest neighbours, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import chunk as C
from docweave.operators import html as H
from docweave.operators import lsa
from docweave.operators import retrieve as R
from docweave.operators import sentences as SE
from docweave.registry.sqlfrag import cosine, sq_l2
from docweave.plans.parallel import spread
from docweave.session import reliable_checkpoint, table


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _centroids(spark, sf):
    """Label centroids (document vectors of the embedding table)."""
    return R.document_vector(_emb(spark, sf), "label", "embedding").select(
        F.col("label").cast("long").alias("c_id"), "doc_vec")


def page_chunks(spark, sf, size=500):
    """pages -> first-generation paragraphs -> whitespace-normalised ->
    fixed 500-char chunks with a stable 64-bit chunk id."""
    parsed = H.parse_pages(table(spark, sf, "pages").select("page_id", "html"), body_only=True)
    docs = parsed.select("page_id", tx.normalize_whitespace(H.paragraphs(F.col("paras"))).alias("text"))
    return (C.chunk_fixed(docs, "text", size)
            .withColumn("chunk_id", F.xxhash64("page_id", "chunk_no")))


def rag_prompts(spark, sf, k=4):
    """Flagship: every user question -> top-k page chunks -> prompt. The
    chunk table (one HTML parse pass) is written once to the shared
    checkpoint folder: the embedder fit, the index and the context join all
    read it, as a persisted index would be."""
    chunks = reliable_checkpoint(page_chunks(spark, sf))
    model = R.fit_embedder(chunks, "chunk")
    chunk_vecs = R.embed_text(model, chunks, "chunk", "embedding")
    questions = (table(spark, sf, "conversations").filter(F.col("role") == "user")
                 .select("conv_id", "turn", F.col("text").alias("question"))
                 .withColumn("q_id", F.xxhash64("conv_id", "turn")))
    q_vecs = R.embed_text(model, questions, "question", "embedding")
    hits = R.retrieve_topk(q_vecs, chunk_vecs, k, q_id="q_id", q_vec="embedding",
                           c_id="chunk_id", c_vec="embedding")
    ctx = R.assemble_context(hits, chunks, "chunk_id", "chunk")
    return (questions.join(ctx, "q_id", "left")
            .select("conv_id", "turn", "question",
                    R.build_prompt(F.col("question"), F.col("context")).alias("prompt")))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def q_chunk_fixed_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return C.chunk_fixed(docs, "text", 500).select("doc_id", "chunk_no", "start", "end", "chunk")


def q_chunk_recursive_chars(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return C.chunk_recursive_chars(docs, ["doc_id"], "text", 500, 100)


def q_chunk_recursive_tokens(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return C.chunk_recursive_tokens(docs, ["doc_id"], "text", 500, 20, VOCABULARY)


def q_chunk_sentences(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return C.chunk_sentences(docs, ["doc_id"], "text", vocabulary=VOCABULARY, model=SE.sentence_model(docs))


def q_sentence_split(spark, sf):
    """Sentences of all documents by the boundaries learnt from them, without
    fillers: at least five words, not starting with "did you know"."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    found = SE.split_learnt(docs, SE.sentence_model(docs), ["doc_id"])
    return found.filter(tx.has_min_words(F.col("sentence"), 5) & ~F.lower("sentence").startswith("did you know"))


def q_abbreviations(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return SE.abbreviations(SE.corpus_counts(docs, "text")).select("type", F.round("score", 4).alias("score"))


def q_chunk_union(spark, sf):
    """All documents' chunks in one table with provenance (doc, source)."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return C.chunk_fixed(docs, "text", 500).select(
        "doc_id", "source", "chunk_no", F.length("chunk").alias("n_chars"))


def q_embed_text(spark, sf):
    chunks = page_chunks(spark, sf)
    model = R.fit_embedder(chunks, "chunk")
    vecs = R.embed_text(model, chunks, "chunk", "embedding")
    return vecs.select("page_id", "chunk_no", F.size("embedding").alias("dim"),
                       F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0),
                                                  lambda a, x: a + x * x)), 3).alias("norm"))


def q_embed_dense(spark, sf):
    """Learnt vectors of all documents."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return lsa.fit_dense(docs, "doc_id", "text").embed(docs, ["doc_id"], "text").select(
        "doc_id", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"))


def q_knn_l2(spark, sf):
    e = _emb(spark, sf)
    hits = R.knn_l2(e, e, 3, q_id="vec_id", q_vec="embedding", b_id="vec_id",
                    b_vec="embedding", exclude_self=True)
    return hits.select("q_id", "b_id", "rank", F.round("dist", 6).alias("dist"))


def q_knn_ranked(spark, sf):
    e = _emb(spark, sf)
    hits = R.knn_l2(e, e, 3, q_id="vec_id", q_vec="embedding", b_id="vec_id",
                    b_vec="embedding", exclude_self=True)
    texts = e.select("vec_id", F.concat(F.lit("item "), F.col("vec_id").cast("string"),
                                        F.lit(" label "), F.col("label").cast("string")).alias("text"))
    return R.knn_ranked(hits, texts, "vec_id", "text")


def q_retrieve_topk(spark, sf, k=4):
    hits = R.retrieve_topk(_centroids(spark, sf), _emb(spark, sf), k, q_id="c_id", q_vec="doc_vec",
                           c_id="vec_id", c_vec="embedding")
    return hits.select("q_id", "b_id", "rank", F.round("dist", 6).alias("dist"))


def q_knn_copies(spark, sf, copies=12, offset=1e6, k=20):
    """Label centroids against twelve copies of every vector, all moved by a
    large offset: ties, and nothing left of the digits that an expanded square
    would need."""
    def moved(c):
        return F.transform(F.col(c).cast("array<double>"), lambda x: x + F.lit(offset))

    base = _emb(spark, sf).select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("c"), "vec_id", moved("embedding").alias("v"))
    base = base.select((F.col("vec_id") * copies + F.col("c")).alias("b"), "v")
    cents = _centroids(spark, sf).select("c_id", moved("doc_vec").alias("v"))
    hits = R.knn_l2(cents, base, k, q_id="c_id", q_vec="v", b_id="b", b_vec="v")
    return hits.select("q_id", "b_id", "rank", F.round("dist", 6).alias("dist"))


def q_knn_per_document(spark, sf):
    hits = R.knn_per_document(_centroids(spark, sf), _emb(spark, sf), 2, "label",
                              q_id="c_id", q_vec="doc_vec", b_id="vec_id", b_vec="embedding")
    return hits.select("q_id", "label", "b_id", "rank", F.round("dist", 6).alias("dist"))


def q_document_vector(spark, sf):
    dv = R.document_vector(_emb(spark, sf), "label", "embedding")
    return dv.select("label", F.posexplode("doc_vec").alias("i", "x")).select(
        "label", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def q_route_then_rerank(spark, sf):
    e = _emb(spark, sf)
    out = R.route_then_rerank(e, e, q_id="vec_id", q_vec="embedding", c_id="vec_id",
                              c_vec="embedding", doc_col="label", n_docs=3, top_n=5)
    return out.select(F.col("q_id"), F.col("vec_id").alias("b_id"), "label", "rank",
                      F.round("cosine", 6).alias("cosine"))


def q_cosine_pair(spark, sf):
    e = _emb(spark, sf)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(nxt, "vec_id").select(
        "vec_id", F.round(R.cosine_pair(F.col("embedding"), F.col("e2")), 6).alias("cosine"))


def q_best_match_threshold(spark, sf):
    cands = _centroids(spark, sf).withColumn(
        "answer", F.concat(F.lit("topic "), F.col("c_id").cast("string")))
    out = R.best_match_threshold(_emb(spark, sf), cands, q_id="vec_id", q_vec="embedding",
                                 c_id="c_id", c_vec="doc_vec", c_answer="answer")
    return out.select("q_id", "match_id", F.round("best_score", 6).alias("best_score"), "best_answer")


def _item_texts(e):
    return e.select("vec_id", F.concat(F.lit("item "), F.col("vec_id").cast("string"),
                                       F.lit(" label "), F.col("label").cast("string")).alias("text"))


def q_assemble_context(spark, sf):
    e = _emb(spark, sf)
    hits = R.knn_l2(e, e, 3, q_id="vec_id", q_vec="embedding", b_id="vec_id",
                    b_vec="embedding", exclude_self=True)
    return R.assemble_context(hits, _item_texts(e), "vec_id", "text")


def q_build_prompt(spark, sf):
    ctx = q_assemble_context(spark, sf)
    return ctx.select("q_id", R.build_prompt(
        F.concat(F.lit("What is near item "), F.col("q_id").cast("string"), F.lit("?")),
        F.col("context")).alias("prompt"))


QUERIES = {
    "rag_prompts": rag_prompts,
    "chunk_fixed": q_chunk_fixed_text,
    "chunk_recursive_chars": q_chunk_recursive_chars,
    "chunk_recursive_tokens": q_chunk_recursive_tokens,
    "chunk_sentences": q_chunk_sentences,
    "sentence_split": q_sentence_split,
    "abbreviations": q_abbreviations,
    "chunk_union": q_chunk_union,
    "embed_text": q_embed_text,
    "embed_dense": q_embed_dense,
    "knn_l2": q_knn_l2,
    "knn_ranked": q_knn_ranked,
    "retrieve_topk": q_retrieve_topk,
    "knn_copies": q_knn_copies,
    "knn_per_document": q_knn_per_document,
    "document_vector": q_document_vector,
    "route_then_rerank": q_route_then_rerank,
    "cosine_pair": q_cosine_pair,
    "best_match_threshold": q_best_match_threshold,
    "assemble_context": q_assemble_context,
    "build_prompt": q_build_prompt,
}

_SELF_KNN = f"""
  d AS (SELECT q.vec_id AS q_id, b.vec_id AS b_id, {sq_l2('q.embedding', 'b.embedding')} AS dist
        FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id),
  r AS (SELECT q_id, b_id, dist,
               CAST(row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS INTEGER) AS rank
        FROM d)"""

_CENTROIDS = """
  ex AS (SELECT label, i, embedding[i]::DOUBLE AS x
         FROM embeddings, range(1, len(embedding) + 1) t(i)),
  cm AS (SELECT label, i, avg(x) AS m FROM ex GROUP BY label, i),
  c AS (SELECT CAST(label AS BIGINT) AS c_id,
               list(m::FLOAT ORDER BY i) AS doc_vec FROM cm GROUP BY label)"""

_TEMPLATE = R.PROMPT_TEMPLATE.replace("'", "''")

ORACLE = {
    "chunk_fixed": """
SELECT doc_id, CAST(s AS INTEGER) AS chunk_no, CAST(s * 500 AS INTEGER) AS start,
       CAST(s * 500 + length(substr(text, s * 500 + 1, 500)) AS INTEGER) AS "end",
       substr(text, s * 500 + 1, 500) AS chunk
FROM documents, range(0, CAST(ceil(length(text) / 500.0) AS BIGINT)) t(s)""",
    "chunk_union": """
SELECT doc_id, source, CAST(s AS INTEGER) AS chunk_no,
       CAST(length(substr(text, s * 500 + 1, 500)) AS INTEGER) AS n_chars
FROM documents, range(0, CAST(ceil(length(text) / 500.0) AS BIGINT)) t(s)""",
    "knn_l2": f"""
WITH {_SELF_KNN}
SELECT q_id, b_id, rank, round(dist, 6) AS dist FROM r WHERE rank <= 3""",
    "knn_ranked": f"""
WITH {_SELF_KNN}
SELECT r.q_id, r.rank, 'item ' || CAST(e.vec_id AS VARCHAR) || ' label ' || CAST(e.label AS VARCHAR) AS text,
       printf('%.2f', r.dist) AS distance
FROM r JOIN embeddings e ON e.vec_id = r.b_id WHERE r.rank <= 3""",
    "retrieve_topk": f"""
WITH {_CENTROIDS},
  d AS (SELECT c.c_id AS q_id, e.vec_id AS b_id, {sq_l2('c.doc_vec', 'e.embedding')} AS dist
        FROM c CROSS JOIN embeddings e),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS INTEGER) AS rank FROM d)
SELECT q_id, b_id, rank, round(dist, 6) AS dist FROM r WHERE rank <= 4""",
    "knn_copies": f"""
WITH {_CENTROIDS},
  b AS (SELECT vec_id * 12 + t.i AS b_id, list_transform(embedding, lambda x: x::DOUBLE + 1000000) AS v FROM embeddings, range(12) t(i)),
  q AS (SELECT c_id AS q_id, list_transform(doc_vec, lambda x: x::DOUBLE + 1000000) AS v FROM c),
  d AS (SELECT q_id, b_id, {sq_l2('q.v', 'b.v')} AS dist FROM q CROSS JOIN b),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS INTEGER) AS rank FROM d)
SELECT q_id, b_id, rank, round(dist, 6) AS dist FROM r WHERE rank <= 20""",
    "knn_per_document": f"""
WITH {_CENTROIDS},
  d AS (SELECT c.c_id AS q_id, e.label, e.vec_id AS b_id, {sq_l2('c.doc_vec', 'e.embedding')} AS dist
        FROM c CROSS JOIN embeddings e),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id, label ORDER BY dist, b_id) AS INTEGER) AS rank FROM d)
SELECT q_id, label, b_id, rank, round(dist, 6) AS dist FROM r WHERE rank <= 2""",
    "document_vector": f"""
WITH {_CENTROIDS}
SELECT CAST(c_id AS INTEGER) AS label, CAST(i - 1 AS INTEGER) AS i, round(doc_vec[i]::DOUBLE, 5) AS x
FROM c, range(1, len(doc_vec) + 1) t(i)""",
    "route_then_rerank": f"""
WITH {_CENTROIDS},
  routed AS (SELECT q_id, label FROM (
      SELECT e.vec_id AS q_id, CAST(c.c_id AS INTEGER) AS label,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY {sq_l2('e.embedding', 'c.doc_vec')}, c.c_id) AS rn
      FROM embeddings e CROSS JOIN c) WHERE rn <= 3),
  s AS (SELECT r.q_id, b.vec_id AS b_id, b.label, {cosine('q.embedding', 'b.embedding')} AS cos
        FROM routed r JOIN embeddings q ON q.vec_id = r.q_id
        JOIN embeddings b ON b.label = r.label),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, b_id) AS INTEGER) AS rank FROM s)
SELECT q_id, b_id, label, rank, round(cos, 6) AS cosine FROM k WHERE rank <= 5""",
    "cosine_pair": f"""
SELECT a.vec_id, round({cosine('a.embedding', 'b.embedding')}, 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "best_match_threshold": f"""
WITH {_CENTROIDS},
  s AS (SELECT e.vec_id AS q_id, c.c_id AS match_id, {cosine('e.embedding', 'c.doc_vec')} AS score
        FROM embeddings e CROSS JOIN c),
  b AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, match_id) AS rn FROM s)
SELECT q_id, match_id, round(score, 6) AS best_score,
       CASE WHEN score >= 0.75 THEN 'topic ' || CAST(match_id AS VARCHAR) ELSE '' END AS best_answer
FROM b WHERE rn = 1""",
    "assemble_context": f"""
WITH {_SELF_KNN}
SELECT r.q_id, string_agg('item ' || CAST(e.vec_id AS VARCHAR) || ' label ' || CAST(e.label AS VARCHAR), chr(10) ORDER BY r.rank) AS context
FROM r JOIN embeddings e ON e.vec_id = r.b_id WHERE r.rank <= 3 GROUP BY r.q_id""",
    "build_prompt": f"""
WITH {_SELF_KNN},
  ctx AS (SELECT r.q_id, string_agg('item ' || CAST(e.vec_id AS VARCHAR) || ' label ' || CAST(e.label AS VARCHAR), chr(10) ORDER BY r.rank) AS context
          FROM r JOIN embeddings e ON e.vec_id = r.b_id WHERE r.rank <= 3 GROUP BY r.q_id)
SELECT q_id, replace(replace('{_TEMPLATE}', '{{context}}', context), '{{question}}',
       'What is near item ' || CAST(q_id AS VARCHAR) || '?') AS prompt FROM ctx""",
}

"""Topics and clusters: TF-IDF vectors, K-means, centroid assignment,
cluster names, topic trees, LDA, density clusters, 2-D projection."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import lda
from docweave.operators.retrieve import document_vector
from docweave.plans.topk import knn, radius_components_edges
from docweave.session import written


def tfidf_vectors(weights: DataFrame, id_col: str, vocab: DataFrame,
                  ids: DataFrame | None = None) -> DataFrame:
    """Long-form ``(id, term, weight)`` -> dense ``features`` vectors over the
    vocabulary in term order. The vocabulary is a bounded max-features list
    (it is broadcast and sets the vector length). With ``ids``,
    documents without any vocabulary term get a zero vector."""
    # the vocabulary is bounded (max_features), so one small window is fine
    vidx = vocab.select("term", F.dense_rank().over(Window.orderBy("term")).alias("ix"))
    n = vocab.count()
    m = (weights.join(F.broadcast(vidx), "term")
         .groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(F.col("ix") - 1, "weight"))).alias("m")))
    if ids is not None:
        m = ids.select(id_col).join(m, id_col, "left")
    arr = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return m.select(id_col, array_to_vector(arr).alias("features"))


def kmeans_topics(features: DataFrame, k_max: int = 6, seed: int = 42, restarts: int = 10):
    """K-means with ``k = min(k_max, n)``; the best of ``restarts`` seeded fits
    by training cost. Returns (assignments ``(…, cluster)``, model)."""
    cached = features.cache()
    n = cached.count()
    k = max(1, min(k_max, n))
    # each task of each iteration reports to the driver: no more of them than cores
    cores = features.sparkSession.sparkContext.defaultParallelism
    few = cached.coalesce(cores) if cached.rdd.getNumPartitions() > cores else cached
    best = None
    for s in range(seed, seed + restarts):
        model = KMeans(k=k, seed=s, featuresCol="features", predictionCol="cluster",
                       initMode="k-means||", maxIter=300).fit(few)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    out = best[1].transform(cached)
    return out, best[1]


def assign_nearest_centroid(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Centroid per label (element-wise mean) and each vector's nearest
    centroid (k=1, ties -> lowest label)."""
    cents = document_vector(vectors, label_col, vec_col).select(
        F.col(label_col).cast("long").alias("c"), "doc_vec")
    hits = knn(vectors, cents, 1, q_id=id_col, q_vec=vec_col, b_id="c", b_vec="doc_vec")
    return hits.select(F.col("q_id").alias(id_col), F.col("b_id").alias("cluster"),
                       F.col("score").alias("dist"))


def cluster_names(weights: DataFrame, id_col: str, assignments: DataFrame) -> DataFrame:
    """Top-weight term of each cluster centroid (mean weight over all members,
    zeros included); ties -> the later term, as a reversed ascending sort."""
    sizes = assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    mean = (weights.join(assignments.select(id_col, "cluster"), id_col)
            .groupBy("cluster", "term").agg(F.sum("weight").alias("s"))
            .join(sizes, "cluster").withColumn("mean", F.col("s") / F.col("size")))
    return mean.groupBy("cluster").agg(
        F.max_by("term", F.struct("mean", "term")).alias("name"),
        F.max("mean").alias("weight"))


def topic_tree(items: DataFrame, topic_col: str = "topic", sub_col: str = "sub") -> DataFrame:
    """Items grouped by topic with distinct sorted children. Pairs are
    de-duplicated first, so each topic collects only its distinct children.
    Empty input -> one ``"No Data"`` topic with no children."""
    tree = (items.select(topic_col, sub_col).distinct()
            .groupBy(topic_col).agg(F.sort_array(F.collect_list(sub_col)).alias("children")))
    spark = items.sparkSession
    n_items = items.agg(F.count(F.lit(1))).scalar()
    no_data = spark.createDataFrame([("No Data", [])], f"{topic_col} string, children array<string>")
    return tree.unionByName(no_data.filter(n_items == 0))


def lda_topics(docs: DataFrame, text_col: str, k: int = 5, max_iter: int = 10, seed: int = 42,
               top_words: int = 10, id_col: str = "doc_id") -> DataFrame:
    """LDA over topic-token counts (de-accented alphabetic tokens, stop words
    out; one document per row, not one joined string); top words per topic:
    ``(topic, rank, term, weight)``. Documents without tokens play no part;
    without any there are no rows."""
    return lda.top_terms(lda.fit(docs, text_col, id_col, k, max_iter, seed), k, top_words)


def _canonical(df: DataFrame, x: str, y: str) -> DataFrame:
    return (df.filter(F.col(x) != F.col(y))
            .select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))


def connected_components(nodes: DataFrame, edges: DataFrame, checkpoint_every: int = 1) -> DataFrame:
    """``(id, comp)``: each node labelled by the smallest id of its component.

    Large-Star / Small-Star rounds (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014): every round is a few joins and partial
    ``min`` aggregates, and the number of rounds grows with log^2 of the
    component size, not with its diameter (a long chain converges quickly).
    The edge set is cut by tables written to the shared folder; the
    loop ends only when a round leaves it unchanged."""
    e = _canonical(edges.select("src", "dst"), "src", "dst")
    r = 0
    while True:
        both = _both_ways(e)
        # large star: link every larger neighbour of u to the smallest of u's neighbourhood
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _canonical(both.filter(F.col("v") > F.col("u")).join(m, "u")
                           .select(F.col("v").alias("x"), F.col("m").alias("y")), "x", "y")
        # small star: link u and its smaller neighbours to the smallest of them
        low = _both_ways(large).filter(F.col("v") < F.col("u"))
        ms = low.groupBy("u").agg(F.min("v").alias("m"))
        small = (low.join(ms, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
                 .unionByName(ms.select(F.col("u").alias("x"), F.col("m").alias("y"))))
        new_e = _canonical(small, "x", "y")
        if (r + 1) % checkpoint_every == 0:
            new_e = written(new_e, "components")  # a checkpoint would carry size estimates that square per round
        # one job: any edge present on only one side of the round
        changed = (new_e.withColumn("__n", F.lit(1)).join(e.withColumn("__o", F.lit(1)), ["a", "b"], "full_outer")
                   .filter(F.col("__n").isNull() | F.col("__o").isNull()).limit(1).count())
        e, r = new_e, r + 1
        if changed == 0:
            break
    # converged: stars centred on each component's minimum
    centre = _both_ways(e).groupBy("u").agg(F.min("v").alias("mv"))
    return (nodes.select("id").distinct().join(centre, nodes["id"] == centre["u"], "left")
            .select("id", F.least(F.col("id"), F.coalesce(F.col("mv"), F.col("id"))).alias("comp")))


def radius_clusters(vectors: DataFrame, id_col: str, vec_col: str, radius: float,
                     min_size: int = 5) -> DataFrame:
    """Clusters of one radius: vectors within squared L2 ``radius`` are
    linked; connected components with at least ``min_size`` members are
    clusters (labelled by their smallest id), the rest noise (-1)."""
    edges = radius_components_edges(vectors, radius, id_col=id_col, vec_col=vec_col)
    nodes = vectors.select(F.col(id_col).cast("long").alias("id"))
    comps = connected_components(nodes, edges)
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    return (comps.join(sizes, "comp")
            .select(F.col("id").alias(id_col),
                    F.when(F.col("size") >= min_size, F.col("comp")).otherwise(F.lit(-1)).alias("cluster")))


def cluster_count(labels: DataFrame, label_col: str = "cluster") -> DataFrame:
    """Sizes per label plus the number of distinct labels (noise included)."""
    sizes = labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("size"))
    n = labels.agg(F.count_distinct(F.coalesce(F.col(label_col).cast("string"), F.lit("\u0000")))).scalar()
    return sizes.withColumn("n_labels", n)


def project_2d(vectors: DataFrame, vec_col: str) -> DataFrame:
    """2-D projection by PCA; ``layout`` has the one that keeps neighbours."""
    v = vectors.withColumn("__v", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(v)
    out = model.transform(v).withColumn("__a", vector_to_array("__p"))
    return out.withColumn("x", F.col("__a")[0]).withColumn("y", F.col("__a")[1]).drop("__v", "__p", "__a")


def knowledge_tree(questions: DataFrame, id_col: str, text_col: str, vocab_size: int = 50,
                   k_max: int = 6, seed: int = 42, restarts: int = 10) -> DataFrame:
    """Questions -> TF-IDF over the top ``vocab_size`` terms -> K-means
    (k = min(k_max, n), best of ``restarts``) -> each cluster named by its
    top centroid term -> tree of topic -> distinct first keywords of its
    questions (``"No Data"`` when there are no questions)."""
    from docweave.operators import lexical as LX
    vocab = LX.top_terms(questions, text_col, vocab_size)
    w = LX.tfidf_weights(questions, id_col, text_col, vocab)
    feats = tfidf_vectors(w, id_col, vocab, ids=questions)
    n_q = questions.limit(1).count()
    if n_q == 0:
        return topic_tree(questions.select(F.lit(None).cast("string").alias("topic"),
                                           F.lit(None).cast("string").alias("sub")))
    assign, _ = kmeans_topics(feats, k_max, seed, restarts)
    names = cluster_names(w, id_col, assign.select(id_col, "cluster"))
    items = (assign.select(id_col, "cluster").join(names.select("cluster", "name"), "cluster", "left")
             .join(questions.select(id_col, text_col), id_col)
             .select(tx.keyword_head(F.coalesce(F.col("name"), F.lit("")), 3).alias("topic"),
                     tx.keyword_head(F.col(text_col), 1).alias("sub")))
    return topic_tree(items)

"""Lexical operators: overlap ranking, term statistics, fuzzy matching,
BLEU and ROUGE-L.

Everything that aggregates does so relationally (group by n-gram, term or
q-gram, with partial aggregation), so one long text is spread over many
tasks. ROUGE-L's LCS is the only per-row Python (bit-parallel, Arrow
batches)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.plans.ordering import dense_index
from docweave.session import reliable_checkpoint

_WS_SPLIT = rf"{tx.WS}+"


# -- sentence overlap ---------------------------------------------------------------

def sentence_overlap_topk(text: Column, question: Column, top_k: int = 5) -> Column:
    """Sentences of ``text`` scored by the number of distinct question words
    they contain; ordered by (overlap desc, sentence desc); the best
    ``top_k`` newline-joined. Evaluated inside the row."""
    qw = F.array_distinct(tx.tokens(question))
    scored = F.transform(tx.split_sentences(text), lambda s: F.struct(
        F.size(F.array_intersect(qw, F.array_distinct(tx.tokens(s)))).alias("o"), s.alias("s")))
    best = F.slice(F.sort_array(scored, asc=False), 1, top_k)
    return F.array_join(F.transform(best, lambda x: x["s"]), "\n")


# -- term statistics --------------------------------------------------------------------

def vocab_tokens(text: Column) -> Column:
    """Vectorizer tokens: lower-case word runs of 2+ chars, stop words out."""
    return F.filter(tx.tokens(text), lambda t: (F.length(t) >= 2) & ~t.isin(*tx.STOP_WORDS))


def top_terms(docs: DataFrame, text_col: str, n: int = 50) -> DataFrame:
    """The ``n`` most frequent vocabulary terms (ties by term); a global
    top-n (per-partition top-n, then merge)."""
    counts = (docs.select(F.explode(vocab_tokens(F.col(text_col))).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("tf")))
    top = counts.orderBy(F.col("tf").desc(), F.col("term")).limit(n)
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("tf").desc(), F.col("term"))))  # over n rows only


def tfidf_weights(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame) -> DataFrame:
    """Smooth idf ``ln((1+n)/(1+df)) + 1`` times raw counts, L2-normalised
    per document, over the given vocabulary: ``(id, term, weight)``."""
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    tf = (docs.select(id_col, F.explode(vocab_tokens(F.col(text_col))).alias("term"))
          .join(vocab.select("term"), "term", "left_semi")
          .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = (tf.join(df_, "term")
         .withColumn("w", F.col("tf") * (F.log((1 + n_docs) / (1 + F.col("df"))) + 1)))
    norms = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))
    return (w.join(norms, id_col)
            .select(id_col, "term", (F.col("w") / F.col("nrm")).alias("weight")))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, term, count)`` of topic tokens (partial aggregation)."""
    return (docs.select(id_col, F.explode(tx.topic_tokens(F.col(text_col))).alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("count")))


def dictionary_of(terms: DataFrame) -> DataFrame:
    """Distinct terms -> dense 0-based ids in term order (computed per range
    partition, no single-task window)."""
    return dense_index(terms.select("term").distinct(), "term", "term_id")


def term_dictionary(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct topic tokens (de-accented, 2 to 15 letters, no stop words) ->
    dense ids in term order."""
    return dictionary_of(docs.select(F.explode(tx.topic_tokens(F.col(text_col))).alias("term")))


def bag_of_words(counts: DataFrame, id_col: str, dictionary: DataFrame) -> DataFrame:
    """``(id, term_id, count)`` from ``term_counts`` and a dictionary."""
    return counts.join(dictionary, "term").select(id_col, "term_id", "count")


# -- fuzzy matching ------------------------------------------------------------------

def fuzzy_ratio(a: Column, b: Column) -> Column:
    """``1 - levenshtein / max(len)`` (1.0 for two empty strings)."""
    m = F.greatest(F.length(a), F.length(b))
    return F.when(m == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / m)


def fuzzy_best_match(left: DataFrame, right: DataFrame, *, l_id: str, l_text: str, r_id: str,
                     r_text: str, threshold: float = 0.8, q: int = 2,
                     exclude_self: bool = False) -> DataFrame:
    """Best right row for each left row by ``fuzzy_ratio`` (ties -> lowest
    right id), kept when the ratio reaches ``threshold``; ``matched`` false
    and nulls otherwise.

    Exact without all pairs: (1) strings are de-duplicated, so a hot group of
    copies is handled by counting; (2) a left string whose rows all have an
    identical right string is settled, as no other string has ratio 1; (3)
    for the rest, candidates are pairs of distinct strings sharing a prefix
    q-gram (prefix filtering guarantees every pair with ratio >= threshold is
    among them); (4) candidates are verified with Levenshtein in the JVM."""
    t = threshold
    # both inputs are read several times below: materialise the two narrow
    # projections once in the shared checkpoint folder (cuts lineage too)
    L = reliable_checkpoint(left.select(F.col(l_id).alias("lid"), F.col(l_text).alias("ls")))
    R = reliable_checkpoint(right.select(F.col(r_id).alias("rid"), F.col(r_text).alias("rs")))
    # distinct right strings with their two lowest ids
    rdist = R.groupBy("rs").agg(F.min("rid").alias("r1"))
    r2 = (R.join(rdist.select("rs", "r1"), "rs").filter(F.col("rid") != F.col("r1"))
          .groupBy("rs").agg(F.min("rid").alias("r2")))
    rdist = rdist.join(r2, "rs", "left")
    ldist = L.select("ls").distinct()
    # strings still to be searched for: those of left rows without an identical
    # right string (of another id, with exclude_self)
    same = L.join(rdist, L["ls"] == rdist["rs"], "left")
    alone = F.col("rs").isNull() | (F.lit(exclude_self) & (F.col("r1") == F.col("lid")) & F.col("r2").isNull())
    lopen = reliable_checkpoint(same.filter(alone & F.col("ls").isNotNull()).select("ls").distinct())

    # candidate pairs of distinct strings
    def prefixes(df, col):
        n = F.length(F.col(col))
        d = F.floor((1 - t) / t * n + 1e-9).cast("int")
        ng = F.greatest(n - q + 1, F.lit(0))
        grams = F.when(ng > 0, F.transform(F.sequence(F.lit(1), ng),
                                           lambda i: F.substring(F.col(col), i, q))) \
            .otherwise(F.array().cast("array<string>"))
        ex = df.select(col, d.alias("d"), F.posexplode(grams).alias("i", "g0"))
        occ = ex.withColumn("k", F.row_number().over(Window.partitionBy(col, "g0").orderBy("i")))
        return occ.select(col, "d", F.concat(F.col("g0"), F.lit("#"), F.col("k").cast("string")).alias("g"))

    lg = prefixes(lopen, "ls")
    rg = prefixes(rdist.select("rs"), "rs")
    freq = (lg.select("g").unionAll(rg.select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("f")))

    def cut(tagged, col):
        w = Window.partitionBy(col).orderBy("f", "g")
        return (tagged.join(freq, "g").withColumn("r", F.row_number().over(w))
                .filter(F.col("r") <= q * F.col("d") + 1).select(col, "g"))

    # strings too short for the gram-count guarantee are compared with every
    # right string in their admissible length band (equi-join on length)
    def weak(col):
        n = F.length(F.col(col))
        d = F.floor((1 - t) / t * n + 1e-9)
        return (n - q + 1 - q * d) < 1

    lw = lopen.filter(weak("ls")).select(
        "ls", F.explode(F.sequence(F.ceil(F.length("ls") * t - 1e-9).cast("int"),
                                   F.floor(F.length("ls") / t + 1e-9).cast("int"))).alias("len"))
    rl = rdist.select("rs", F.length("rs").alias("len"))
    # a match needs t * max(len) <= min(len): a cheap band check on each
    # candidate before de-duplication
    band = F.least(F.length("ls"), F.length("rs")) >= F.greatest(F.length("ls"), F.length("rs")) * t - 1e-9
    cand = (cut(lg, "ls").join(cut(rg, "rs"), "g").select("ls", "rs").filter(band)
            .unionByName(ldist.join(rdist.select("rs"), ldist["ls"] == rdist["rs"]).select("ls", "rs"))
            .unionByName(lw.join(rl, "len").select("ls", "rs"))
            .groupBy("ls", "rs").agg(F.count(F.lit(1)).alias("hits")))
    # the score refers to the aggregate output, so the optimizer cannot push
    # the (expensive) Levenshtein filter below the de-duplication
    scored = (cand.withColumn("ratio", F.when(F.col("hits") > 0, fuzzy_ratio(F.col("ls"), F.col("rs"))))
              .filter(F.col("ratio") >= t).drop("hits").join(rdist, "rs"))
    # per left row: identical strings may need the second-lowest id
    per_left = L.join(scored, "ls")
    per_left = per_left.withColumn(
        "cid", F.when(F.lit(exclude_self) & (F.col("r1") == F.col("lid")), F.col("r2"))
        .otherwise(F.col("r1"))).filter(F.col("cid").isNotNull())
    best = per_left.groupBy("lid").agg(
        F.min_by(F.struct("cid", "ratio"), F.struct((-F.col("ratio")).alias("nr"), F.col("cid"))).alias("b"))
    return (L.join(best, "lid", "left")
            .select(F.col("lid").alias(l_id), F.col("b.cid").alias("match_id"),
                    F.col("b.ratio").alias("ratio"), F.col("b.cid").isNotNull().alias("matched")))


# -- BLEU ----------------------------------------------------------------------------------

def _ngrams(df: DataFrame, key: str, text_col: str, side: str, max_n: int) -> DataFrame:
    toks = F.filter(F.split(F.col(text_col), _WS_SPLIT), lambda w: w != "")
    base = df.select(key, toks.alias("t"))
    out = None
    for n in range(1, max_n + 1):
        g = base.select(key, F.lit(n).alias("n"), F.explode(F.when(
            F.size("t") >= n, F.transform(F.sequence(F.lit(0), F.size("t") - n),
                                          lambda i: F.array_join(F.slice("t", i + 1, n), "\u0001"))
        ).otherwise(F.array().cast("array<string>"))).alias("g"))
        out = g if out is None else out.unionAll(g)
    return out.groupBy(key, "n", "g").agg(F.count(F.lit(1)).alias(side))


def bleu(pairs: DataFrame, key: str, ref_col: str, cand_col: str, max_n: int = 4) -> DataFrame:
    """Sentence BLEU per pair: uniform 1..4-gram clipped precision times the
    brevity penalty, whitespace tokens, no smoothing (a zero precision gives
    0.0); 0.0 when either text is empty.

    Each pair is scored inside its own row by an Arrow-batched UDF: no
    shuffle at all, where a relational n-gram count would shuffle about
    eight rows per token (``bleu_relational`` is kept as a cross-check)."""
    @F.pandas_udf("double")
    def _bleu(r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([bleu_reference(x or "", y or "", max_n) for x, y in zip(r, c)], dtype="float64")
    return pairs.select(key, _bleu(F.col(ref_col), F.col(cand_col)).alias("bleu"))


def bleu_relational(pairs: DataFrame, key: str, ref_col: str, cand_col: str, max_n: int = 4) -> DataFrame:
    """The same BLEU as joins and aggregates over (pair, n, gram) counts."""
    toks_r = F.size(F.filter(F.split(F.col(ref_col), _WS_SPLIT), lambda w: w != ""))
    toks_c = F.size(F.filter(F.split(F.col(cand_col), _WS_SPLIT), lambda w: w != ""))
    lens = pairs.select(key, toks_r.alias("r_len"), toks_c.alias("c_len"))
    c = _ngrams(pairs, key, cand_col, "cc", max_n)
    r = _ngrams(pairs, key, ref_col, "rc", max_n)
    clipped = (c.join(r, [key, "n", "g"], "left")
               .groupBy(key, "n").agg(F.sum(F.least("cc", F.coalesce("rc", F.lit(0)))).alias("m"),
                                      F.sum("cc").alias("tot")))
    logp = (clipped.groupBy(key).agg(
        F.sum(F.when(F.col("m") > 0, F.log(F.col("m") / F.col("tot")))).alias("slog"),
        F.count(F.when(F.col("m") > 0, 1)).alias("n_pos")))
    s = lens.join(logp, key, "left")
    bp = F.when(F.col("c_len") > F.col("r_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("r_len") / F.col("c_len")))
    score = F.when((F.col("r_len") == 0) | (F.col("c_len") == 0) | (F.coalesce("n_pos", F.lit(0)) < max_n),
                   F.lit(0.0)).otherwise(bp * F.exp(F.col("slog") / max_n))
    return s.select(key, score.alias("bleu"))


# -- ROUGE-L ------------------------------------------------------------------------------

def rouge_tokens(s: str, stem: bool = False) -> list[str]:
    """Lower-case ASCII alphanumeric tokens; optional light suffix stemmer."""
    import re
    toks = [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", (s or "").lower())) if t]
    if stem:
        toks = [_light_stem(t) if len(t) > 3 else t for t in toks]
    return toks


# Suffixes of the light stemmer, tried in this order.
STEM_SUFFIXES = ("ational", "ization", "fulness", "iveness", "ing", "edly", "ed", "ly", "es", "s")


def _light_stem(t: str) -> str:
    for suf in STEM_SUFFIXES:
        if t.endswith(suf) and len(t) - len(suf) >= 3:
            return t[: -len(suf)]
    return t


def lcs_length(a: list[str], b: list[str]) -> int:
    """LCS length, bit-parallel over ``a`` (one big-int step per token of
    ``b``)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for tok in b:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def rouge_l_f1(ref: str, cand: str, stem: bool = False) -> float:
    r, c = rouge_tokens(ref, stem), rouge_tokens(cand, stem)
    lcs = lcs_length(r, c)
    if lcs == 0:
        return 0.0
    p, rc = lcs / len(c), lcs / len(r)
    return 2 * p * rc / (p + rc)


def rouge_l(ref: Column, cand: Column, stem: bool = False) -> Column:
    """ROUGE-L F1 (LCS) as an Arrow-batched pandas UDF."""
    @F.pandas_udf("double")
    def _rl(r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([rouge_l_f1(x, y, stem) for x, y in zip(r, c)], dtype="float64")
    return _rl(ref, cand)


def bleu_reference(ref: str, cand: str, max_n: int = 4) -> float:
    """Pure-Python BLEU used by tests (same definition as ``bleu``)."""
    from collections import Counter
    r, c = ref.split(), cand.split()
    if not r or not c:
        return 0.0
    logs = 0.0
    for n in range(1, max_n + 1):
        cg = Counter(tuple(c[i:i + n]) for i in range(len(c) - n + 1))
        rg = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        m = sum(min(v, rg.get(k, 0)) for k, v in cg.items())
        tot = max(1, sum(cg.values()))
        if m == 0:
            return 0.0
        logs += math.log(m / tot) / max_n
    bp = 1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c))
    return bp * math.exp(logs)

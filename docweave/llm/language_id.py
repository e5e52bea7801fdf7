"""Language identification by Bayesian fusion of evidence.

For each record the posterior over languages multiplies

* the likelihood of its text under a model of character trigrams (hashed into
  ``FEATURES`` bins, fitted on at most ``SAMPLE`` labelled texts per language,
  those with the smallest id hashes; neighbouring trigrams overlap, so a third of
  the log-likelihood counts),
* the probability of its declared markup language given each language,
* the prior of its host, smoothed hierarchically: host counts towards the
  distribution of the address suffix, that towards the distribution of all.

Counts behind declarations and priors are sums of text posteriors over all
records, by grouped aggregation; a record's own share is taken out of its host
and suffix, so it never votes for itself. Joins are safe for hot hosts.

Defined cases: a record without text, declaration and host has the distribution
of all; null and empty evidence is left out; unknown declarations are as likely
under every language as their counts say; without labelled texts the result has
null languages; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.common import col, join_unique, text_buffers
from docweave.llm.shingles import slices
from docweave.session import reliable_checkpoint

FEATURES = 1 << 16
SAMPLE = 2000
MAX_LANGUAGES = 200
HOST_STRENGTH = 5.0
SUFFIX_STRENGTH = 20.0
_U32 = np.uint32


def page_evidence(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, text, declared, host, suffix`` of web pages."""
    html = F.coalesce(col(html_col).cast("string"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    host = F.lower(F.regexp_extract(F.coalesce(col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    empty = lambda c: F.nullif(c, F.lit(""))
    return pages.select(col(id_col).cast("long").alias("id"), text.alias("text"), empty(declared).alias("declared"),
                        empty(host).alias("host"), empty(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"))


def text_evidence(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source") -> DataFrame:
    """The same of plain texts, ``host_col`` naming where they come from."""
    null = F.lit(None).cast("string")
    return docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
                       null.alias("declared"), (col(host_col).cast("string") if host_col else null).alias("host"), null.alias("suffix"))


def _features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bins of concatenated texts and the text of each."""
    b = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(_U32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (b[:-2] | (b[1:-1] << _U32(8)) | (b[2:] << _U32(16))) * _U32(0x9E3779B1)
    at = np.arange(len(key))
    owner = np.searchsorted(ends, at, "right")
    own = at + 3 <= ends[owner]
    return (key >> _U32(16))[own].astype(np.int64), owner[own]


def fit_text_model(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of the trigram bins."""
    texts = labelled.select(F.xxhash64(col(id_col)).alias("h"), col(lang_col).cast("string").alias("lang"),
                            col(text_col).cast("string").alias("text")).filter("lang is not null and length(text) > 2")
    sizes = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    # about four times the sample by a bound on the hash, then its smallest:
    # no task ranks more than that
    low = -(1 << 63)
    bound = {x: low + min((1 << 64) - 1, ((4 * sample) << 64) // n) for x, n in sizes.items()}
    near = texts.filter(_hash_bounds(bound)).select("lang", "h") if bound else texts.select("lang", "h")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    last = {r["lang"]: r["h"] for r in ranked.filter(F.col("r") <= sample).groupBy("lang").agg(F.max("h").alias("h")).collect()} \
        if len(sizes) <= MAX_LANGUAGES else sizes
    if len(last) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(last)
    if not languages:
        return [], np.zeros((0, FEATURES), np.float32)
    place = {x: k for k, x in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), FEATURES), np.int64)
        for batch in batches:
            offsets, data = text_buffers(batch.column("text"))
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in slices(offsets):
                bins, owner = _features(data[offsets[a]:offsets[b]], offsets[a + 1:b + 1] - offsets[a])
                total += np.bincount(lang[a:b][owner] * FEATURES + bins, minlength=total.size).reshape(total.shape)
        which = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(total.ravel()[which])], names=["k", "n"])

    found = texts.filter(_hash_bounds(last)).select("lang", "text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full(len(languages) * FEATURES, 0.5)
    counts[found["k"].to_numpy(np.int64)] += found["n"].to_numpy(float)
    counts = counts.reshape(len(languages), FEATURES)
    return languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _hash_bounds(bound: dict[str, int]) -> Column:
    """Rows whose hash is at most the bound of their language."""
    return reduce(lambda a, b: a | b, ((F.col("lang") == F.lit(x)) & (F.col("h") <= F.lit(h)) for x, h in bound.items()))


def _likelihoods(sent):
    def run(batches):
        table = sent.value
        for batch in batches:
            offsets, data = text_buffers(batch.column("text"))
            out = np.zeros((batch.num_rows, len(table)))
            for a, b in slices(offsets):
                bins, owner = _features(data[offsets[a]:offsets[b]], offsets[a + 1:b + 1] - offsets[a])
                for k in range(len(table)):
                    out[a:b, k] = np.bincount(owner, table[k][bins], minlength=b - a)
            logs = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel() / 3.0), len(table)).cast(pa.list_(pa.float64()))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [logs], names=names + ["logs"])
    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def identify(evidence: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``(all columns of evidence but the text, lang, confidence, text_lang)``."""
    languages, table = model
    kept = [c for c in evidence.columns if c != "text"]
    if not languages:
        return evidence.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"))])
    sent = evidence.sparkSession.sparkContext.broadcast(table)
    types = dict(evidence.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", logs array<double>"
    scored = evidence.select(*kept, F.col("text")).mapInArrow(_likelihoods(sent), schema)
    scored = reliable_checkpoint(scored.withColumn("text_post", _softmax(F.col("logs"))))

    size = range(len(languages))
    sums = [F.sum(F.col("text_post")[k]).alias(f"s{k}") for k in size]
    vector = F.array(*[F.col(f"s{k}") for k in size])

    def counted(key: str) -> DataFrame:
        return (scored.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"{key}_n"), *sums)
                .select(key, f"{key}_n", vector.alias(f"{key}_sums")))

    total = scored.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    overall = [(total[f"s{k}"] + 0.5 if total["n"] else 1.0) / ((total["n"] or 0) + 0.5 * len(languages)) for k in size]
    declared = counted("declared")
    kinds = declared.count()
    joined = scored
    for key, table_ in (("host", counted("host")), ("suffix", counted("suffix")), ("declared", declared)):
        joined = join_unique(joined, table_, key, f"{key}_n")

    def smoothed(key: str, parent, strength: float, k: int) -> Column:
        own = F.col("text_post")[k]
        return ((F.coalesce(F.col(f"{key}_sums")[k] - own, F.lit(0.0)) + strength * parent)
                / (F.coalesce(F.col(f"{key}_n") - 1, F.lit(0)) + strength))

    def posterior(k: int) -> Column:
        by_suffix = smoothed("suffix", F.lit(overall[k]), SUFFIX_STRENGTH, k)
        by_host = smoothed("host", by_suffix, HOST_STRENGTH, k)
        said = (F.col("declared_sums")[k] + 0.5) / F.lit((total[f"s{k}"] or 0.0) + 0.5 * max(1, kinds))
        return F.log(F.greatest(by_host, F.lit(1e-12))) + F.coalesce(F.log(said), F.lit(0.0)) + F.col("logs")[k]

    fused = joined.withColumn("post", _softmax(F.array(*[posterior(k) for k in size])))
    names = F.array(*[F.lit(x) for x in languages])

    def best(c: str) -> Column:
        return names[(F.array_position(F.col(c), F.array_max(c)) - 1).cast("int")]

    said_nothing = F.aggregate("logs", F.lit(0.0), lambda a, x: a + x) == 0
    return fused.select(*kept, best("post").alias("lang"), F.array_max("post").alias("confidence"),
                        F.when(~said_nothing, best("text_post")).alias("text_lang"))

"""Thresholds of the quality model come from texts that it wasn't trained on."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
import llm_brute as B
from docweave.llm import quality_lm as ql
from docweave.session import table

ORDER, SHRINK = ql.ORDER, ql.SHRINK


def _logs(texts, model_of):
    return [sum(math.log(model_of(lang)(g)) for g in B.char_grams(t, ORDER)) for t, lang in texts]


def _model_of(trusted):
    """``f(lang) -> p`` of the models of ``(text, lang)``."""
    made, langs = {}, {lang for _, lang in trusted}

    def get(lang):
        key = (lang,) if lang in langs else None
        if key not in made:
            made[key] = B.kneser_ney([g for t, x in trusted if key is None or x == lang for g in B.char_grams(t, ORDER)], ORDER)
        return made[key]

    return get


def held_out_quality(docs, trusted_ids, folds):
    """``{id: (perplexity, threshold)}`` for docs ``(id, text, lang)``; ``folds``
    gives the fold of a text."""
    taught = [(t, lang) for i, t, lang in docs if i in trusted_ids and t]
    logs = []
    for fold in set(folds.values()):
        model = _model_of([x for x in taught if folds[x[0]] != fold])
        mine = [x for x in taught if folds[x[0]] == fold]
        logs += [(lang, len(t), log) for (t, lang), log in zip(mine, _logs(mine, model))]
    mean, limit = {}, {}
    for key in {x[0] for x in logs}:
        mine = [x for x in logs if x[0] == key]
        mean[key] = -sum(x[2] for x in mine) / sum(x[1] for x in mine)
        bins = sorted(math.ceil((mean[key] * SHRINK - log) / (n + SHRINK) * 1000) for _, n, log in mine)
        limit[key] = math.exp(bins[max(0, math.ceil(ql.QUANTILE * len(bins)) - 1)] / 1000) * ql.MARGIN
    logs = _logs([(t, lang) for _, t, lang in docs], _model_of(taught))
    return {i: (math.exp((mean[lang] * SHRINK - log) / (len(t) + SHRINK)), limit[lang]) for (i, t, lang), log in zip(docs, logs) if t}


def test_clean_documents_outside_the_labels_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = ql.drop_low_quality(docs, labels.filter("doc_id % 2 = 0")).select("doc_id")
    clean = labels.filter("doc_id % 2 = 1 and quality = 1 and toxic = 0").join(docs.filter("length(text) > 0"), "doc_id")
    poor = labels.filter("quality = 0").join(docs, "doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    assert poor.join(kept, "doc_id", "left_anti").count() >= 0.8 * poor.count()


def test_pipeline_stage_against_plain_version(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    folds = {r[0]: r[1] for r in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(ql.FOLDS))).collect()}
    trusted = {r["doc_id"] for r in table(spark, sf, "labels").filter("quality = 1").collect()}
    want = held_out_quality(rows, trusted, folds)
    model = ql.QualityModel(docs, table(spark, sf, "labels"), folds=ql.FOLDS)
    for r in model.classify(docs).select("row.doc_id", "perplexity", "threshold").collect():
        if r["doc_id"] in want:
            assert r["perplexity"] == pytest.approx(want[r["doc_id"]][0], rel=1e-4)
            assert r["threshold"] == pytest.approx(want[r["doc_id"]][1], rel=2e-3)
    kept = {r["doc_id"] for r in CP.quality(spark, docs, sf).select("doc_id").collect()}
    assert kept == {i for i, (p, limit) in want.items() if p <= limit}


def test_nothing_to_hold_out(spark):
    """All trusted text in one fold, in none, and a language in one fold only."""
    docs = spark.createDataFrame([(1, "a clean text", "en"), (2, "another one", "en"), (3, "ein Text", "de"), (4, None, "en")],
                                 "doc_id long, text string, lang string")
    for ids in ([1], [], [1, 2], [1, 2, 3], [4]):
        labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
        kept = {r["doc_id"] for r in ql.drop_low_quality(docs, labels).collect()}
        assert set(ids) - {4} <= kept and (ids not in ([], [4]) or kept == {1, 2, 3})

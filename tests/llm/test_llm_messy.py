"""Every operator on a table with nulls in each column, empty and very long
texts, ties, repeated rows and columns named like working columns, against the
plain versions; then on an empty table."""

import random

import pytest
from pyspark.sql import functions as F

import llm_brute as B
from docweave.llm import debruijn, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, suffix_dedup, warc
from docweave.llm import quality_lm as ql
from docweave.llm import sentencepiece_codec as sp
from docweave.llm.registry import TOKENIZER

SCHEMA = ("doc_id long, text string, lang string, source string, row string, hit string, id long, score double, kept string, "
          "block long, ids string, part int, sha string, head string, bucket int, `a.b` string")


def _rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)] + ["Über", "été", "naïve", "日本", "End."]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, notice = say(60), "Licensed under CC BY-NC 4.0."
    texts = [None, "", "   \n\t ", "one", "two words", "Two  Words", say(20_000)]
    base = say(120)
    near = [base.replace("w7", "x7", 1), base.replace("w9", "x9", 1), base + " tail", base.replace("w3", "x3"), base.upper()]
    texts += [base, base, *near, passage, say(30) + " " + passage + "\n" + say(25), passage + " " + passage, say(10) + "\n" + notice + "\n" + say(3),
              notice, "licensed under\ncc by nc 4.0\n\nother", "a\u0085b c \x00 d", "🙂🙂 " + say(8), "x" * 3000]
    rows = [(k if k % 11 else None, t, [None, "en", "de", "zz"][k % 4], None if k % 5 == 0 else f"s{k % 2}") for k, t in enumerate(texts)]
    rows += [rows[8], rows[8], (8, "another text under the same id", "en", "s1"), (None, base, None, None), (-5, passage, "en", "s0")]
    return [(*r, "row", None, -1, 0.5, "k", 7, "i", 3, None, "h", 1, "dot") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def _pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def items(spark, rows):
    passage = next(r[1] for r in rows if r[0] == -5)
    return [(1, passage), (2, "two words"), (3, None), (4, ""), (5, " ".join(passage.split()[20:50])), (5, "one"), (None, "other text under")]


def test_decontamination(spark, docs, rows, items, empty):
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 200):  # one automaton, and several blocks of items
        found = decontaminate.find_contamination(docs, bench, block_bytes=block_bytes)
        got = found.select("row.doc_id", "hit.n_words", "hit.n_hit", F.size("hit.items"),
                           F.sha2(F.array_join(F.array_sort("hit.items"), ",").cast("binary"), 256), decontaminate.contaminated())
        assert _sorted(got.collect()) == _sorted(B.contamination(_pairs(rows), items))
    for r in found.select("row.text", "hit.spans", "hit.n_hit").collect():  # spans point into the original text
        words = sum(len(decontaminate.words_of(r["text"][s["start"]:s["end"]].encode())) for s in r["spans"])
        assert words == r["n_hit"]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    clean = [i for i, *_, bad in B.contamination(_pairs(rows), items) if not bad]
    assert sorted(map(repr, clean)) == sorted(repr(r["doc_id"]) for r in kept.collect())
    assert decontaminate.drop_contaminated(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_repeated_spans(docs, rows, empty, unit):
    run = debruijn.remove_repeated_words if unit == "words" else suffix_dedup.remove_earlier_substrings
    window, n = (35, "n_words") if unit == "words" else (50, "n_bytes")
    for size in (2 << 20, 700):  # one block, and many
        got = run(docs, block_bytes=size).select("row.doc_id", n, "n_removed", F.size("spans"), F.sha2(F.col("kept").cast("binary"), 256))
        want = B.repeats(_pairs(rows), unit, window, unit == "bytes")
        assert _sorted(got.collect()) == _sorted(want)
    assert run(empty).count() == 0


def test_jaccard(docs, rows, empty):
    for words, percent in ((3, 90), (5, 80)):
        got = jaccard_join.jaccard_components(docs, words=words, percent=percent)
        assert _sorted(got.collect()) == _sorted(B.jaccard(_pairs(rows), words, percent))
    kept = jaccard_join.keep_one_per_component(docs, words=5, percent=80)
    assert kept.columns == docs.columns
    want = [i for i, _, c in B.jaccard(_pairs(rows), 5, 80) if c is None or c == i]
    assert sorted(map(repr, want)) == sorted(repr(r["doc_id"]) for r in kept.collect())
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_exact(docs, rows, empty):
    for keep, best in (("max", max), ("min", min)):
        got = exact_dedup.exact_dedup(docs, keep=keep)
        assert _sorted(got.collect()) == _sorted(B.exact(_pairs(rows), best))
        kept = exact_dedup.drop_exact_copies(docs, keep=keep)
        assert kept.columns == docs.columns
        assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r[0]) for r in B.exact(_pairs(rows), best) if r[3])
    folded = exact_dedup.exact_dedup(docs, normalise=F.lower)
    assert {r["group_size"] for r in folded.collect()} > {1}
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_exact_hot_text(spark):
    """A text that fills most partitions is cut at splitters and still one group."""
    rows = [(i, "hot" if i % 3 else f"t{i % 50}") for i in range(6000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert _sorted(got.collect()) == _sorted(B.exact(rows))
    kept = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.count() == len({t for _, t in rows})


def test_warc(spark, docs, rows, empty, tmp_path):
    import base64
    import hashlib

    for minimum in (0, 10):
        path = str(tmp_path / f"w{minimum}")
        records = warc.with_payload(docs, "doc_id", "text", "source")
        warc.write_archive(warc.resolve_revisits(records, minimum), path)
        got = warc.read_archive(spark, path).select("id", "url", "bytes", "digest", "type", "refers_to").collect()
        want, first = [], {}
        for i, t, *_ in rows:
            t = t or ""
            first.setdefault(t, []).append(i)
        for i, t, _, url, *_ in rows:
            b = (t or "").encode()
            known = [x for x in first[t or ""] if x is not None]
            original = min(known) if known and len(b) >= minimum and len(first[t or ""]) > 1 else i
            revisit = original != i
            want.append((i, url, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response",
                         original if revisit else None))
        assert _sorted(got) == _sorted(want)
    warc.write_archive(warc.resolve_revisits(warc.with_payload(empty, "doc_id", "text")), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_warc_damage_is_an_error():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_records(good * 2)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse_records(good[:-2]))


def test_sentencepiece(docs, rows, empty):
    data = sp.load_model_bytes(TOKENIZER)
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    got = sp.encode_decode(docs, data).select("row.text", "ids", "exact").collect()
    assert len(got) == len(rows)
    for text, ids, exact in got:
        assert (ids is None and exact is None) if text is None else (ids == lib.encode(text) and exact == (lib.decode(ids) == text))
    coded = sp.encode(docs, data)
    assert _sorted(coded.select("row.doc_id", "ids").collect()) == _sorted(sp.encode_decode(docs, data).select("row.doc_id", "ids").collect())
    back = sp.decode(coded.select(F.col("row.text").alias("text"), "ids"), data).collect()
    assert all(r["decoded"] == r["text"] for r in back if r["text"] is None or sp.MARK not in r["text"])
    assert sp.encode(empty, data).count() == 0


def test_quality(spark, docs, rows, empty):
    labels = [(1, 1, 0), (2, 1, 0), (5, 1, 0), (8, 1, 0), (8, 1, 0), (9, 0, 0), (None, 1, 1), (13, 1, None), (14, 1, 0), (17, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = {i for i, q, _ in labels if q == 1 and i is not None}
    model = ql.QualityModel(docs, table)
    got = model.classify(docs).select("row.doc_id", "row.text", "row.lang", "perplexity", "threshold", "rejected").collect()
    brute = B.quality([r[:3] for r in rows], trusted)
    want = sorted(((r[0], r[1], r[2], *brute[n]) for n, r in enumerate(rows)), key=lambda r: repr(r[:3]))
    for g, w in zip(sorted(got, key=lambda r: repr(tuple(r)[:3])), want):
        assert (g["perplexity"] is None) == (w[3] is None) and g["threshold"] == pytest.approx(w[4], rel=2e-3)
        if w[3] is None:
            assert g["rejected"]
        else:
            assert g["perplexity"] == pytest.approx(w[3], rel=1e-4)
    kept = ql.drop_low_quality(docs, table)
    assert kept.columns == docs.columns
    assert ql.drop_low_quality(empty, table).count() == 0
    untaught = ql.QualityModel(docs, table.limit(0)).classify(docs)
    assert untaught.filter("not rejected").count() == sum(bool(r[1]) for r in rows)


def test_quality_shards(spark, docs, monkeypatch):
    """Several lookup shards give the sums of one."""
    labels = spark.createDataFrame([(k, 1) for k in range(3, 20)], "doc_id long, quality int")
    one = ql.QualityModel(docs, labels).classify(docs).select("row.doc_id", "row.text", F.round("perplexity", 5)).collect()
    monkeypatch.setattr(ql, "SHARD", 200)
    model = ql.QualityModel(docs, labels)
    assert model.shards > 1
    assert _sorted(model.classify(docs).select("row.doc_id", "row.text", F.round("perplexity", 5)).collect()) == _sorted(one)


def test_licenses(docs, rows, empty):
    got = license_scan.scan_licenses(docs).select("id", "kind", "unit_no", "license", F.round("dice", 6))
    want = B.licenses(_pairs(rows), license_scan.TEMPLATES)
    assert want and _sorted(got.collect()) == _sorted(want)
    assert license_scan.scan_licenses(empty).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Join", "Pandas"))


def test_language(spark, docs, rows, empty):
    model = language_id.fit_text_model(docs)
    found = language_id.identify(language_id.text_evidence(docs), model)
    assert found.count() == len(rows)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    assert language_id.identify(language_id.page_evidence(pages), model).count() == len(rows)
    assert language_id.identify(language_id.text_evidence(empty), model).count() == 0
    none = language_id.identify(language_id.text_evidence(docs), language_id.fit_text_model(empty))
    assert none.filter("lang is not null").count() == 0 and none.count() == len(rows)

"""The pipeline, stage by stage against the plain versions, each on what the
stage before it kept; and the models that SQL can't express."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as CP
import llm_brute as B
from docweave.llm import language_id
from docweave.llm import quality_lm as ql
from docweave.llm import sentencepiece_codec as sp
from docweave.llm.registry import TOKENIZER
from docweave.session import table
from test_llm_held_out import held_out_quality


def test_pipeline_against_plain_versions(spark, sf):
    read = table(spark, sf, "documents")
    rows = [tuple(r) for r in read.select("doc_id", "text", "lang").collect()]
    folds = {r[0]: r[1] for r in read.select("text", F.pmod(F.xxhash64("text"), F.lit(ql.FOLDS))).collect()}
    trusted = {r["doc_id"] for r in table(spark, sf, "labels").filter("quality = 1").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    scores = held_out_quality(rows, trusted, folds)
    docs = [(i, t) for i, t, _ in rows if i in scores and scores[i][0] <= scores[i][1]]
    docs = [(i, t) for i, t in docs if i == max(j for j, u in docs if u == t)]
    smallest = {i: c for i, _, c in B.jaccard(docs, 5, 80)}
    docs = [(i, t) for i, t in docs if smallest[i] == i]
    bad = {i for i, *_, hit in B.contamination(docs, items) if hit}
    lib = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    want = {i: lib.encode(t) for i, t in docs if i not in bad}
    got = {r["doc_id"]: r["ids"] for r in CP.run(spark, sf).collect()}
    assert len(CP.STAGES) == 5 and 0 < len(want) < len(rows)
    assert got == want


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(40).withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")))
    for _, stage in CP.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
    encode = CP.STAGES[-1][1]
    ids = {r["doc_id"]: r["ids"] for r in encode(spark, docs, sf).collect()}
    assert ids == {r["doc_id"]: None if r["text"] is None else sentencepiece.SentencePieceProcessor(model_file=TOKENIZER).encode(r["text"])
                   for r in docs.collect()}
    assert encode(spark, docs.limit(0), sf).count() == 0


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        import struct
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_model_parity(squeeze):
    """A unigram model written by hand (pieces, scores, byte fallback)."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["▁", "▁the", "the", "▁t", "he", "t", "h", "e", "▁cat", "c", "a", "at", "s", "▁▁", "é", "▁a"]
    pieces += [(w, -1.5 - 0.37 * k, 1) for k, w in enumerate(words)]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    data += _field(2, _field(3, 1) + _field(35, 1) + _field(40, 0) + _field(41, 1) + _field(42, 2))
    data += _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, int(squeeze)) + _field(5, 1))
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), sp.Codec(data)
    assert own.model.model_type == sp.UNIGRAM and own.model.byte_fallback and own.model.remove_extra_whitespaces == squeeze
    for text in ["", "the cat sat", "  the  the cat ", "été 日本 the", "hhhtt", "a the\ncats"]:
        ids = own.encode([text])[0].tolist()
        assert ids == lib.encode(text), text
        assert own.decode([ids])[0] == lib.decode(ids), text


def test_bpe_parity_on_all_documents(spark):
    data = sp.load_model_bytes(TOKENIZER)
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), sp.Codec(data)
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    assert [x.tolist() for x in own.encode(texts)] == lib.encode(texts)
    hard = ["a  b   c ", "\t\n x", "<s> </s> <0x41>", "🙂🙂", "a\u0000b", " lead", "trail ", "▁mark"]
    assert [x.tolist() for x in own.encode(hard)] == lib.encode(hard)
    assert own.decode(lib.encode(hard)) == [lib.decode(x) for x in lib.encode(hard)]


def test_language_of_held_out_texts(spark):
    """Fitted on a few texts per language, right on the others; pages agree
    with their markup, and evidence decides where the text is silent."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = language_id.fit_text_model(docs.filter("doc_id % 10 = 0"))
    found = language_id.identify(language_id.text_evidence(docs), model)
    both = found.join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("truth")), "id").filter("id % 10 <> 0")
    n, right = both.agg(F.count("*"), F.sum((F.col("lang") == F.col("truth")).cast("long"))).first()
    assert right >= 0.97 * n
    pages = language_id.page_evidence(table(spark, sf, "pages"))
    silent = pages.filter("declared = 'de'").limit(1).selectExpr("-1L as id", "'' as text", "declared", "host", "suffix")
    on_pages = language_id.identify(pages.union(silent), model)
    n, right = on_pages.filter("id >= 0").agg(F.count("*"), F.sum((F.col("lang") == F.col("declared")).cast("long"))).first()
    assert right >= 0.97 * n
    assert on_pages.filter("id = -1").first()["lang"] == "de"

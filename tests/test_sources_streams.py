"""File sources on a temporary folder, and stream = batch checks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from docweave.sources import files as SRC


def test_scan_pages_extensions(spark):
    d = tempfile.mkdtemp(prefix="docweave-pages-")
    os.makedirs(os.path.join(d, "sub"))
    for name in ["a.htm", "sub/b.htm", "c.html", "D.HTM", "e.txt"]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(b"<p>x</p>" if name != "c.html" else b"\xff\xfe bad utf8")
    got = sorted(r.page_name for r in SRC.scan_pages(spark, d, ("htm",)).collect())
    assert got == ["a.htm", "b.htm"]
    got = sorted(r.page_name for r in SRC.scan_pages(spark, d, ("htm", "html"), case_insensitive=True).collect())
    assert got == ["D.HTM", "a.htm", "b.htm", "c.html"]
    from docweave.operators.pages import decode_quarantine
    st = {r.page_name: r.status for r in decode_quarantine(SRC.scan_pages(spark, d, ("html",))).collect()}
    assert st == {"c.html": "quarantined"}


def test_chat_session_files(spark):
    d = tempfile.mkdtemp(prefix="docweave-chats-")
    msgs = [{"role": "user", "content": "héllo", "timestamp": "2025-03-07T16:50:51Z"},
            {"role": "assistant", "content": "hi", "timestamp": "2025-03-07T16:50:52Z"}]
    with open(os.path.join(d, "chat_session_1.json"), "w", encoding="utf-8") as f:
        json.dump(msgs, f, ensure_ascii=False)
    with open(os.path.join(d, "broken.json"), "w") as f:
        f.write("[{not json")
    rows = SRC.scan_chat_sessions(spark, d).collect()
    ok = sorted((r.session_id, r.turn, r.content) for r in rows if r.status == "ok")
    assert ok == [("chat_session_1", 0, "héllo"), ("chat_session_1", 1, "hi")]
    assert [r.session_id for r in rows if r.status == "corrupt"] == ["broken"]


def test_tolerant_readers(spark):
    assert SRC.scan_session_names(spark, "/nonexistent/names.json").count() == 0
    df = spark.createDataFrame([('{"k": 1}',), ("{bad",), ('{"k": "x"}',)], "p string")
    out = [(r["__p"].k, r.corrupt) for r in SRC.parse_json_tolerant(df, "p", "k int").collect()]
    assert out == [(1, False), (None, True), (None, False)]
    bad = spark.createDataFrame([("q", "r")], "Question string, Response string")
    assert SRC.check_answer_log(bad).columns == ["Question", "Model Name", "Response"]
    assert SRC.check_answer_log(bad).count() == 0


def test_streams_equal_batch(spark, sf):
    from docweave.registry import streams as RS, retrieval as RR
    s = {tuple(r) for r in RS.q_stream_retrieve(spark, sf).collect()}
    e = RR._emb(spark, sf)
    from docweave.operators import retrieve as R
    cents = R.document_vector(e, "label", "embedding").select(F.col("label").cast("long").alias("c"), "doc_vec")
    b = R.knn_l2(e, cents, 3, q_id="vec_id", q_vec="embedding", b_id="c", b_vec="doc_vec")
    b = {tuple(r) for r in b.select("q_id", "b_id", "rank", F.round("dist", 6)).collect()}
    assert s == b
    log = RS.q_stream_append_log(spark, sf)
    assert log.count() == log.select("event_id").distinct().count() == spark.read.parquet(
        f"{sf}/events.parquet").count()


def test_corpus_refresh_incremental_equals_full(spark, sf):
    from docweave.registry import streams as RS
    from docweave.streaming.pipelines import page_chunk_vectors
    from docweave.sources.files import content_hash
    inc = {r.content_hash for r in RS.q_stream_corpus_refresh(spark, sf).collect()}
    full = page_chunk_vectors(spark.read.parquet(f"{sf}/pages.parquet"))
    full = {r.h for r in full.select(content_hash(F.col("chunk").cast("string")).alias("h")).distinct().collect()}
    assert inc == full


def test_scan_text_lines_keeps_file_order(spark):
    d = tempfile.mkdtemp(prefix="docweave-lines-")
    with open(os.path.join(d, "q.txt"), "w", encoding="utf-8") as f:
        f.write("first question\n\n   \nsecond question \nthird\n")
    rows = SRC.scan_text_lines(spark, d).orderBy("line_key").collect()
    assert [r.line for r in rows] == ["first question", "second question", "third"]


def test_stream_retrieve_replay_is_idempotent(spark, sf):
    from docweave.operators import retrieve as R
    from docweave.session import scratch_dir
    from docweave.streaming import pipelines as S
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    cents = R.document_vector(e, "label", "embedding").select(F.col("label").cast("long").alias("c"), "doc_vec")
    src = scratch_dir(spark, "replay_in")
    e.select("vec_id", "embedding").repartition(3).write.parquet(src)
    out = scratch_dir(spark, "replay_out")
    for attempt in range(2):  # a lost checkpoint replays every batch into the same sink
        S.stream_retrieve(spark, src, "vec_id long, embedding array<float>", cents, out,
                          out + f"_ckpt{attempt}", 2, q_id="vec_id", q_vec="embedding", b_id="c", b_vec="doc_vec")
    got = spark.read.parquet(out)
    assert got.count() == 2 * e.count()
    assert got.select("q_id", "rank").distinct().count() == got.count()

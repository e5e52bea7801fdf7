"""Work of the tasks of a corpus refresh."""

from docweave.registry import streams as RS
from docweave.sources import sinks as SNK


def test_each_batch_has_files_for_all_cores(spark, sf, monkeypatch):
    parts = []
    plain = RS.S.page_chunks
    monkeypatch.setattr(RS.S, "page_chunks", lambda batch, *a: parts.append(batch.rdd.getNumPartitions()) or plain(batch, *a))
    assert RS.q_stream_corpus_refresh(spark, sf).count() > 0
    assert len(parts) == 3 and min(parts) >= spark.sparkContext.defaultParallelism


def test_only_new_content_is_embedded(spark, tmp_path):
    path, seen = str(tmp_path / "store"), []

    def embed(df):
        seen.append(df.count())
        return df.selectExpr("*", "array(length(text)) as embedding")

    one = spark.createDataFrame([(3, "a"), (1, "a"), (2, "bb")], "id long, text string")
    SNK.vector_store_write(spark, one, path, "text", "id", embed=embed)
    SNK.vector_store_write(spark, one.union(spark.createDataFrame([(9, "ccc")], one.schema)), path, "text", "id", embed=embed)
    assert seen == [2, 1]
    assert {(r["id"], r["text"], r["embedding"][0]) for r in spark.read.parquet(path).collect()} == {(1, "a", 1), (2, "bb", 2), (9, "ccc", 3)}

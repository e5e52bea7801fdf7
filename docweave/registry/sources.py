"""Registered queries: sources and sinks (§2.1, §2.2). Sinks write to a
fresh folder under the shared checkpoint folder and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import pages as P
from docweave.registry.chat import messages
from docweave.registry.lexical import qa_pairs
from docweave.sources import files as SRC
from docweave.sources import sinks as SNK
from docweave.session import scratch_dir, table

MODEL_NAME = "default"


def q_scan_pages(spark, sf):
    """The pages table written as a folder tree of text files (one folder per
    page), then scanned recursively as binary files with an extension glob
    and decoded in one pass."""
    folder = scratch_dir(spark, "page_files")
    SNK.write_page_files(table(spark, sf, "pages").select("page_id", "html"), "page_id", folder)
    scanned = P.decode_quarantine(SRC.scan_pages(spark, folder, ("txt",)))
    return scanned.select(
        F.regexp_extract("path", r"page_id=(\d+)/", 1).cast("long").alias("page_id"),
        F.col("length").alias("n_bytes"), "status",
        F.length(F.regexp_replace("text", "\n$", "")).alias("n_chars"))


def q_scan_text_lines(spark, sf):
    return SRC.text_lines(table(spark, sf, "documents"), "text", ["doc_id"])


def q_scan_chat_sessions(spark, sf):
    path = scratch_dir(spark, "sessions")
    m = messages(spark, sf).withColumn("timestamp", F.lit(None).cast("timestamp"))
    SNK.write_sessions(m, path)
    back = SRC.parse_sessions(spark.read.parquet(path), "session_id", "json")
    return back.select("session_id", "turn", "role", "content", "status")


def q_scan_session_names(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props")
    return SRC.parse_session_names(ev, "props", ["event_id"])


def q_scan_json_tolerant(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props")
    return SRC.parse_json_tolerant(ev, "props", "k int").select(
        "event_id", F.col("__p.k").alias("k"), "corrupt")


def _answer_log(spark, sf):
    return qa_pairs(spark, sf).select(F.col("question").alias("Question"),
                                      F.lit(MODEL_NAME).alias("Model Name"),
                                      F.col("answer").alias("Response"))


def q_scan_answer_log(spark, sf):
    path = scratch_dir(spark, "answer_log")
    _answer_log(spark, sf).write.option("header", "true").option("escape", '"').csv(path)
    return SRC.scan_answer_log(spark, path, "csv")


def q_vector_store(spark, sf):
    path = scratch_dir(spark, "vectors")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    for _ in range(2):  # the second write finds every content stored
        SNK.vector_store_write(spark, e, path, "embedding", "vec_id")
    return SNK.vector_store_read(spark, path).select("vec_id", "label")


def q_sink_processed_corpus(spark, sf):
    path = scratch_dir(spark, "corpus")
    docs = table(spark, sf, "documents").select("doc_id", tx.normalize_whitespace(F.col("text")).alias("text"))
    SNK.write_processed_corpus(docs, path)
    return spark.read.parquet(path).select("doc_id", F.length("text").alias("n_chars"))


def q_sink_answer_log(spark, sf):
    path = scratch_dir(spark, "answers")
    rows = qa_pairs(spark, sf).select("question", F.lit(MODEL_NAME).alias("model"),
                                      F.col("answer").alias("response"))
    SNK.append_answer_log(rows, path)
    SNK.append_answer_log(rows, path)
    return spark.read.parquet(path)


def q_sink_sessions(spark, sf):
    path = scratch_dir(spark, "sessions_out")
    m = messages(spark, sf).withColumn("timestamp", F.lit(None).cast("timestamp"))
    SNK.write_sessions(m, path)
    return spark.read.parquet(path).select(
        "session_id", F.size(F.from_json("json", SRC.MESSAGE_SCHEMA)).alias("n_messages"))


def _feedback_input(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_type").alias("model"),
                     F.concat(F.lit("question "), F.col("event_id").cast("string")).alias("question"),
                     F.col("props").alias("response"),
                     F.when(F.col("value") > 25, F.concat(F.lit("comment "), F.col("event_id").cast("string")))
                     .alias("comment"),
                     F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(F.lit("")).alias("details"),
                     F.col("value").cast("int").alias("rating"))


def q_sink_feedback(spark, sf):
    path = scratch_dir(spark, "feedback")
    SNK.feedback_records(_feedback_input(spark, sf)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def q_sink_response_time(spark, sf):
    path = scratch_dir(spark, "response_times")
    ev = table(spark, sf, "events").select(
        F.col("event_id").alias("question_number"), F.col("event_type").alias("question"),
        F.get_json_object("props", "$.k").alias("response_time"),
        F.col("ts").cast("string").alias("timestamp"))
    valid, rejected = SNK.response_time_records(ev)
    valid.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def q_sink_eval_snapshot(spark, sf):
    from docweave.registry.lexical import q_fuzzy_best_match
    path = scratch_dir(spark, "eval_snapshot")
    ev = q_fuzzy_best_match(spark, sf).filter(F.col("matched"))
    SNK.write_eval_snapshot(ev, path, ["matched"])
    return spark.read.parquet(path)


QUERIES = {
    "scan_pages": q_scan_pages,
    "scan_text_lines": q_scan_text_lines,
    "scan_chat_sessions": q_scan_chat_sessions,
    "scan_session_names": q_scan_session_names,
    "scan_json_tolerant": q_scan_json_tolerant,
    "scan_answer_log": q_scan_answer_log,
    "vector_store": q_vector_store,
    "sink_processed_corpus": q_sink_processed_corpus,
    "sink_answer_log": q_sink_answer_log,
    "sink_sessions": q_sink_sessions,
    "sink_feedback": q_sink_feedback,
    "sink_response_time": q_sink_response_time,
    "sink_eval_snapshot": q_sink_eval_snapshot,
}

_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_WS = tx.WS
_MSG = """messages AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text AS content
                      FROM conversations)"""
_QA = f"""{_MSG},
  qa AS (SELECT u.session_id, u.turn, u.content AS question, a.content AS answer
         FROM messages u JOIN messages a ON a.session_id = u.session_id AND a.turn = u.turn + 1
         WHERE u.role = 'user' AND a.role = 'assistant')"""

ORACLE = {
    "scan_pages": """SELECT page_id, CAST(strlen(html) + 1 AS BIGINT) AS n_bytes, 'ok' AS status,
       CAST(length(html) AS INTEGER) AS n_chars FROM pages""",
    "scan_text_lines": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no,
       regexp_replace(l[i], '^{_WS}+|{_WS}+$', '', 'g') AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) t(i)
WHERE regexp_replace(l[i], '^{_WS}+|{_WS}+$', '', 'g') <> ''""",
    "scan_chat_sessions": f"""WITH {_MSG}
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS turn, role, content,
       'ok' AS status FROM messages""",
    "scan_session_names": """SELECT event_id, k AS session_id, json_extract_string(props, '$."' || k || '"') AS name
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""",
    "scan_json_tolerant": """SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       NOT coalesce(json_valid(props), false) AS corrupt FROM events""",
    "scan_answer_log": f"""WITH {_QA}
SELECT question AS "Question", '{MODEL_NAME}' AS "Model Name", answer AS "Response" FROM qa""",
    "vector_store": "SELECT min(vec_id) AS vec_id, arg_min(label, vec_id) AS label FROM embeddings GROUP BY embedding",
    "sink_processed_corpus": f"""SELECT doc_id, CAST(length(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) AS INTEGER) AS n_chars
FROM documents""",
    "sink_answer_log": f"""WITH {_QA}
SELECT question, '{MODEL_NAME}' AS model, answer AS response FROM qa
UNION ALL SELECT question, '{MODEL_NAME}', answer FROM qa""",
    "sink_sessions": "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(count(*) AS INTEGER) AS n_messages FROM conversations GROUP BY conv_id",
    "sink_feedback": """SELECT event_type AS model_name, 'question ' || CAST(event_id AS VARCHAR) AS question, props AS response,
       coalesce(nullif(CASE WHEN value > 25 THEN 'comment ' || CAST(event_id AS VARCHAR) END, ''),
                nullif(CASE WHEN event_type <> 'view' THEN event_type ELSE '' END, ''), '') AS feedback,
       CAST(trunc(value) AS INTEGER) AS rating_score FROM events""",
    "sink_response_time": """SELECT CAST(event_id AS VARCHAR) AS question_number, event_type AS question,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS response_time, ts AS timestamp FROM events
WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL""",
}


def _eval_snapshot_sql():
    from docweave.registry.lexical import ORACLE as LXO
    base = LXO["fuzzy_best_match"]
    return f"SELECT p_partkey, match_id, ratio FROM ({base}) WHERE matched"


ORACLE["sink_eval_snapshot"] = _eval_snapshot_sql()

"""Registered queries: conversation tables (filters, windows, joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import chat as CH
from docweave.registry.sqlfrag import WS, ustrip
from docweave.session import table

SEARCH_QUERY = "que"
BATCH_TS = "2025-01-01 00:00:00"
ALLOWED_MODELS = ["click", "view", "purchase"]


def messages(spark, sf):
    """conversations -> messages(session_id STRING, turn, role, content)."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role",
        F.col("text").alias("content"))


def names(spark, sf):
    """Display names: sessions with a system message are named after it."""
    return (messages(spark, sf).filter(F.col("role") == "system")
            .groupBy("session_id").agg(F.min_by("content", "turn").alias("c"))
            .select("session_id", tx.truncate_title(F.col("c")).alias("name")))


def q_user_questions(spark, sf):
    return CH.user_questions(messages(spark, sf))


def q_chat_history(spark, sf):
    return CH.chat_history(messages(spark, sf), names(spark, sf))


def q_session_messages(spark, sf):
    req = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"))
    return CH.session_messages(messages(spark, sf), req)


def q_search_pairs(spark, sf):
    return CH.search_pairs(messages(spark, sf), SEARCH_QUERY)


def _first_questions(m):
    return (m.filter(F.col("role") == "user").groupBy("session_id")
            .agg(F.min_by("content", "turn").alias("question")))


def q_delete_pair(spark, sf):
    m = messages(spark, sf)
    return CH.delete_pair(m, _first_questions(m))


def q_backfill_timestamp(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("session_id"),
                                           F.col("ts").alias("timestamp"))
    m = messages(spark, sf).join(ev, "session_id", "left")
    return CH.backfill_timestamp(m, "timestamp", BATCH_TS).select("session_id", "turn", "timestamp")


def _rename_requests(spark, sf):
    return (table(spark, sf, "events").filter(F.col("event_type") == "signup")
            .select(F.col("user_id").cast("string").alias("session_id"),
                    F.concat(F.lit("renamed "), F.col("event_id").cast("string")).alias("name"),
                    F.col("event_id").alias("seq")))


def q_rename_sessions(spark, sf):
    return CH.rename_sessions(names(spark, sf), _rename_requests(spark, sf), "seq")


def q_delete_sessions(spark, sf):
    ids = (table(spark, sf, "labels").filter(F.col("toxic") == 1)
           .select(F.col("doc_id").cast("string").alias("session_id")))
    m, n = CH.delete_sessions(messages(spark, sf), names(spark, sf), ids)
    return m.join(n, "session_id", "left").select("session_id", "turn", "role", "name")


def q_append_messages(spark, sf):
    req = (table(spark, sf, "events").filter(F.col("event_type") == "purchase")
           .select(F.col("user_id").cast("string").alias("session_id"),
                   F.concat(F.lit("question "), F.col("event_id").cast("string")).alias("question"),
                   F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("answer"),
                   "ts", F.col("event_id").alias("seq")))
    return CH.append_messages(messages(spark, sf), req)


def q_insert_document(spark, sf):
    corpus = table(spark, sf, "documents").select("doc_id", "text", F.col("doc_id").alias("pos"))
    new = table(spark, sf, "benchmark").select(
        (F.col("item_id") + F.lit(1_000_000_000)).alias("doc_id"), "text", F.col("item_id").alias("seq"))
    return CH.insert_document(corpus, new, "pos")


def q_supported_models(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"))
    return CH.supported_models(ev, "model", ALLOWED_MODELS)


def q_conversation_text(spark, sf):
    return CH.conversation_text(messages(spark, sf))


def q_conversation_title(spark, sf):
    return CH.conversation_title(messages(spark, sf))


QUERIES = {
    "user_questions": q_user_questions,
    "chat_history": q_chat_history,
    "session_messages": q_session_messages,
    "search_pairs": q_search_pairs,
    "delete_pair": q_delete_pair,
    "backfill_timestamp": q_backfill_timestamp,
    "rename_sessions": q_rename_sessions,
    "delete_sessions": q_delete_sessions,
    "append_messages": q_append_messages,
    "insert_document": q_insert_document,
    "supported_models": q_supported_models,
    "conversation_text": q_conversation_text,
    "conversation_title": q_conversation_title,
}


def _truncate_sql(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({ustrip(x)}, '{WS}+'), lambda w: w <> '')"
    return (f"(CASE WHEN len({words}) > 8 THEN array_to_string({words}[1:8], ' ') || '...' "
            f"ELSE {ustrip(x)} END)")


_MSG = """messages AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text AS content
                      FROM conversations)"""
_NAMES = f"""names AS (SELECT session_id, {_truncate_sql('c')} AS name FROM (
      SELECT session_id, arg_min(content, turn) AS c FROM messages WHERE role = 'system'
      GROUP BY session_id))"""
_FIRSTQ = """firstq AS (SELECT session_id, arg_min(content, turn) AS question FROM messages
                   WHERE role = 'user' GROUP BY session_id)"""

ORACLE = {
    "user_questions": f"WITH {_MSG} SELECT session_id, turn, content FROM messages WHERE role = 'user'",
    "chat_history": f"""WITH {_MSG}, {_NAMES}
SELECT m.session_id, coalesce(n.name, m.session_id) AS name, m.turn, m.role, m.content
FROM messages m LEFT JOIN names n USING (session_id)""",
    "session_messages": f"""WITH {_MSG},
  req AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id FROM events)
SELECT m.session_id, m.turn, m.role, m.content, 'ok' AS status FROM messages m
WHERE m.session_id IN (SELECT session_id FROM req)
UNION ALL
SELECT session_id, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 'not_found' FROM req
WHERE session_id NOT IN (SELECT session_id FROM messages)""",
    "search_pairs": f"""WITH {_MSG},
  h AS (SELECT *, lag(role) OVER w AS prev_role, lag(content) OVER w AS prev_content
        FROM messages WHERE role IN ('user', 'assistant') AND contains(lower(content), '{SEARCH_QUERY}')
        WINDOW w AS (PARTITION BY session_id ORDER BY turn))
SELECT session_id, turn, prev_content AS question, content AS answer FROM h
WHERE role = 'assistant' AND prev_role = 'user'""",
    "delete_pair": f"""WITH {_MSG}, {_FIRSTQ},
  m AS (SELECT m.*, coalesce(m.role = 'user' AND m.content = f.question, false) AS hit,
               row_number() OVER (PARTITION BY m.session_id ORDER BY m.turn) AS rn
        FROM messages m LEFT JOIN firstq f USING (session_id)),
  g AS (SELECT *, max(CASE WHEN NOT hit THEN rn ELSE 0 END) OVER (
               PARTITION BY session_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS last_miss FROM m),
  t AS (SELECT *, hit AND (rn - last_miss) % 2 = 1 AS trig FROM g),
  f AS (SELECT *, lag(trig) OVER (PARTITION BY session_id ORDER BY rn) AS prev_trig FROM t)
SELECT session_id, turn, role, content FROM f WHERE NOT (hit OR coalesce(prev_trig, false))""",
    "backfill_timestamp": f"""WITH {_MSG}
SELECT m.session_id, m.turn,
       coalesce(e.ts, TIMESTAMP '{BATCH_TS}') AS timestamp
FROM messages m LEFT JOIN events e ON CAST(e.event_id AS VARCHAR) = m.session_id""",
    "rename_sessions": f"""WITH {_MSG}, {_NAMES},
  req AS (SELECT CAST(user_id AS VARCHAR) AS session_id, 'renamed ' || CAST(event_id AS VARCHAR) AS name,
                 event_id AS seq FROM events WHERE event_type = 'signup'),
  latest AS (SELECT session_id, arg_max(name, seq) AS name FROM req GROUP BY session_id)
SELECT session_id, name FROM names WHERE session_id NOT IN (SELECT session_id FROM latest)
UNION ALL SELECT session_id, name FROM latest""",
    "delete_sessions": f"""WITH {_MSG}, {_NAMES},
  ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS session_id FROM labels WHERE toxic = 1)
SELECT m.session_id, m.turn, m.role, n.name FROM messages m
LEFT JOIN (SELECT * FROM names WHERE session_id NOT IN (SELECT session_id FROM ids)) n USING (session_id)
WHERE m.session_id NOT IN (SELECT session_id FROM ids)""",
    "append_messages": f"""WITH {_MSG},
  last AS (SELECT session_id, max(turn) AS l FROM messages GROUP BY session_id),
  req AS (SELECT CASE WHEN last.l IS NOT NULL THEN r.session_id
                      ELSE strftime(r.ts, 'chat_session_%Y%m%d_%H%M%S') || '_' || CAST(r.seq AS VARCHAR) END AS session_id,
                 last.l, r.question, r.answer, r.seq
          FROM (SELECT CAST(user_id AS VARCHAR) AS session_id,
                       'question ' || CAST(event_id AS VARCHAR) AS question,
                       'answer ' || CAST(event_id AS VARCHAR) AS answer, ts, event_id AS seq
                FROM events WHERE event_type = 'purchase') r
          LEFT JOIN last USING (session_id)),
  n AS (SELECT *, coalesce(l + 1, 0) + (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) * 2 AS base
        FROM req)
SELECT session_id, turn, role, content FROM messages
UNION ALL SELECT session_id, base, 'user', question FROM n
UNION ALL SELECT session_id, base + 1, 'assistant', answer FROM n""",
    "insert_document": f"""WITH last AS (SELECT max(doc_id) AS p, arg_max(text, doc_id) AS t FROM documents),
  fb AS (SELECT p, coalesce(starts_with(t, '{CH.FEEDBACK_HEADING}'), false) AS fb FROM last),
  ms AS (SELECT max(item_id) AS s FROM benchmark)
SELECT d.doc_id AS pos_major,
       CAST(CASE WHEN fb.fb AND d.doc_id = fb.p THEN coalesce(ms.s + 1, 1) ELSE 0 END AS BIGINT) AS pos_minor,
       d.doc_id, d.text FROM documents d, fb, ms
UNION ALL
SELECT CAST(CASE WHEN fb.fb THEN fb.p ELSE coalesce(fb.p + 1, 0) END AS BIGINT), b.item_id,
       b.item_id + 1000000000, b.text FROM benchmark b, fb WHERE fb.p IS NOT NULL""",
    "supported_models": f"""SELECT event_id, event_type AS model,
  CASE WHEN event_type IN ({', '.join("'" + m + "'" for m in ALLOWED_MODELS)}) THEN 'ok' ELSE 'rejected' END AS status
FROM events""",
    "conversation_text": f"""WITH {_MSG}
SELECT session_id, string_agg(content, ' ' ORDER BY turn) AS conversation_text FROM messages GROUP BY session_id""",
    "conversation_title": f"""WITH {_MSG},
  f AS (SELECT session_id, arg_min(content, turn) AS c FROM messages WHERE role = 'user' GROUP BY session_id),
  s AS (SELECT DISTINCT session_id FROM messages)
SELECT s.session_id, CASE WHEN f.c IS NULL OR {ustrip('f.c')} = '' THEN 'Untitled Chat'
                          ELSE {_truncate_sql('f.c')} END AS title
FROM s LEFT JOIN f USING (session_id)""",
}

"""Conversation-table operators: sessions, search, pair deletion, upserts.

Messages are long-form ``(session_id, turn, role, content[, ts])``. Order
inside a session comes from ``turn``; "the message before" is a join on the
skew-safe sequence number from ``plans.skew``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.plans.skew import ordered_concat, running_max, seq_number, with_previous
from docweave.session import reliable_checkpoint


def user_questions(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role") == "user").select("session_id", "turn", "content")


def chat_history(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Sessions with their display name (defaults to the session id), one row
    per message in turn order (long form: no session is collected)."""
    return (messages.join(names, "session_id", "left")
            .select("session_id", F.coalesce("name", "session_id").alias("name"),
                    "turn", "role", "content"))


def session_messages(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages of each requested session; a requested session with no
    messages yields one ``not_found`` row."""
    req = requests.select("session_id").distinct()
    found = messages.join(req, "session_id", "left_semi").select(
        "session_id", "turn", "role", "content", F.lit("ok").alias("status"))
    missing = req.join(messages.select("session_id"), "session_id", "left_anti").select(
        "session_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("content"), F.lit("not_found").alias("status"))
    return found.unionByName(missing)


def search_pairs(messages: DataFrame, query: str) -> DataFrame:
    """Question/answer pairs where both messages contain ``query``
    (case-insensitive substring). Among matching user/assistant messages of a
    session, an assistant message pairs with the matching message right
    before it when that one is a user message. Empty query -> no rows."""
    if not query:
        return messages.select("session_id", F.col("content").alias("question"),
                               F.col("content").alias("answer")).limit(0)
    q = query.lower()
    hits = messages.filter(F.col("role").isin("user", "assistant")
                           & F.lower("content").contains(q))
    hits = seq_number(hits, ["session_id"], "turn")
    paired = with_previous(hits, ["session_id"], "seq", ["role", "content"])
    return (paired.filter((F.col("role") == "assistant") & (F.col("prev_role") == "user"))
            .select("session_id", "turn", F.col("prev_content").alias("question"),
                    F.col("content").alias("answer")))


def delete_pair(messages: DataFrame, requests: DataFrame, seq_col: str | None = None) -> DataFrame:
    """For each (session_id, question) request remove every user message equal
    to the question together with the message right after it. In a run of
    consecutive matches the 1st, 3rd, ... are deletions that also take the
    next message; the 2nd, 4th, ... are taken as "next" ones.

    Requests of one session apply one after the other, by ``seq_col`` if given
    and then by question; a repeated request counts once, at its first place.
    There is one pass for each request that a session has at most."""
    seq = F.col(seq_col) if seq_col else F.lit(0)
    distinct = requests.groupBy("session_id", "question").agg(F.min(seq).alias("__s"))
    ranked = distinct.withColumn("__r", F.row_number().over(Window.partitionBy("session_id").orderBy("__s", "question")))
    passes = ranked.agg(F.max("__r")).first()[0] or 0
    if passes > 1:
        ranked = reliable_checkpoint(ranked)
    out = messages
    for r in range(1, passes + 1):
        out = _delete_one(out, ranked.filter(F.col("__r") == r).select("session_id", F.col("question").alias("__q")))
        if r < passes:
            out = reliable_checkpoint(out)
    return out


def _delete_one(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """``delete_pair`` for at most one request per session (column ``__q``)."""
    m = (messages.join(requests, "session_id", "left")
         .withColumn("__hit", F.coalesce((F.col("role") == "user") & (F.col("content") == F.col("__q")),
                                         F.lit(False))))
    m = seq_number(m, ["session_id"], "turn")
    m = running_max(m, ["session_id"], "turn",
                    F.when(~F.col("__hit"), F.col("seq")).otherwise(F.lit(0)), "__last_miss")
    m = m.withColumn("__trigger", F.col("__hit") & (((F.col("seq") - F.col("__last_miss")) % 2) == 1))
    m = with_previous(m, ["session_id"], "seq", ["__trigger"])
    keep = ~(F.col("__hit") | F.coalesce(F.col("prev___trigger"), F.lit(False)))
    return m.filter(keep).select(*messages.columns)


def backfill_timestamp(messages: DataFrame, ts_col: str, batch_ts: str) -> DataFrame:
    """Missing timestamps get the batch time (explicit for determinism)."""
    # the literal takes the column's own type (wall-clock NTZ stays NTZ)
    lit = F.lit(batch_ts).cast(messages.schema[ts_col].dataType)
    return messages.withColumn(ts_col, F.coalesce(F.col(ts_col), lit))


def rename_sessions(names: DataFrame, requests: DataFrame, seq_col: str) -> DataFrame:
    """Upsert display names: requests need both fields; the last request per
    session (by ``seq_col``) wins; untouched names stay."""
    latest = (requests.filter(F.col("session_id").isNotNull() & F.col("name").isNotNull()
                              & (F.col("name") != ""))
              .groupBy("session_id").agg(F.max_by("name", seq_col).alias("name")))
    kept = names.join(latest.select("session_id"), "session_id", "left_anti")
    return kept.select("session_id", "name").unionByName(latest)


def delete_sessions(messages: DataFrame, names: DataFrame, ids: DataFrame):
    """Remove sessions (messages and names) by id; returns both tables."""
    ids = ids.select("session_id").distinct()
    return (messages.join(ids, "session_id", "left_anti"),
            names.join(ids, "session_id", "left_anti"))


def new_session_id(ts: Column, seq: Column) -> Column:
    """Named from the request's time; its number tells requests of the same
    second apart."""
    return F.concat_ws("_", F.date_format(ts, "'chat_session_'yyyyMMdd_HHmmss"), seq.cast("string"))


def append_messages(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (session_id or null, question, answer, ts, seq) appends a
    user then an assistant message to its session; each request with a missing
    or unknown session opens a new one named from its time and number (after
    the last message, should that name exist). Returns the whole message table
    with the new rows."""
    last = messages.groupBy("session_id").agg(F.max("turn").alias("__last"))
    known = requests.join(last.select("session_id", F.lit(True).alias("__known")), "session_id", "left")
    r = known.withColumn("session_id", F.when(F.col("__known"), F.col("session_id"))
                         .otherwise(new_session_id(F.col("ts"), F.col("seq")))).join(last, "session_id", "left")
    r = (seq_number(r, ["session_id"], "seq", out="__n")
         .withColumn("__base", F.coalesce(F.col("__last") + 1, F.lit(0)) + (F.col("__n") - 1) * 2))
    rows = r.select("session_id", F.explode(F.array(
        F.struct(F.col("__base").cast("long").alias("turn"), F.lit("user").alias("role"),
                 F.col("question").alias("content")),
        F.struct((F.col("__base") + 1).cast("long").alias("turn"), F.lit("assistant").alias("role"),
                 F.col("answer").alias("content")))).alias("m")).select("session_id", "m.*")
    return messages.select("session_id", "turn", "role", "content").unionByName(rows)


# Fixed value: the heading that marks the feedback document (it stays last).
FEEDBACK_HEADING = "---Feedback---"


def insert_document(corpus: DataFrame, new_docs: DataFrame, pos_col: str) -> DataFrame:
    """Append documents in ``seq`` order; if the corpus' last document starts
    with the feedback heading, the new ones go before it (which stays last).
    Order is ``(pos_major, pos_minor)``: nothing is renumbered globally.
    The last position and the flag are scalar subqueries."""
    last = corpus.agg(F.max_by(F.struct(F.col(pos_col).alias("p"), F.col("text").alias("t")),
                               F.col(pos_col)).alias("l"))
    last_pos = last.select(F.col("l.p")).scalar()
    is_fb = F.coalesce(last.select(F.col("l.t").startswith(FEEDBACK_HEADING)).scalar(), F.lit(False))
    top_seq = new_docs.agg(F.max("seq")).scalar()
    old = corpus.select(
        F.col(pos_col).cast("long").alias("pos_major"),
        F.when(is_fb & (F.col(pos_col) == last_pos), F.coalesce(top_seq + 1, F.lit(1)))
        .otherwise(F.lit(0)).cast("long").alias("pos_minor"),
        "doc_id", "text")
    ins = new_docs.select(
        F.when(is_fb, last_pos).otherwise(F.coalesce(last_pos + 1, F.lit(0))).cast("long").alias("pos_major"),
        F.col("seq").cast("long").alias("pos_minor"), "doc_id", "text")
    # an empty corpus takes no insertions
    return old.unionByName(ins.filter(last_pos.isNotNull()))


def supported_models(df: DataFrame, model_col: str, allowed: list[str]) -> DataFrame:
    """Flag rows whose model is in the allowed set; the rest are rejected."""
    return df.withColumn("status", F.when(F.col(model_col).isin(*allowed), F.lit("ok"))
                         .otherwise(F.lit("rejected")))


def conversation_text(messages: DataFrame) -> DataFrame:
    """All messages of a session space-joined in turn order."""
    return ordered_concat(messages, ["session_id"], "turn", "content", " ", "conversation_text")


def conversation_title(messages: DataFrame, max_words: int = 8) -> DataFrame:
    """Extractive title (the reference asks a model): the first user message
    truncated to ``max_words`` words; sessions without one are "Untitled Chat"."""
    first = (messages.filter(F.col("role") == "user").groupBy("session_id")
             .agg(F.min_by("content", "turn").alias("__c")))
    sessions = messages.select("session_id").distinct()
    return (sessions.join(first, "session_id", "left")
            .select("session_id", F.when(F.col("__c").isNull() | (tx.ustrip(F.col("__c")) == ""),
                                         F.lit("Untitled Chat"))
                    .otherwise(tx.truncate_title(F.col("__c"), max_words)).alias("title")))


def sessions_json(messages: DataFrame) -> DataFrame:
    """One JSON array per session ``[{role, content, timestamp}]`` in turn
    order, non-ASCII kept (for the session sink). Built by the two-level
    ordered concat, so a very long session is assembled in parallel."""
    objs = messages.select("session_id", "turn", F.to_json(F.struct(
        "role", "content", F.col("timestamp").cast("string").alias("timestamp"))).alias("__o"))
    return (ordered_concat(objs, ["session_id"], "turn", "__o", ",", "__j")
            .select("session_id", F.concat(F.lit("["), F.col("__j"), F.lit("]")).alias("json")))

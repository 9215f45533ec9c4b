"""Sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.text import excerpt


def upsert(sessions: DataFrame, changes: DataFrame, key: str = "session_id") -> DataFrame:
    """changes over sessions: the latest update wins, the first created_at is kept."""
    both = sessions.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key)
    ordered = both.withColumn("_n", F.row_number().over(w.orderBy(F.desc("_new"), F.desc("updated_at")))).withColumn("created_at", F.min("created_at").over(w))
    return ordered.where("_n = 1").drop("_n", "_new")


def get(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("session_id") == session_id).limit(1)


def latest(sessions: DataFrame, n: int, most: int = 1000) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), "session_id").limit(max(1, min(n, most)))


def with_message(messages: DataFrame, condition: Column) -> DataFrame:
    """Conversations that have such a message: a semi join on the key."""
    return messages.select("conv_id").distinct().join(messages.where(condition).select("conv_id"), "conv_id", "left_semi")


def summaries(messages: DataFrame, preview: int = 72, title: int = 24) -> DataFrame:
    user = F.col("role") == "user"
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("message_count"),
        F.substring(F.coalesce(F.min_by("text", F.when(user, F.col("turn"))), F.lit("")), 1, title).alias("title"),
        excerpt(F.coalesce(F.max_by("text", F.when(user, F.col("turn"))), F.lit("")), preview).alias("preview"),
    )


def age_bucket(updated: Column, now: Column) -> Column:
    days = F.datediff(now, updated)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "7 days").when(days <= 30, "30 days").otherwise("older")


#: Columns that a stored session has of its own; all others go into its payload.
KNOWN = ("session_id", "title", "created_at", "updated_at", "status")


def serialize(sessions: DataFrame) -> DataFrame:
    """Sessions with any columns as rows to store: the known columns, and the others as JSON in payload. A session without an
    id is an error; without a title it gets one from the end of its id, without a status it is idle."""
    sid = F.trim(F.coalesce(F.col("session_id"), F.lit("")))
    need = F.when(sid == "", F.raise_error(F.lit("a session lacks its id")).cast("string")).otherwise(sid)
    title = F.nullif(F.trim(F.coalesce(F.col("title"), F.lit(""))), F.lit(""))
    more = [c for c in sessions.columns if c not in KNOWN]
    payload = F.to_json(F.struct(*more)) if more else F.lit("{}")
    return sessions.select(
        need.alias("session_id"), F.coalesce(title, F.concat(F.lit("新会话 "), F.right(sid, F.lit(8)))).alias("title"), "created_at", "updated_at",
        F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("idle")).alias("status"), payload.alias("payload"),
    )


def deserialize(rows: DataFrame, schema: str) -> DataFrame:
    """Stored rows with the payload's fields (a schema) as columns again. A field that has a known column's name overrides it,
    where the payload gives it; a payload that can't be read gives nulls."""
    read = rows.withColumn("_p", F.from_json("payload", schema))
    names = read.schema["_p"].dataType.names
    own = [F.coalesce(F.col(f"_p.{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in KNOWN]
    return read.select(*own, *[F.col(f"_p.{n}").alias(n) for n in names if n not in KNOWN])


def references(evidence: DataFrame, trace_id: str) -> DataFrame:
    """The citations of one trace, in order."""
    return evidence.where(F.col("trace_id") == trace_id).orderBy("rank_no")


def feedback(messages: DataFrame, given: DataFrame) -> DataFrame:
    """Feedback rows to append: given (message_id, helpful, reason_tag, rating, comment) with the message's conversation, trace
    and kind. Only assistants' messages take feedback: that to others, or to unknown messages, is an error."""
    known = messages.select("message_id", "conv_id", "trace_id", "role", "kind", "intent", "status")
    joined = given.join(known, "message_id", "left")
    wrong = F.when(F.coalesce("role", F.lit("")) != "assistant", F.raise_error(F.lit("only an assistant's message takes feedback")).cast("string")).otherwise(F.col("message_id"))
    trimmed = [F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("reason_tag", "comment")]
    return joined.select(wrong.alias("message_id"), "conv_id", F.coalesce("trace_id", F.lit("")).alias("trace_id"), F.coalesce("helpful", F.lit(False)).alias("helpful"), *trimmed, "rating", F.to_json(F.struct("kind", "intent", "status")).alias("payload"))


def add_turn(history: DataFrame, turns: DataFrame) -> DataFrame:
    """history (conv_id, turn, role, text) and new turns (conv_id, role, text, nth) after it, numbered on; without a history from 0."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("last"))
    new = turns.join(last, "conv_id", "left").select("conv_id", (F.coalesce("last", F.lit(-1)) + F.col("nth")).cast(history.schema["turn"].dataType).alias("turn"), "role", "text")
    return history.select("conv_id", "turn", "role", "text").unionByName(new)

"""Tables of other shapes as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import make_id
from .store import ROLES

#: Where made-up times start, and the distance of two messages, in milliseconds.
BASE_TS, STEP = 1_700_000_000_000, 60_000


def known_role(role: Column, unknown: str = "tool") -> Column:
    """Roles that a memory doesn't know become `unknown`; with "reject" a query over such a row fails."""
    fine = F.col("role").isin(*ROLES) if role is None else role.isin(*ROLES)
    return F.when(fine, role).otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))) if unknown == "reject" else F.lit(unknown))


def messages_of(rows: DataFrame) -> DataFrame:
    """Complete messages from (memory, session_ref, message_ref, seq, author, role, ts, body, ord), with ids made of them."""
    session = make_id(F.col("ts0"), F.lit("session"), F.col("memory"), F.col("session_ref"))
    message = make_id(F.col("ts"), F.lit("message"), F.col("memory"), F.col("session_ref"), F.col("seq").cast("string"))
    first = rows if "ts0" in rows.columns else rows.withColumn("ts0", F.lit(0))
    return first.select("memory", message.alias("message_id"), session.alias("session_id"), "session_ref", "message_ref", "seq", "author", "role", "ts", "body", "ord")


def from_conversations(rows: DataFrame, memory: str = "conversations", unknown_role: str = "tool") -> DataFrame:
    """A conversation is a session, a turn a message. The table has no times, so they are made of the key."""
    ts = F.lit(BASE_TS) + (F.col("conv_id") * 100 + F.col("turn")) * STEP
    role = known_role(F.col("role"), unknown_role)
    return messages_of(rows.select(F.lit(memory).alias("memory"), F.col("conv_id").cast("string").alias("session_ref"), F.col("turn").cast("string").alias("message_ref"), F.col("turn").cast("bigint").alias("seq"), F.col("role").alias("author"), role.alias("role"), ts.alias("ts"), F.coalesce("text", F.lit("")).alias("body"), F.col("conv_id").cast("bigint").alias("ord")))


def conversations_as_messages(rows: DataFrame, memory: str = "whole_conversations") -> DataFrame:
    """A conversation is one message whose paragraphs are its turns."""
    whole = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    ts = F.lit(BASE_TS) + F.col("conv_id") * STEP
    return messages_of(whole.select(F.lit(memory).alias("memory"), F.lit("all").alias("session_ref"), F.col("conv_id").cast("string").alias("message_ref"), F.col("conv_id").cast("bigint").alias("seq"), F.lit("user").alias("author"), F.lit("user").alias("role"), ts.alias("ts"), "body", F.lit(0).cast("bigint").alias("ord")))


def from_documents(rows: DataFrame) -> DataFrame:
    """A language is a memory, a source a session, a document a message."""
    ts = F.lit(BASE_TS) + F.col("doc_id") * STEP
    return messages_of(rows.select(F.col("lang").alias("memory"), F.col("source").alias("session_ref"), F.col("doc_id").cast("string").alias("message_ref"), F.col("doc_id").cast("bigint").alias("seq"), F.lit("user").alias("author"), F.lit("user").alias("role"), ts.alias("ts"), F.coalesce("text", F.lit("")).alias("body"), F.lit(0).cast("bigint").alias("ord")))

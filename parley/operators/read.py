"""Reading without a query: outlines, windows around a unit, frequencies of words, the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize
from .indexer import CEILING, FIELDS
from .search import Index


def outline_sessions(messages: DataFrame, units: DataFrame) -> DataFrame:
    """One row per session, in the order of their creation, with the numbers of messages and units."""
    per = messages.groupBy("session_id", "session_ref").agg(F.min_by("ts", "seq").alias("started_at"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("messages"))
    pieces = units.groupBy("session_id").agg(F.count(F.lit(1)).alias("units"))
    told = per.join(pieces, "session_id", "left")
    told = told.withColumn("units", F.coalesce("units", F.lit(0))).withColumn("ended_at", F.lit(None).cast("bigint"))
    return told.orderBy("ord", "session_id").select("session_id", "session_ref", "started_at", "ended_at", "messages", "units")


def outline_messages(messages: DataFrame, units: DataFrame, session_id: str | None = None) -> DataFrame:
    """The messages of a session (of all, if none is named) by seq, with their characters and units."""
    some = messages if session_id is None else messages.where(F.col("session_id") == session_id)
    pieces = units.groupBy("message_id").agg(F.count(F.lit(1)).alias("units"))
    told = some.join(pieces, "message_id", "left")
    return told.select("message_id", "message_ref", "session_id", "session_ref", "seq", "author", "role", "ts", F.length("body").alias("characters"), F.coalesce("units", F.lit(0)).alias("units")).orderBy("session_id", "seq")


def window(units: DataFrame, cursors: DataFrame, before: int = 2, after: int = 2, messages: bool = False) -> DataFrame:
    """The units around each cursor(unit_id), once each, with anchor marking the cursors, in reading order.

    First the messages up to `before` back and `after` forward; then, unless whole messages are asked for, so
    many units back and forward within those. Negative numbers count as 0. Unknown cursors have no rows."""
    before, after = max(0, before), max(0, after)
    anchors = units.join(cursors.select("unit_id").distinct(), "unit_id").select(F.col("unit_id").alias("cursor"), F.col("session_id").alias("s"), F.col("message_seq").alias("at"))
    near = units.join(anchors, (F.col("session_id") == F.col("s")) & F.col("message_seq").between(F.col("at") - before, F.col("at") + after))
    if not messages:
        order = Window.partitionBy("cursor").orderBy("message_seq", "unit_seq")
        near = near.withColumn("nth", F.row_number().over(order))
        near = near.withColumn("own", F.max(F.when(F.col("unit_id") == F.col("cursor"), F.col("nth"))).over(Window.partitionBy("cursor"))).where(F.col("nth").between(F.col("own") - before, F.col("own") + after))
    marked = near.groupBy("unit_id").agg(F.max(F.col("unit_id") == F.col("cursor")).alias("anchor"))
    return units.join(marked, "unit_id").select("session_id", "message_id", "message_seq", "unit_id", "unit_seq", "role", "ts", "text", "anchor", "ord").orderBy("ord", "session_id", "message_seq", "unit_seq").drop("ord")


def missing(units: DataFrame, cursors: DataFrame) -> DataFrame:
    return cursors.select("unit_id").distinct().join(units.select("unit_id"), "unit_id", "left_anti")


def group_window(rows: DataFrame) -> DataFrame:
    """A window's rows by message: the units in order."""
    struct = F.struct("unit_seq", "unit_id", "text", "anchor")
    return rows.groupBy("session_id", "message_id", "message_seq", "role", "ts").agg(F.array_sort(F.collect_list(struct)).alias("units"), F.max("anchor").alias("anchor")).orderBy("session_id", "message_seq")


def lexicon(index: Index, words: list[str]) -> DataFrame:
    """Of each word its forms, folded whole as they are given, and the units that hold them in each field."""
    if not words:
        raise ValueError("no word is given")
    spark = index.units.sparkSession
    rows = []
    for i, w in enumerate(words):
        first = normalize.segment(w)
        rows.append((i, w, normalize.surface(w), normalize.lemma(w, normalize.script(first[0]) if first else "other")))
    asked = spark.createDataFrame(rows, "i int, word string, surface string, lemma string")
    stats = index.term_stats().where(F.col("term").isin(*{f for r in rows for f in r[2:]}))
    for f, form in zip(FIELDS, ("surface", "lemma", "lemma"), strict=True):
        some = stats.where(F.col("field") == f).select(F.col("term").alias(form), F.col("df").alias(f"{f}_units"))
        asked = asked.join(some, form, "left")
    return asked.orderBy("i").select("word", "surface", "lemma", *[F.coalesce(f"{f}_units", F.lit(0)).alias(f"{f}_units") for f in FIELDS])


def vocabulary(index: Index, limit: int = 60) -> DataFrame:
    """The most frequent lemmas that not too many units hold. A memory of few units has none."""
    n, _ = index.counts()
    kept = index.term_stats().where((F.col("field") == "lemma") & (F.col("df") <= int(CEILING * n)))
    return kept.select("term", F.col("df").alias("units")).orderBy(F.desc("units"), "term").limit(limit)

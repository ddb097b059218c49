"""From messages to units, postings and statistics.

Postings of a unit are found inside the task that splits its message, so building an index has one shuffle
at most: the range partitioning of the postings by (field, term), which lets a query read few row groups."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.ids import make_id
from .split import split_units

#: Lemmas that a unit borrows from the rest of its message, and the part of all units from which a lemma is too common
#: for the vocabulary (fixed values).
CONTEXT_TERMS, CEILING = 8, 0.15
FIELDS = ("surface", "lemma", "context")

MESSAGE = "memory string, message_id string, session_id string, session_ref string, message_ref string, seq bigint, author string, role string, ts bigint, body string, ord bigint"
UNIT = "memory string, unit_id string, message_id string, session_id string, session_ref string, message_ref string, message_seq bigint, unit_seq int, start int, end int, code boolean, text string, sentences array<string>, author string, role string, ts bigint, ord bigint"
TERM_STAT = "memory string, field string, term string, df bigint"
#: total_len of each field, and n_units in a row of its own, whose field is *.
FIELD_STAT = "memory string, field string, n_units bigint, total_len bigint"
POSTING = "memory string, field string, term string, unit_id string, message_id string, tf int, positions array<int>, len int"


def units_of(messages: DataFrame) -> DataFrame:
    """One row per unit of each message. Blank bodies have none."""
    pieces = messages.select("*", F.explode(split_units(F.col("body"))).alias("u"))
    unit_id = make_id(F.col("ts"), F.lit("unit"), F.col("memory"), F.col("session_ref"), F.col("seq").cast("string"), F.col("u.seq").cast("string"))
    return pieces.select(
        "memory", unit_id.alias("unit_id"), "message_id", "session_id", "session_ref", "message_ref", F.col("seq").alias("message_seq"), F.col("u.seq").alias("unit_seq"),
        F.col("u.start").alias("start"), F.col("u.end").alias("end"), F.col("u.code").alias("code"), F.col("u.text").alias("text"), F.col("u.sentences").alias("sentences"), "author", "role", "ts", "ord",
    )


def context_terms(lemmas: DataFrame, known: DataFrame | None = None, n_units: int = 0) -> DataFrame:
    """lemmas(memory, message_id, unit_id, lemma array) with context: the first CONTEXT_TERMS lemmas of its message that the
    unit hasn't itself, the rarest first, those as rare in byte order. known (term, df) of n_units units tells what is rare and
    what is in more than CEILING of them and so is never borrowed; without it, as when an index is built anew, byte order decides."""
    if known is None:
        shared = lemmas.groupBy("memory", "message_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lemma")))).alias("all"))
    else:
        ceiling = int(max(n_units, 1) * CEILING)
        own = lemmas.select("memory", "message_id", F.explode("lemma").alias("term")).where("term <> ''").distinct()
        rated = own.join(known, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        fine = F.col("df") <= ceiling if ceiling else F.lit(True)
        ranked = F.filter(F.array_sort(F.collect_list(F.struct(fine.alias("fine"), "df", "term"))), lambda x: x["fine"])
        shared = rated.groupBy("memory", "message_id").agg(F.transform(ranked, lambda x: x["term"]).alias("all"))
        shared = lemmas.select("memory", "message_id").distinct().join(shared, ["memory", "message_id"], "left").withColumn("all", F.coalesce("all", F.array().cast("array<string>")))
    near = F.slice(F.filter(F.array_except("all", "lemma"), lambda t: t != ""), 1, CONTEXT_TERMS)
    return lemmas.join(shared, ["memory", "message_id"]).select("memory", "message_id", "unit_id", near.alias("context"))


def _posted(column):
    """(term, tf, positions) of an array of terms; an empty term has no posting but keeps its position. In Python, as it takes
    one pass there; array functions would go through the array once for each term."""

    @F.pandas_udf("array<struct<term:string,tf:int,positions:array<int>>>")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for terms in rows:
            at: dict[str, list[int]] = {}
            for i, t in enumerate(terms):
                if t:
                    at.setdefault(t, []).append(i)
            out.append([{"term": t, "tf": len(p), "positions": p} for t, p in at.items()])
        return pd.Series(out)

    return run(column)


def postings_of(units: DataFrame, known: DataFrame | None = None, n_units: int = 0, forms: Callable[[Column], Column] = normalize.forms) -> DataFrame:
    """Postings of all three fields. Context has no positions; its terms go through the lemma rules once more. known, n_units: see
    context_terms. forms: the rules, normalize.forms or normalize.lower_forms."""
    told = units.select("memory", "message_id", "unit_id", normalize.words(F.col("text")).alias("words")).withColumn("f", forms(F.col("words")))
    own = told.select("memory", "message_id", "unit_id", F.col("f.surface").alias("surface"), F.col("f.lemma").alias("lemma"))
    near = context_terms(own, known, n_units).withColumn("context", forms(F.col("context"))["lemma"]).select("memory", "unit_id", "message_id", F.lit("context").alias("field"), F.col("context").alias("terms"))
    written = own.select("memory", "unit_id", "message_id", F.explode(F.create_map(F.lit("surface"), F.col("surface"), F.lit("lemma"), F.col("lemma"))).alias("field", "terms"))
    fields = written.unionByName(near).withColumn("len", F.size(F.filter("terms", lambda t: t != ""))).where("len > 0")
    rows = fields.select("memory", "field", "unit_id", "message_id", "len", F.explode(_posted(F.col("terms"))).alias("p"))
    none = F.lit(None).cast("array<int>")
    return rows.select("memory", "field", "p.term", "unit_id", "message_id", "p.tf", F.when(F.col("field") != "context", F.col("p.positions")).otherwise(none).alias("positions"), "len")


def term_stats(postings: DataFrame) -> DataFrame:
    """Units that hold a term, for each memory and field."""
    return postings.groupBy("memory", "field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_stats(units: DataFrame, postings: DataFrame) -> DataFrame:
    """For each memory and field the number of all units and of all terms."""
    total = postings.groupBy("memory", "field").agg(F.sum("tf").cast("long").alias("total_len"))
    return total.join(units.groupBy("memory").agg(F.count(F.lit(1)).alias("n_units")), "memory")


def size_stats(units: DataFrame, postings: DataFrame) -> DataFrame:
    """FIELD_STAT rows; those of several segments add up."""
    total = postings.groupBy("memory", "field").agg(F.lit(0).cast("bigint").alias("n_units"), F.sum("tf").cast("bigint").alias("total_len"))
    return total.unionByName(units.groupBy("memory").agg(F.count(F.lit(1)).alias("n_units")).select("memory", F.lit("*").alias("field"), "n_units", F.lit(0).cast("bigint").alias("total_len")))


def layout_stats(stats: DataFrame) -> DataFrame:
    return stats.repartitionByRange("memory", "field", "term").sortWithinPartitions("memory", "field", "term")


def layout(postings: DataFrame) -> DataFrame:
    """Ranges of (memory, field, term), sorted: a query's terms are found by row-group statistics."""
    return postings.repartitionByRange("memory", "field", "term").sortWithinPartitions("memory", "field", "term", "unit_id")

"""Exact dedup by a content sort, with DataFrame functions only.

Texts are range-partitioned by sampled splitters over (first characters, digest, salt), sorted externally
inside each partition so that equals are adjacent, and each text is compared in full with its neighbour.
The salt, a hash of the id, lets a splitter fall inside a group of copies, so a group that holds a third
of all rows is spread over many partitions; the heads of its runs, at most SALTS for each text, meet in a
second, slim aggregation. Splitters are sampled from bounded keys, never from whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialise

#: Parts of a group of copies. A constant: it bounds what one text can send to the second aggregation.
SALTS = 64
#: Characters of the text that lead the sort key.
LEAD = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as the empty text, and all of those are one group. Texts are equal when identical,
    byte by byte; nothing is normalised. keep names the id that stays: "max" or "min". Rows that repeat
    an id count separately in group_size and are all kept if theirs is the id that stays. A null id never
    stays before another; a group of null ids alone has keep_id null and kept true.
    Other columns of docs are ignored, whatever their names."""
    best = F.max if keep == "max" else F.min
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "id", "text", F.substring("text", 1, LEAD).alias("lead"), F.sha2("text", 256).alias("sha"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    )
    ranged = rows.repartitionByRange("lead", "sha", "salt")
    near = Window.partitionBy("lead", "sha", "salt").orderBy("text", "id")
    runs = ranged.select("id", "lead", "sha", "salt", (~F.coalesce(F.col("text") == F.lag("text").over(near), F.lit(False))).cast("int").alias("first"), F.row_number().over(near).alias("at"))
    # the running number of distinct texts under one digest: 1 unless SHA-256 collides
    runs = runs.withColumn("run", F.sum("first").over(Window.partitionBy("lead", "sha", "salt").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    runs = materialise(runs.select("id", "lead", "sha", "salt", "run"), "sorted-runs")
    heads = runs.groupBy("lead", "sha", "salt", "run").agg(best("id").alias("best"), F.count(F.lit(1)).alias("n"))
    together = Window.partitionBy("sha", "run")  # at most SALTS heads
    whole = heads.select("sha", "run", "salt", best("best").over(together).alias("keep_id"), F.sum("n").over(together).alias("group_size"))
    return (
        runs.select("id", "sha", "salt", "run").join(whole, ["sha", "run", "salt"])
        .select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns. Of rows that repeat an id and a text one stays."""
    sha = fresh_name(docs, "sha")
    told = exact_dedup(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    keyed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    stay = keyed.join(told, (keyed[sha] == told["kept_sha"]) & keyed[id_col].eqNullSafe(told["kept_id"]), "left_semi")
    return stay.dropDuplicates([id_col, sha]).drop(sha)

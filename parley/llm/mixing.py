"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each document of a source should be taken target / size times; the whole part is sure and the rest is a
probability. Two documents with fractional probabilities transfer expected words between them, in a
random direction, until one probability is 0 or 1. The one that stays fractional meets the next. This
runs inside small blocks; each block passes at most one fractional document up to the next level, so the
residuals of a source, however large, meet in a tree of block reductions. The words taken from a source
differ from its target by less than the last residual document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh_name, materialise

#: Mean number of documents in a block of the reduction tree, and the weights that sources get in turn.
BLOCK, WEIGHTS = 128, (3.0, 1.0, 2.0)
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, size) rows.

    Water filling: the targets are min(most * size, level * weight). Sorted by most * size / weight, the
    sources below the level are at their cap; the level is what remains for the others by weight. One row
    per source reaches the single ordering task, never a document."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    per = per.withColumn("budget", share * F.sum("source_size").over(everything))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # the first source in that order whose cap isn't reached at the level that its predecessors leave fixes the level
    per = per.withColumn("level", F.when(level <= F.col("full_at"), level)).withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once; in lambdas Spark doesn't share common expressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _block_reduce(items: Column, seed: int) -> Column:
    """items: array of (key, size, p), sorted. The struct (done: array of (key, p in {0, 1}), left: the fractional one or null)."""
    none = F.expr("cast(null as struct<key:bigint,size:bigint,p:double>)")
    zero = F.struct(F.expr("cast(array() as array<struct<key:bigint,p:double>>)").alias("done"), none.alias("left"))
    one = lambda x, p: F.struct(x["key"].alias("key"), x["size"].alias("size"), p.cast("double").alias("p"))
    clean = lambda p: F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)

    def transfer(a: Column, b: Column) -> Column:
        """The two rows after the transfer: x and y."""
        ma, mb = a["size"] * a["p"], b["size"] * b["p"]
        # words that can move from a to b, and from b to a, before one of the two is integral
        room = F.struct(F.least(ma, b["size"] * (1 - b["p"])).alias("to_b"), F.least(mb, a["size"] * (1 - a["p"])).alias("to_a"))
        toss = F.pmod(F.xxhash64(a["key"], b["key"], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        # the direction's odds leave the expected words of each as they are
        moved = _let(room, lambda r: F.when(toss * (r["to_a"] + r["to_b"]) < r["to_a"], r["to_b"]).otherwise(-r["to_a"]))
        return _let(moved, lambda m: F.struct(one(a, clean((ma - m) / a["size"])).alias("x"), one(b, clean((mb + m) / b["size"])).alias("y")))

    def meet(state: Column, b: Column) -> Column:
        def settle(two: Column) -> Column:
            pair = F.array(two["x"], two["y"])
            whole = lambda r: (r["p"] == 0.0) | (r["p"] == 1.0)
            done = F.transform(F.filter(pair, whole), lambda r: F.struct(r["key"].alias("key"), r["p"].alias("p")))
            return F.struct(F.concat(state["done"], done).alias("done"), F.try_element_at(F.filter(pair, lambda r: ~whole(r)), F.lit(1)).alias("left"))

        return F.when(state["left"].isNull(), F.struct(state["done"].alias("done"), one(b, b["p"]).alias("left"))).otherwise(_let(transfer(state["left"], b), settle))

    return F.aggregate(items, zero, meet)


def pivotal_round(rows: DataFrame, seed: int) -> DataFrame:
    """(source, key, size, p) with 0 < p < 1 and size > 0 to (key, p in {0, 1}).

    Blocks are dealt by a hash of the key, so reruns agree and a hot source has more blocks, not larger
    ones. Long documents meet first, so that the residual is short. At the top, where a
    source has one fractional row left, that row is rounded to the nearer side."""
    done, level = [], 0
    rows = rows.select("source", F.col("key").cast("long").alias("key"), F.col("size").cast("long").alias("size"), "p")
    while True:
        counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
        dealt = rows.join(counts.withColumnRenamed("source", "s"), rows["source"].eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed + level)), blocks))
        met = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("last"), "key", "size", "p"))).alias("items"))
        met = materialise(met.select("source", _block_reduce(F.col("items"), seed + level).alias("r")), "pivotal")
        done.append(met.select(F.explode("r.done").alias("d")).select("d.key", "d.p"))
        rows, level = met.where("r.left is not null").select("source", "r.left.key", "r.left.size", "r.left.p"), level + 1
    out = rows.select("key", (F.col("p") >= 0.5).cast("double").alias("p"))
    for part in done:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken.

    size counts the words of the text (null or empty text: 0, taken 0). The null source is a source, the
    last in order. Rows that repeat an id are separate documents with separate decisions. A source without
    words has target 0. Of an empty table nothing comes. Other columns are ignored. Reruns agree as long as
    rows that repeat an id have different sizes or are interchangeable."""
    slim = docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"))
    # a number for each row: a hash of its id, told apart among rows that repeat one
    nth = F.row_number().over(Window.partitionBy("id", "source", "spread").orderBy("size"))
    slim = slim.withColumn("spread", F.pmod(F.xxhash64("size"), F.lit(64)))  # null ids may be many
    slim = materialise(slim.withColumn("key", F.xxhash64("id", "source", "spread", nth)).drop("spread"), "mix-sizes")
    targets = source_targets(slim, share, most, weights).withColumnRenamed("source", "s")
    rated = slim.join(F.broadcast(targets) if slim.select("source").distinct().count() <= 10_000 else targets, slim["source"].eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = rated.withColumn("sure", F.floor(rate + EPS)).withColumn("p", F.greatest(rate - F.col("sure"), F.lit(0.0)))
    fractional = rated.where((F.col("p") > EPS) & (F.col("size") > 0)).select("source", "key", "size", "p")
    extra = pivotal_round(fractional, seed).withColumnRenamed("p", "extra")
    copies = (F.col("sure") + F.coalesce(F.col("extra"), F.lit(0.0))).cast("long")
    return rated.join(extra, "key", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """docs with each row as many times as mix takes it, their columns as they were. Rows that agree in id and size are taken
    equally often, null ids included; documents without words are taken as often as is sure for their source. Of an empty table nothing comes."""
    size, n = fresh_name(docs, "size"), fresh_name(docs, "n")
    told = mix(docs, id_col, text_col, source_col, **more).groupBy(F.col(id_col).alias("mix_id"), F.col("size").alias("mix_size")).agg(F.max("copies").alias("mix_copies")).where("mix_copies > 0")
    rows = docs.withColumn(size, word_count(F.col(text_col)))
    joined = rows.join(told, rows[id_col].eqNullSafe(told["mix_id"]) & (rows[size] == told["mix_size"]))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), told["mix_copies"].cast("int")))).select(*[rows[c] for c in docs.columns])

"""Components of the similar members of buckets, without all pairs of a bucket.

Members of small buckets are paired, those of others are paired with a few hubs of the bucket. Members of those others
that are then in different components meet in blocks of slim rows. A meeting passes on a few candidates for
each member and foreign component; more are asked for, MORE times as many each time, until a member has joined the
component or no candidate remains. So no link between different components is lost, and a group of near copies
costs about as many comparisons as it has members.

Where whole rows are small enough to meet, they are compared there: they are dealt into finer buckets, one of which any two
that are linked share, and one round gives the links between components, of each two blocks a forest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .graph import components, extended, forest

#: Hubs of a bucket, rows of a block, candidates that a member and a foreign component have at first, and how many times as
#: many in the next round.
HUBS, BLOCK, FIRST, MORE = 2, 512, 4, 8


def pair(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


@dataclass
class Buckets:
    """members: (token, m, key, *extra), m the number of keys in the bucket `token`, more than 1. could and possible tell from two
    members' extra values whether they could be similar, as Columns and as arrays (a column and a row). verified keeps of
    distinct pairs (a, b), a < b, those that are linked. small: rows of a small bucket. sketches gives (key, sketch) of the keys
    asked for; close tells from the rows of two arrays of sketches, and the members' n, whether they could be similar.
    Or instead of these two: fine gives finer buckets (token, key) of some rows (token, key); whole gives (key, n, s), s numbers
    of 32 bits; linked tells from the rows of two arrays of these whether they are linked. Both are called after verified."""

    members: DataFrame
    verified: Callable[[DataFrame], DataFrame]
    could: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
    possible: Callable[[dict, dict], np.ndarray]
    extra: tuple[str, ...]
    small: int = 8
    sketches: Callable[[DataFrame], DataFrame] | None = None
    close: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None
    block: int = field(default_factory=lambda: BLOCK)
    fine: Callable[[DataFrame], DataFrame] | None = None
    whole: Callable[[], DataFrame] | None = None
    linked: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def components(self) -> DataFrame:
        """(node, component) of the keys that link."""
        one, two = (self.members.where(F.col("m") <= self.small).select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("key", *self.extra)]) for s in "ab")
        side = lambda s: lambda c: F.col(f"{c}_{s}")
        pairs = one.join(two, "token").where((F.col("key_a") < F.col("key_b")) & self.could(side("a"), side("b"))).select(*pair("key_a", "key_b"))
        large = self.members.where(F.col("m") > self.small)
        slots = [F.min(F.when(F.pmod("key", F.lit(HUBS)) == j, F.struct("key", *self.extra))) for j in range(HUBS)]
        hubs = large.groupBy("token").agg(F.array_compact(F.array(*slots)).alias("hubs"))
        hubs = large.join(hubs, "token").select("key", *self.extra, F.explode("hubs").alias("hub")).where(F.col("hub.key") != F.col("key"))
        pairs = pairs.union(hubs.where(self.could(F.col, lambda c: F.col(f"hub.{c}"))).select(*pair("key", "hub.key")))
        done = materialise(pairs.distinct(), "bucket-pairs")
        parts, most = components(self.verified(done)), FIRST
        if self.linked is not None:
            return materialise(extended(parts, components(self.met(large, parts, 0))), "bucket-parts")
        while True:
            found = self.met(large, parts, most)
            more = not found.where("more").isEmpty()
            fresh = materialise(found.select(*pair("x", "y")).distinct().join(done, ["a", "b"], "left_anti"), "bucket-pairs")
            if fresh.isEmpty() and not more:
                return parts
            new = self.verified(fresh)
            joined = found.select(*pair("x", "y"), "cx", "cy").join(new, ["a", "b"]).select(F.col("cx").alias("a"), F.col("cy").alias("b"))
            parts = materialise(extended(parts, components(materialise(joined.distinct(), "bucket-links"))), "bucket-parts")
            done = done.unionByName(fresh)
            if not more:
                return parts
            most *= MORE

    def met(self, large: DataFrame, parts: DataFrame, most: int) -> DataFrame:
        """Candidates (x, y, their components, more) between different components in the buckets of `large`; or (a, b) of
        components between which there are links."""
        exact = self.linked is not None
        columns = ("key", "comp", *self.extra, "far", *(["n", "s"] if exact else ["sketch"] if self.sketches is not None else []))
        where = large.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key"))
        where = materialise(where.select("token", "key", "comp", *self.extra), "bucket-open")
        several = _several(where)
        if exact:
            where = where.join(several.select("token"), "token")
            keys = materialise(where.select("key", "comp", *self.extra).distinct(), "bucket-keys")
            where = materialise(keys.select("key", "comp").join(self.fine(where.select("token", "key")), "key"), "bucket-fine")
            several = _several(where)
        # far: not of the bucket's largest component
        rows = where.join(several.select("token", "m", F.col("main.comp").alias("main")), "token").withColumn("far", F.col("comp") != F.col("main"))
        if exact:
            rows = rows.join(keys.drop("comp"), "key").join(self.whole(), "key")
        elif self.sketches is not None:
            rows = rows.join(self.sketches(rows.select("key").distinct()), "key")
        rows = rows.withColumn("parts", F.ceil(F.col("m") / self.block).cast("int")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        blocks = rows.groupBy("token", "parts", "part").agg(F.collect_list(F.struct(*columns)).alias("b"))
        blocks = materialise(blocks.withColumn("any", F.exists("b", lambda x: x["far"])), "bucket-blocks")
        told = lambda s: [F.col(f"b.{c}").alias(f"{c}_{s}") for c in columns]
        # a block with far members is sent to each block of its bucket: the join's keys are blocks, so a hot bucket spreads
        one = blocks.where("any").select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *told("a"))
        met = one.join(blocks.select("token", "part", *told("b")), ["token", "part"]).drop("token", "part")
        possible, close, linked = self.possible, self.close, self.linked  # self isn't sent to the tasks
        if exact:
            return materialise(met.mapInArrow(_meetings(columns, ["a", "b"], lambda a, b: links(a, b, possible, linked)), "a bigint, b bigint"), "bucket-links")
        names = ["x", "y", "cx", "cy", "more"]
        return materialise(met.mapInArrow(_meetings(columns, names, lambda a, b: meet(a, b, possible, most, close)), "x bigint, y bigint, cx bigint, cy bigint, more boolean"), "bucket-met")


def _several(where: DataFrame) -> DataFrame:
    """(token, main, comps, m): the largest component, how many, and the members, of the buckets that have several components."""
    per = where.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("k").alias("m")).where("comps > 1")


def closest(close, a: dict, b: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """close() of pairs of rows, some at a time. Without n the sketches' sums count."""
    size_a, size_b = (d["n"] if "n" in d else d["sketch"].sum(axis=1, dtype=np.int64) for d in (a, b))
    step = 4096
    parts = [close(a["sketch"][x[i : i + step]], b["sketch"][y[i : i + step]], size_a[x[i : i + step]], size_b[y[i : i + step]]) for i in range(0, len(x), step)]
    return np.concatenate([np.zeros(0, bool), *parts])


def apart(a: dict, b: dict, possible: Callable[[dict, dict], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the far members of one block and those of another that are of different components and could be similar."""
    far = np.flatnonzero(a["far"])
    ok = possible({c: v[far][:, None] for c, v in a.items() if v.ndim == 1}, {c: v[None, :] for c, v in b.items() if v.ndim == 1})
    x, y = np.nonzero(ok & (a["comp"][far][:, None] != b["comp"][None, :]))
    return far[x], y


def links(a: dict, b: dict, possible: Callable[[dict, dict], np.ndarray], linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """A forest of links between components: of those that links between two blocks join, one fewer."""
    x, y = apart(a, b, possible)
    kept = [np.zeros(0, bool)] + [linked(a["s"][x[i : i + 4096]], b["s"][y[i : i + 4096]]) for i in range(0, len(x), 4096)]
    kept = np.concatenate(kept)
    node, root = forest(a["comp"][x[kept]], b["comp"][y[kept]])
    return node[node != root], root[node != root]


def meet(a: dict, b: dict, possible: Callable[[dict, dict], np.ndarray], most: int, close=None) -> tuple[np.ndarray, ...]:
    """Candidates between the far members of one block of a bucket and all of another: (x, y, component of x, of y, more).
    `more` marks the last of a member and a foreign component of which there are more than `most`."""
    x, y = apart(a, b, possible)
    if close is not None:
        kept = closest(close, a, b, x, y)
        x, y = x[kept], y[kept]
    order = np.lexsort((b["key"][y], b["comp"][y], x))
    x, y = x[order], y[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (b["comp"][y[1:]] != b["comp"][y[:-1]])
    nth = np.arange(len(x)) - np.maximum.accumulate(np.where(fresh, np.arange(len(x)), 0)) if len(x) else x
    more = np.zeros(len(x), bool)
    more[:-1] = (nth[:-1] == most - 1) & ~fresh[1:]
    keep = nth < most
    x, y = x[keep], y[keep]
    return a["key"][x], b["key"][y], a["comp"][x], b["comp"][y], more[keep]


def _meetings(columns: tuple[str, ...], names: list[str], told: Callable[[dict, dict], tuple[np.ndarray, ...]]):
    def read(name: str, values: pa.Array) -> np.ndarray:
        if pa.types.is_binary(values.type):
            return np.frombuffer(b"".join(values.to_pylist()), np.uint32 if name == "s" else np.uint16).reshape(len(values), -1)
        return values.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = ({c: read(c, batch.column(f"{c}_{s}")[r].values) for c in columns} for s in "ab")
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in told(a, b)], names)

    return run

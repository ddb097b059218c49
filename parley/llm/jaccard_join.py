"""N-gram Jaccard join with several global orders of the shingles.

If two sets are similar, their prefixes under any one order of all shingles share a shingle. Three orders are
used, each with frequent shingles last and its own hash order within a frequency class. Classes come from hashed
counts over all documents; shingles that are still in more than HEAVY prefixes then go to the very end, so that what
many documents quote doesn't make them candidates. Candidates share a prefix shingle under the first order, at places
that allow the similarity; those that don't share one under each of the others are dropped before whole sets
are compared.

Equal sets collapse first. Only components are asked for, so the members of a bucket are joined as in buckets.py: by
hubs, then between what is still apart, until nothing similar is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import Buckets
from .common import materialise, release
from .wordhash import groups, mix64, shingles, texts_words

#: The most ids, of 16 bytes, that are broadcast.
SENT = 200_000
#: Bits of the hashed counts, orders besides the first, rows of a small bucket, rows of a block.
COUNT_BITS, MORE_ORDERS, SMALL, BLOCK = 15, (0x51ED270B, 0x2545F491), 8, 512
#: Prefixes from which on a shingle is heavy, and the most shingles, of 8 bytes, that are kept as such: the heaviest. Both
#: only shape the order; any order gives the same result.
HEAVY, MOST_HEAVY = 32, 1 << 18
#: Sets that a task passes on at once.
PASSED = 256
#: Cells of a sketch: how many shingles of a set each cell has. From SKETCHED shingles on a sketch tells nothing.
CELLS, SKETCHED = 128, 1 << 16
#: The bit of an order that is set for heavy shingles.
LAST = np.uint64(1 << 63)


def _sets(texts: list[str | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time, in order: their sorted distinct shingle hashes, and where each text's begin and end."""
    for i, j in groups(texts):
        words, at = texts_words(texts[i:j])
        every = shingles(words, width)
        parts = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            # a short text is one shingle; those that reach into the next text are left out
            parts.append(np.sort(every[a : b - width + 1]) if b - a >= width else shingles(words[a:b], width))
        size = np.array([len(p) for p in parts])
        flat = np.concatenate(parts)
        doc = np.repeat(np.arange(len(parts)), size)
        fresh = np.ones(len(flat), bool)
        fresh[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
        yield flat[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=len(parts)))])


def _keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits that stand for each set; sums don't depend on order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)])
    return mix64(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).astype(np.int64)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    flat = np.concatenate([np.zeros(0, kind), *parts]).astype(kind, copy=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(flat))


def _profile(width: int):
    """(id, at, key, n) rows of documents and (bucket, count) rows of each task's shingles."""
    names = ["id", "at", "key", "n", "bucket", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, at in _sets(b.column("text").to_pylist(), width):
                keys.append(_keys(s, at))
                sizes.append(np.diff(at))
                total += np.bincount((s >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)), none, none], names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64())] * 4 + [pa.array(at), pa.array(total[at])], names)

    return run


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Class 0: no bucket of frequent shingles; then by doublings of the excess over the usual count."""
    usual = np.median(counts)
    excess = np.maximum(counts - usual - 6 * np.sqrt(usual + 1), 0)
    return np.minimum(np.where(excess > 0, 1 + np.log2(excess + 1), 0), 31).astype(np.uint64)


def _order(s: np.ndarray, classes: np.ndarray, heavy: np.ndarray, seed: int) -> np.ndarray:
    """The place of each shingle in the global order of this seed: heavy ones last, then by class, then by hash."""
    o = classes[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] << np.uint64(58)
    if len(heavy):
        o[heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s] |= LAST
    return o | (mix64(s ^ np.uint64(seed)) >> np.uint64(6))


def _sketches(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    size = np.diff(at)
    cell = np.repeat(np.arange(len(size)), size) * CELLS + (s >> np.uint64(20) & np.uint64(CELLS - 1)).astype(np.int64)
    out = np.bincount(cell, minlength=len(size) * CELLS).reshape(len(size), CELLS)
    out[size >= SKETCHED] = 0xFFFF
    return out.astype(np.uint16)


def close(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these sketches and sizes could be similar: in each cell they share the lesser number at most."""
    shared = np.minimum(np.minimum(a, b).sum(axis=1, dtype=np.int64), np.minimum(n_a, n_b))
    return shared * 100 >= percent * (n_a + n_b - shared)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(width: int, percent: int, shared):
    """(key, n, p, sketch) of documents with words; p: the places of their prefix shingles in the first order, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        classes, heavy = shared.value
        for b in batches:
            for s, at in _sets(b.column("text").to_pylist(), width):
                order, full, parts = _order(s, classes, heavy, 0), np.diff(at) > 0, []
                for i, j in zip(at[:-1][full], at[1:][full], strict=True):
                    p = prefix_size(int(j - i), percent)
                    parts.append(np.sort(np.partition(order[i:j], p - 1)[:p]))
                sketches = pa.array([row.tobytes() for row in _sketches(s, at)[full]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_keys(s, at)[full]), pa.array(np.diff(at)[full]), _lists(parts, np.int64), sketches], ["key", "n", "p", "sketch"])

    return run


def _often(width: int, percent: int, shared):
    """The prefix shingles of each document under the first order, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        classes, heavy = shared.value
        for b in batches:
            for s, at in _sets(b.column("text").to_pylist(), width):
                order, parts = _order(s, classes, heavy, 0), [np.zeros(0, np.uint64)]
                for i, j in zip(at[:-1], at[1:], strict=True):
                    if i < j:
                        p = prefix_size(int(j - i), percent)
                        parts.append(s[i:j][np.argpartition(order[i:j], p - 1)[:p]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).astype(np.int64))], ["shingle"])

    return run


def _plausible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            if not b.num_rows:
                continue
            a_, b_ = (np.frombuffer(b"".join(b.column(f"sketch_{s}").to_pylist()), np.uint16).reshape(b.num_rows, CELLS) for s in "ab")
            kept = pa.array(close(a_, b_, b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), percent))
            yield b.select(["a", "b"]).filter(kept)

    return run


def _whole(width: int, percent: int, shared):
    """(key, n, p2, p3, s): the sets of rows (key, text) whose text has that key, and their prefixes under the other orders."""

    def told(rows: list) -> pa.RecordBatch:
        keys, sets, prefixes = zip(*rows, strict=True)
        columns = [pa.array(np.array(keys, np.int64)), pa.array(np.array([len(s) for s in sets], np.int64))]
        columns += [_lists([p[k] for p in prefixes], np.int32) for k in range(len(MORE_ORDERS))]
        return pa.RecordBatch.from_arrays([*columns, _lists([s.astype(np.int64) for s in sets], np.int64)], ["key", "n", "p2", "p3", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        classes, heavy = shared.value
        for b in batches:
            rows, size, asked = [], 0, b.column("key").to_numpy()
            for s, at in _sets(b.column("text").to_pylist(), width):
                keys = _keys(s, at)
                orders = [_order(s, classes, heavy, seed) for seed in MORE_ORDERS]
                for k, want, i, j in zip(keys, asked, at[:-1], at[1:]):
                    if k == want and i < j:
                        p = prefix_size(int(j - i), percent)
                        rows.append((k, s[i:j], [np.partition(o[i:j], p - 1)[:p].astype(np.uint32).astype(np.int32) for o in orders]))
                        size += j - i
                asked = asked[len(keys) :]
                if len(rows) >= PASSED or size >= PASSED << 10:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    return run


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.width, self.percent, self.spark = width, percent, docs.sparkSession
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("at", F.xxhash64("id", "text"))
        told = materialise(self.rows.mapInArrow(_profile(width), "id bigint, at bigint, key bigint, n bigint, bucket bigint, count bigint"), "ngram-profile")
        self.docs = told.where("bucket is null").select("id", "at", "key", "n")
        counts = np.zeros(1 << COUNT_BITS)
        for r in told.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("c")).collect():  # at most 2 ** COUNT_BITS rows
            counts[r.bucket] = r.c
        classes, none = frequency_classes(counts), np.zeros(0, np.uint64)
        shared = self.spark.sparkContext.broadcast((classes, none))
        often = self.rows.select("text").mapInArrow(_often(width, percent, shared), "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("m"))
        # at most MOST_HEAVY numbers
        heavy = often.where(F.col("m") > HEAVY).orderBy(F.desc("m"), "shingle").limit(MOST_HEAVY).select("shingle").toArrow()["shingle"].to_numpy()
        self.shared = self.spark.sparkContext.broadcast((classes, np.sort(heavy.astype(np.uint64))))
        every = self.rows.select("text").mapInArrow(_prefixes(width, percent, self.shared), "key bigint, n bigint, p array<bigint>, sketch binary")
        self.prefixes = materialise(every.dropDuplicates(["key"]), "ngram-prefixes")
        #: Of each set: the row that stays of those that have it; null ids come last.
        self.first = self.docs.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "at")).alias("best"))
        self.sets: DataFrame | None = None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b), a < b. Sketches tell which need not be compared; those that share no
        prefix shingle under one of the other orders don't reach the comparison of whole sets either."""
        side = lambda s: self.prefixes.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
        pairs = materialise(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_plausible(self.percent), "a bigint, b bigint"), "ngram-plausible")
        asked = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            asked = asked.join(self.sets, "key", "left_anti")
        asked = materialise(asked.join(self.first, "key").select("key", "best.at"), "ngram-asked")
        # few ids are sent to the texts; many meet them in a shuffle
        asked = F.broadcast(asked) if asked.count() <= SENT else asked
        got = self.rows.join(asked, "at").select("key", "text").mapInArrow(_whole(self.width, self.percent, self.shared), "key bigint, n bigint, p2 array<int>, p3 array<int>, s array<bigint>")
        got = materialise(got, "ngram-sets")
        # only rows that are equal in id and text give a set twice
        if not got.groupBy("key").count().where("count > 1").isEmpty():
            got = materialise(got.dropDuplicates(["key"]), "ngram-sets")
        self.sets = got if self.sets is None else self.sets.unionByName(got)
        side = lambda s, *some: self.sets.select(F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in some])
        kept = pairs.join(side("a", "p2", "p3"), "a").join(side("b", "p2", "p3"), "b").where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))
        both = kept.select("a", "b").join(side("a", "n", "s"), "a").join(side("b", "n", "s"), "b")
        same = F.size(F.array_intersect("s_a", "s_b"))
        return materialise(both.where(same * 100 >= self.percent * (F.col("n_a") + F.col("n_b") - same)).select("a", "b"), "ngram-verified")

    def components(self) -> DataFrame:
        """(node, component) of the keys that link."""
        postings = self.prefixes.select("key", "n", F.posexplode("p").alias("i", "token"))
        shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        members = materialise(postings.join(shared, "token").select("token", "m", "key", "n", "i"), "ngram-members")
        percent = self.percent

        def could(x, y) -> Column:
            need = F.ceil(F.lit(percent) * (x("n") + y("n")) / (100 + percent))
            return (F.least(x("n"), y("n")) >= need) & (x("i") <= x("n") - need) & (y("i") <= y("n") - need)

        def possible(a: dict, b: dict) -> np.ndarray:
            """If this shingle is the first that the two have in common, those before it are lacking in the other set."""
            need = -(-percent * (a["n"] + b["n"]) // (100 + percent))
            return (np.minimum(a["n"], b["n"]) >= need) & (a["i"] <= a["n"] - need) & (b["i"] <= b["n"] - need)

        near = lambda a, b, n_a, n_b: close(a, b, n_a, n_b, percent)
        return Buckets(members, self.verified, could, possible, ("n", "i"), SMALL, lambda keys: self.prefixes.select("key", "sketch"), near, BLOCK).components()

    def told(self) -> DataFrame:
        """(id, at, n, best) of each document: the row that stays of its component."""
        parts = self.components()
        first = self.first.join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "best", F.coalesce("component", "key").alias("component"))
        least = first.groupBy("component").agg(F.min("best").alias("best"))
        known = first.select("key", "component").join(least, "component").select("key", "best")
        return self.docs.join(known, "key", "left").select("id", "at", "n", F.coalesce("best", F.struct(F.col("id").isNull().alias("last"), "id", "at")).alias("best"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; a set has the distinct runs of `width`
    words, or the whole sequence of a shorter text. Null, empty and blank texts have no set (n_shingles 0),
    link with nothing and are their own component. Two documents link when 100 * intersection >=
    percent * union. Components span all links; component_id is the smallest id reachable. Rows that repeat
    an id are compared each by its text and get the component of that text. Rows without an id are compared like others;
    component_id is null only in a component of such rows. Of an empty table nothing comes. Whole texts are read.
    Shingles are compared by 64-bit hashes."""
    told = _Join(docs, id_col, text_col, width, percent).told()
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("best.id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """jaccard_components with row, the hash of id and text, and kept: of each component the row with the smallest id
    stays, null ids after others, and of several such rows the one with the least hash; rows that are equal in id and text
    stay or go together. Documents without words are each a component, so they stay."""
    told = _Join(docs, id_col, text_col, width, percent).told()
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("at") == F.col("best.at"))
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("best.id").alias("component_id"), F.col("at").alias("row"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    gone = materialise(near_duplicates(docs, id_col, text_col, width, percent).where("not kept").select(F.col(id_col).alias("gone_id"), F.col("row").alias("gone_row")), "near-gone")
    row = F.xxhash64(docs[id_col].cast("long"), docs[text_col])
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["gone_id"]) & (row == gone["gone_row"]), "left_anti")

"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A hash of a unit vector is the signed axis that lies nearest after a pseudo-random rotation: three times
random signs, then a fast Hadamard transform. A table joins HASHES such hashes. Every vector is stored in
its own bucket and probes the next nearest buckets, in which one hash takes its second axis. Buckets are
cut into blocks of at most about BLOCK rows; blocks of a bucket meet in pairs, and a pair of vectors is
compared, by its exact cosine in double precision, inside the meeting. Equal vectors collapse first.

A pair may meet in several buckets; it counts in the first of them, which both vectors' bucket lists tell. A meeting
passes on how many links each vector has there, and only as many links as join its components, so a group of near
copies doesn't become all its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .graph import components, forest

TABLES, HASHES, PROBES, BLOCK = 8, 2, 2, 512


def _signs(dim: int, seed: int) -> np.ndarray:
    """Signs of the rotations: (table, hash, 3, dim)."""
    return np.random.default_rng(seed).integers(0, 2, (TABLES, HASHES, 3, dim)) * 2.0 - 1.0


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, scaled to keep lengths; their number of columns is a power of 2."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def bucket_keys(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows to (keys: rows x TABLES, probes: rows x TABLES x PROBES)."""
    dim = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    signs = _signs(dim, seed)
    keys, probes = np.zeros((len(x), TABLES), np.int64), np.zeros((len(x), TABLES, PROBES), np.int64)
    rows = np.arange(len(x))
    for t in range(TABLES):
        own, other, loss = [], [], []
        for k in range(HASHES):
            y = x
            for r in range(3):
                y = hadamard(y * signs[t, k, r])
            size = np.abs(y)
            best = size.argmax(axis=1)
            top = size[rows, best]
            size[rows, best] = -1
            second = size.argmax(axis=1)
            axis = lambda a: 2 * a + (y[rows, a] > 0)  # noqa: B023, E731
            own.append(axis(best))
            other.append(axis(second))
            loss.append(top - size[rows, second])
        key = lambda parts: np.ravel_multi_index(tuple(parts), (2 * dim,) * HASHES)  # noqa: B023, E731
        keys[:, t] = key(own)
        for p, k in enumerate(np.argsort(np.stack(loss), axis=0)[:PROBES]):
            probes[:, t, p] = key([np.where(k == i, other[i], own[i]) for i in range(HASHES)])
    return keys, probes


def _hash_batches(seed: int):
    """(ck, label, dim, slots): slots has the bucket of each table, then its probes, table by table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            for size, part in b.groupby(b.v.map(len)):  # rows of one length can be compared
                keys, probes = bucket_keys(_unit(part.v), seed)
                slots = np.concatenate([keys[:, :, None], probes], axis=2).reshape(len(part), -1)
                yield pd.DataFrame({"ck": part.ck.to_numpy(), "label": part.label.to_numpy(), "dim": np.full(len(part), size), "slots": list(slots)})

    return run


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact; squares of large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def first_meeting(a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether this bucket is the first in which the vectors with slots a and b meet, pair by pair. Vectors meet in a bucket
    if it is the own one of at least one of them."""
    a, b = (s.reshape(len(s), TABLES, 1 + PROBES) for s in (a, b))
    at_a, at_b = (a[:, :, :1] == b).any(axis=2), (b[:, :, :1] == a).any(axis=2)  # in a's own bucket, in b's own
    place = np.minimum(np.where(at_a, a[:, :, 0], np.iinfo(np.int64).max), np.where(at_b, b[:, :, 0], np.iinfo(np.int64).max))
    met = at_a | at_b
    return (met.argmax(axis=1) == table) & (place[:, table] == bucket)


def _meet(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                at = lambda c: batch.column(c)[r]  # noqa: B023, E731
                table, bucket, same = at("table").as_py(), at("bucket").as_py(), at("same").as_py()
                side = {}
                for s in "ab":
                    n = len(at(f"ck_{s}").values)
                    flat = lambda c: at(f"{c}_{s}").values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    side[s] = flat("ck"), _unit(flat("v").reshape(n, -1)), flat("slots").reshape(n, -1), flat("copies")
                (ka, va, sa, ca), (kb, vb, sb, cb) = side["a"], side["b"]
                near = va @ vb.T >= least
                if same:
                    near &= ka[:, None] < kb[None, :]
                x, y = np.nonzero(near)
                here = first_meeting(sa[x], sb[y], table, bucket)
                x, y = x[here], y[here]
                if not len(x):
                    continue
                # links of each vector here, and what joins the components
                nodes, back = np.unique(np.concatenate([ka[x], kb[y]]), return_inverse=True)
                many = np.bincount(back, np.concatenate([cb[y], ca[x]]), len(nodes)).astype(np.int64)
                joined, roots = forest(ka[x], kb[y])
                off = joined != roots
                none = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([pa.array(nodes), pa.array(joined[off])]), pa.concat_arrays([none(len(nodes)), pa.array(roots[off])]), pa.concat_arrays([pa.array(many), none(int(off.sum()))]),
                ], ["a", "b", "links"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, seed: int = 5) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least
    `least`. Null vectors, zero ones and those with null or non-finite components link with nothing, nor do
    vectors of different lengths: n_links 0, component_id their own id, kept. Rows that repeat an id are separate
    vectors: they link if their label and vectors allow it. A null id never stays before another; component_id
    is null only where all of a component are. Of an empty table nothing comes; other columns are ignored."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable").select("id", "label", "v", F.xxhash64("label", "v").alias("ck"))
    # equal vectors of a label are one class
    classes = materialise(good.groupBy("ck", "label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "vec-classes")
    kind = classes.schema["v"].dataType.elementType.simpleString()
    keyed = materialise(classes.select("ck", "label", "v").mapInPandas(_hash_batches(seed), f"ck bigint, label {classes.schema['label'].dataType.simpleString()}, dim bigint, slots array<bigint>"), "vec-slots")
    place = ["label", "dim", "table", "bucket"]
    every = keyed.select("ck", "label", "dim", F.posexplode("slots").alias("i", "bucket")).select("ck", "label", "dim", "bucket", F.floor(F.col("i") / (1 + PROBES)).cast("int").alias("table"), (F.col("i") % (1 + PROBES) == 0).alias("own"))
    sizes = every.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned")).where("n > 1 and owned").drop("owned")
    dealt = every.join(sizes, place).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("ck"), F.col("parts")).cast("int"))
    dealt = materialise(dealt.select("ck", *place, "parts", "part"), "vec-dealt")
    member = classes.select("ck", "v", "copies").join(keyed.select("ck", "slots"), "ck")
    blocks = dealt.join(member, "ck").groupBy(*place, "parts", "part").agg(F.collect_list(F.struct("ck", "v", "slots", "copies")).alias("m"))
    # flat arrays: a block is four of them
    blocks = materialise(blocks.select(*place, "parts", "part", F.col("m.ck").alias("ck"), F.flatten("m.v").cast(f"array<{kind}>").alias("v"), F.flatten("m.slots").alias("slots"), F.col("m.copies").alias("copies")), "vec-blocks")
    told = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("ck", "v", "slots", "copies")]
    # a meeting for each pair of blocks; the join's keys are blocks, so a hot bucket spreads
    one = blocks.select(*place, F.col("part").alias("from"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("part"), *told("a"))
    met = one.join(blocks.select(*place, "part", *told("b")), [*place, "part"]).withColumn("same", F.col("from") == F.col("part")).drop("label", "dim", "from", "part")
    found = materialise(met.mapInArrow(_meet(least), "a bigint, b bigint, links bigint"), "vec-links")
    linked = found.where("links is not null").groupBy(F.col("a").alias("ck")).agg(F.sum("links").alias("far"))
    parts = components(found.where("links is null").select("a", "b")).select(F.col("node").alias("ck"), "component")
    named = classes.join(linked, "ck", "left").join(parts, "ck", "left").select("ck", "least", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "ck").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(smallest, "component").select("ck", "n_links", "component_id")
    known = good.select("id", "ck").join(told, "ck").select("id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

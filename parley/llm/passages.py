"""Substring dedup: paragraph MinHash banding over content-defined paragraphs.

A passage may be copied into the middle of another line, so line breaks can't bound what is compared. The
paragraphs are runs of PARAGRAPH words that start at anchors: a word run of five whose hash is the least
among GAP neighbours. Copies of a passage of PARAGRAPH + GAP - 1 words or more have the same anchors inside
and thus share a whole paragraph, wherever the passage stands.

Equal paragraphs collapse to classes. Each class has BANDS bands of ROWS MinHashes each over its runs of five words; the
least similarity of 0.8 or more that two paragraphs can have (25 of 31 runs) is met by a band with odds of 0.957, the next
(26 of 30) of 0.985, and a passage has more than one paragraph. Only buckets of several documents are compared. Similar
paragraphs differ in at most APART runs, so 64 bits, one set for each run, tell of nearly all unlike ones that they need no
comparison, and the members of large buckets are dealt anew by the hashes of parts of their runs, one more than can differ,
so that two similar ones have one in common. What then meets is verified by its exact Jaccard similarity and joined to components as in
buckets.py, which loses no link between the members of a bucket. The first paragraph of a component stays, the others are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import Buckets
from .common import fresh_name, materialise
from .wordhash import BASE, groups, mix64, texts_words

#: Words of a paragraph, words of a shingle, anchor distance, least similarity in percent, rows of a small bucket.
PARAGRAPH, WIDTH, GAP, PERCENT, SMALL = 32, 5, 20, 80, 8
#: Bands, and the MinHashes of a band.
BANDS, ROWS = 3, 2
RUNS = PARAGRAPH - WIDTH + 1  # shingles of a paragraph
#: The most shingles that are in one only of two similar paragraphs: of 2 * RUNS together at most, and half of the rest is shared.
APART = 2 * RUNS * (100 - PERCENT) // (100 + PERCENT)
SEEDS = tuple(mix64(np.arange(1, 1 + BANDS * ROWS, dtype=np.uint64)).tolist())


def _slide(x: np.ndarray, size: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over x[i : i + size]."""
    step, out = 1, x
    while 2 * step <= size:
        out = of(out[:-step], out[step:])
        step *= 2
    return of(out[: len(out) - (size - step)], out[size - step :]) if size > step else out


def paragraphs(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(text number, first word, hash, bands, first word in the batch, shingle hashes of the batch) of the paragraphs of the
    texts, each different paragraph of a text once, at its first place."""
    words, at = texts_words(texts)
    empty = np.zeros(0, np.int64)
    if len(words) < PARAGRAPH:
        return empty, empty, empty, np.zeros((0, BANDS), np.int64), empty, np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    run = np.zeros(len(words) - WIDTH + 1, np.uint64)
    for i in range(WIDTH):
        run = mix64(run * BASE + words[i : i + len(run)])
    # the least of GAP neighbours; 0 where the neighbours are of two texts, so those choose no anchor
    least = _slide(run, GAP, np.minimum)
    least[doc[: len(least)] != doc[GAP + WIDTH - 2 : GAP + WIDTH - 2 + len(least)]] = 0
    padded = np.concatenate([np.zeros(GAP - 1, np.uint64), least, np.zeros(GAP - 1, np.uint64)])
    anchor = np.flatnonzero(_slide(padded, GAP, np.maximum) == run)
    anchor = anchor[anchor + PARAGRAPH <= at[doc[anchor] + 1]]
    whole, step = words, 1
    while step < PARAGRAPH:
        whole = mix64(whole[:-step] * BASE + whole[step:])
        step *= 2
    bands = np.zeros((len(anchor), BANDS), np.uint64)
    for k, seed in enumerate(SEEDS):
        least = _slide(mix64(run ^ np.uint64(seed)), PARAGRAPH - WIDTH + 1, np.minimum)[anchor]
        bands[:, k // ROWS] = mix64(bands[:, k // ROWS] * BASE + least + np.uint64(k))
    key = mix64(whole[anchor])
    once = np.unique(np.stack([doc[anchor].astype(np.uint64), key], axis=1), axis=0, return_index=True)[1] if len(anchor) else empty
    anchor, key, bands = anchor[once], key[once], bands[once]
    return doc[anchor], anchor - at[doc[anchor]], key.astype(np.int64), bands.astype(np.int64), anchor, run


def _emit(banded: bool):
    """(id, pos, key) of the paragraphs, or (id, key, bits, bands). bits: those that the shingles set, of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("id").to_numpy()
            for i, j in groups(texts):
                doc, pos, key, bands, anchor, shingles = paragraphs(texts[i:j])
                columns = {"id": ids[i:j][doc], "key": key}
                if banded:
                    bits = _slide(np.uint64(1) << (shingles & np.uint64(63)), RUNS, np.bitwise_or)[anchor]
                    columns |= {"bits": bits.view(np.int64)} | {f"m{k}": np.ascontiguousarray(bands[:, k]) for k in range(BANDS)}
                else:
                    columns["pos"] = pos
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the paragraphs asked for, RUNS ascending numbers of 32 bits: rows (text, keys)."""
    for b in batches:
        texts, keys = b.column("text").to_pylist(), b.column("keys").to_pylist()
        for i, j in groups(texts):
            doc, _, key, _, anchor, run = paragraphs(texts[i:j])
            asked = keys[i:j]
            of = np.repeat(np.arange(len(asked)), [len(k) for k in asked])
            tell = lambda k, d: k.astype(np.uint64) ^ mix64(d.astype(np.uint64))
            hit = np.flatnonzero(np.isin(tell(key, doc), tell(np.concatenate([np.asarray(k, np.int64) for k in asked]), of)))
            sets = np.sort(run[anchor[hit][:, None] + np.arange(RUNS)].astype(np.uint32), axis=1) if len(hit) else np.zeros((0, RUNS), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(_fresh(sets).sum(axis=1)), pa.array([row.tobytes() for row in sets], pa.binary())], ["key", "n", "s"])


def _fresh(s: np.ndarray) -> np.ndarray:
    """Where each row's numbers, which ascend, come for the first time."""
    out = np.ones(s.shape, bool)
    out[:, 1:] = s[:, 1:] != s[:, :-1]
    return out


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets in the rows of a and b have a Jaccard similarity of PERCENT, some rows at a time."""
    parts = [np.zeros(0, bool)]
    for i in range(0, len(a), 1024):
        x, y = a[i : i + 1024], b[i : i + 1024]
        fresh = _fresh(x)
        same = ((x[:, :, None] == y[:, None, :]).any(axis=2) & fresh).sum(axis=1)
        parts.append(same * 100 >= PERCENT * (fresh.sum(axis=1) + _fresh(y).sum(axis=1) - same))
    return np.concatenate(parts)


def apart(n):
    """The most shingles that are in one only of two similar sets of n together."""
    return n * (100 - PERCENT) // (100 + PERCENT)


def sizes() -> list[tuple[int, int]]:
    """Ranges of sizes, from the largest down: two similar sets are of one range or of two neighbouring ones."""
    out, most = [], RUNS
    while most:
        least = -(-most * PERCENT // 100)
        out.append((least, most))
        most = least - 1
    return out


def parts_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, whether empty) of parts of the sets, one of which two similar ones have in common: a set is dealt into one
    part more than can differ from a set of its range of sizes, and into as many as the next range has."""
    fresh, found = _fresh(s), []
    n, told = fresh.sum(axis=1), np.where(fresh, mix64(s), np.uint64(0))
    ranges = sizes()
    for i, (least, most) in enumerate(ranges):
        row = np.flatnonzero((n >= (ranges[i + 1][0] if i + 1 < len(ranges) else least)) & (n <= most))
        parts = apart(2 * most) + 1
        of = (s[row] >> np.uint32(6)) % np.uint32(parts)
        for k in range(parts):
            mine = of == k
            found.append((row, mix64(np.where(mine, told[row], np.uint64(0)).sum(axis=1, dtype=np.uint64) ^ np.uint64(SEEDS[i % len(SEEDS)] + 64 * i + k)), ~mine.any(axis=1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _read(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), RUNS)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(["a", "b"]).filter(pa.array(similar(_read(b.column("sa")), _read(b.column("sb")))))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, part, empty = parts_of(_read(b.column("s")))
        yield pa.RecordBatch.from_arrays([pa.array(b.column("key").to_numpy()[row]), pa.array(part.view(np.int64)), pa.array(empty)], ["key", "part", "empty"])


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, text): classes (key, low, high, ...), the smallest and largest id that has a paragraph; those of them that
    share a bucket with another document's; and the components (node, component) of those that are linked."""
    bands = [f"m{k}" for k in range(BANDS)]
    # the bands and the places are of two passes: both together are more to write than the texts
    found = rows.mapInArrow(_emit(True), "id bigint, key bigint, bits bigint, " + ", ".join(f"{m} bigint" for m in bands))
    classes = materialise(found.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), *[F.min(m).alias(m) for m in ("bits", *bands)]), "paragraph-classes")
    # the bands hash with seeds of their own, so a value is of one band
    posted = classes.select("key", "low", "high", "bits", F.explode(F.array(*bands)).alias("token"))
    # a text's own paragraphs overlap, so they collide: only buckets of several documents are compared
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("low").alias("least"), F.max("high").alias("most")).where("m > 1 and least < most").select("token", "m")
    members = materialise(posted.join(materialise(shared, "paragraph-buckets"), "token").select("token", "m", "key", "low", "high", "bits"), "paragraph-members")
    sets: list[DataFrame] = []

    def verified(pairs: DataFrame) -> DataFrame:
        # the texts are read once: for the pairs, and for all that large buckets may compare
        asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(members.where(F.col("m") > SMALL).select("key")).distinct()
        asked = asked.join(members.select("key", "low").distinct(), "key").groupBy(F.col("low").alias("id")).agg(F.collect_list("key").alias("keys"))
        got = rows.join(asked, "id").select("text", "keys").mapInArrow(_fetch, "key bigint, n bigint, s binary")
        # rows that repeat an id give a set twice
        sets.append(materialise(got.dropDuplicates(["key"]), "paragraph-sets"))
        side = lambda s: sets[0].select(F.col("key").alias(s), F.col("s").alias(f"s{s}"))
        return materialise(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_linked, "a bigint, b bigint"), "paragraph-links")

    def could(x, y):
        """Not of two paragraphs that one document alone has, nor of those whose bits tell that they are unlike."""
        alone = (x("low") == x("high")) & (y("low") == y("high")) & (x("low") == y("low"))
        return ~alone & (F.bit_count(x("bits").bitwiseXOR(y("bits"))) <= APART)

    def possible(a: dict, b: dict) -> np.ndarray:
        alone = (a["low"] == a["high"]) & (b["low"] == b["high"]) & (a["low"] == b["low"])
        return ~alone & (np.bitwise_count(a["bits"].view(np.uint64) ^ b["bits"].view(np.uint64)) <= apart(a["n"] + b["n"]))

    def fine(where: DataFrame) -> DataFrame:
        told = materialise(sets[0].join(where, "key", "left_semi").mapInArrow(_dealt, "key bigint, part bigint, empty boolean"), "paragraph-parts")
        # many sets have an empty part, so that one counts within a bucket only
        empty = told.where("empty").join(where.select("token", "key"), "key").select("key", F.xxhash64("token", "part").alias("token"))
        return told.where("not empty").select("key", F.col("part").alias("token")).unionByName(empty)

    return classes, members, Buckets(members, verified, could, possible, ("low", "high", "bits"), SMALL, fine=fine, whole=lambda: sets[0], linked=similar).components()


def paragraph_components(rows: DataFrame) -> DataFrame:
    """(key, low, high, component) of the paragraph classes of rows (id, text): the smallest and largest id that has it, and the
    component of those that are similar to each other or to a third one."""
    classes, _, parts = _classes(rows)
    return classes.join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "low", "high", F.coalesce("component", "key").alias("component"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each stretch of words that repeats in another document: id, first_word, last_word (exclusive),
    n_words, component_id (the smallest id that has its first paragraph, or a similar one), kept.

    A stretch joins overlapping repeated paragraphs. kept is true for the stretches that stay: those of the
    smallest id, and there of the first place and what overlaps it. Where a kept and a removed stretch of a
    document overlap, the words of both stay. Documents without such a stretch have no row; those are null,
    empty and short texts and all that repeat only inside themselves. Rows that repeat an id count as one
    document; rows without an id have no row and aren't compared. Of an empty table nothing comes. Words are runs of anything
    but ASCII white space, compared with A-Z in lower case. Whole texts are read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    classes, members, parts = _classes(rows)
    parts = parts.withColumnRenamed("node", "key")
    # most classes are of one document and have no link; only the others are looked at
    linked = parts.join(members.select("key", "low", "high").distinct(), "key")
    spread = linked.groupBy("component").agg(F.min("low").alias("component_id"), F.max("high").alias("high")).where("component_id < high")
    linked = parts.join(spread.select("component", "component_id"), "component").select("key", "component", "component_id")
    alone = classes.where("low < high").join(parts, "key", "left_anti").select("key", F.col("key").alias("component"), F.col("low").alias("component_id"))
    repeats = materialise(linked.unionByName(alone), "paragraph-repeats")
    hit = materialise(rows.mapInArrow(_emit(False), "id bigint, key bigint, pos bigint").join(repeats, "key").distinct(), "paragraph-places")
    # of the smallest id the first place stays, with the paragraphs that overlap it, one after the other
    own = Window.partitionBy("component").orderBy("pos", "key")
    gap = F.coalesce(F.col("pos") >= F.lag("pos").over(own) + PARAGRAPH, F.lit(False)).cast("int")
    stays = hit.where(F.col("id") == F.col("component_id")).withColumn("gap", gap).withColumn("gaps", F.sum("gap").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    stays = stays.where("gaps = 0").groupBy("component").agg(F.max("pos").alias("last"))
    hit = hit.join(stays, "component").withColumn("kept", (F.col("id") == F.col("component_id")) & (F.col("pos") <= F.col("last")))
    order = Window.partitionBy("id", "kept").orderBy("pos", "key")
    fresh = F.coalesce(F.col("pos") > F.max(F.col("pos") + PARAGRAPH).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = hit.withColumn("fresh", fresh.cast("int")).withColumn("nth", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "kept", "nth").agg(F.min("pos").alias("first_word"), (F.max("pos") + PARAGRAPH).alias("last_word"), F.min_by("component_id", "pos").alias("component_id"))
    return spans.select(F.col("id").alias(id_col), "first_word", "last_word", (F.col("last_word") - F.col("first_word")).alias("n_words"), "component_id", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed stretches cut out of the text; rows without one, null ids and null texts stay as they are."""
    spans = fresh_name(docs, "spans")
    gone = repeated_passages(docs, id_col, text_col).groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.struct("first_word", "last_word", "kept")).alias(spans)).where(F.exists(spans, lambda s: ~s["kept"]))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, spans, strict=True):
            if text is None or gone is None or not len(gone):
                out.append(text)
                continue
            raw, keep, at = text.encode("utf-8", "surrogatepass"), [], 0
            places = list(_places(raw))
            for s in _without(gone):
                keep.append(raw[at : max(at, places[s[0]][0])])
                at = max(at, places[s[1] - 1][1])
            out.append((b"".join(keep) + raw[at:]).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    joined = docs.join(gone, docs[id_col] == gone["id"], "left")
    return joined.select(*[cut(docs[c], F.col(spans)).alias(c) if c == text_col else docs[c] for c in docs.columns])


def _without(spans) -> list[tuple[int, int]]:
    """The removed stretches in order, less the words of the kept ones."""
    stay, out = sorted((s["first_word"], s["last_word"]) for s in spans if s["kept"]), []
    for at, last in sorted((s["first_word"], s["last_word"]) for s in spans if not s["kept"]):
        for a, b in stay:
            if a < last and b > at:
                if at < a:
                    out.append((at, a))
                at = b
        if at < last:
            out.append((at, last))
    return out


def _places(raw: bytes):
    from .wordhash import word_spans

    return zip(*word_spans(np.frombuffer(raw, np.uint8)), strict=True)

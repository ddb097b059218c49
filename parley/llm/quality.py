"""Quality classifier: supervised subword embeddings, as in fastText.

Hashed words and character n-grams have learned vectors; a document is their average, a softmax layer reads
it, and both are trained by stochastic gradient descent in numpy. As the layer is linear in the average,
a trained model is one number for each hash bucket, and a score needs one look-up for each feature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import draw
from .wordhash import BASE, SPACE, mix64, range_hashes, word_spans

#: Bits of the hash buckets, vector length, n-gram lengths in bytes, training rows in all, passes, rate, batch.
BUCKET_BITS, DIM, LENGTHS, SAMPLE, EPOCHS, RATE, BATCH = 13, 16, (1, 2, 3, 4), 4000, 12, 0.1, 32
#: What is hashed for two neighbouring words that are equal, and for two that aren't.
SAME, OTHER = np.uint64(1), np.uint64(2)
#: Bytes of text that are hashed together; a longer text is hashed alone.
TOGETHER = 1 << 18


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * BASE >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time, in order: the buckets of all features of the whole texts, and the number of features
    of each text. Features: words, the pattern of each two neighbouring words (equal or not),
    and n-grams of bytes, in which all white space is a space. Empty texts have none."""
    group, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if group and size + len(raw) > TOGETHER:
            yield _hashed(group)
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    if group:
        yield _hashed(group)


def _hashed(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(b" " + raw + b" " for raw in group), np.uint8)
    doc = np.repeat(np.arange(len(group), dtype=np.int32), [len(raw) + 2 for raw in group])
    data = np.where(SPACE[data], np.uint8(0x20), data)
    starts, ends = word_spans(data)
    full = np.zeros(len(group), bool)
    full[doc[starts]] = True
    word, owner = range_hashes(data, starts, ends), doc[starts]
    # words, and of each two neighbours whether they are equal
    pair = owner[1:] == owner[:-1]
    at, of = [_bucket(word), _bucket(mix64(np.where(word[1:] == word[:-1], SAME, OTHER)))[pair]], [owner, owner[1:][pair]]
    x, h = data.astype(np.uint64) + np.uint64(1), np.zeros(len(data), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] + x[n - 1 :]) * BASE
        if n in LENGTHS:
            inside = (doc[n - 1 :] == doc[: len(doc) - n + 1]) & full[doc[n - 1 :]]
            at.append(_bucket(h + np.uint64(n))[inside])
            of.append(doc[n - 1 :][inside])
    at, of = np.concatenate(at), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return at[order], np.bincount(of, minlength=len(group))


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, towards label 1
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for at, n in features(texts):
            total = np.concatenate([[0.0], np.cumsum(self.weight[at])])
            end = np.cumsum(n)
            z = (total[end] - total[end - n]) / np.maximum(n, 1) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out)


def train(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seed: int = 3) -> Model:
    """rows: the buckets and their shares of each document; label: 0 or 1. Steps are scaled as in Adagrad."""
    buckets = 1 << BUCKET_BITS
    if not len(label):
        return Model(np.zeros(buckets), 0.0)
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 1 / DIM, (buckets, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    past = [np.full_like(x, 1e-8) for x in (e, w, b)]
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(label)), max(1, len(label) // BATCH)):
            x = np.zeros((len(part), buckets), np.float32)
            for i, k in enumerate(part):
                x[i, rows[k][0]] = rows[k][1]
            mean = x @ e
            z = mean @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), label[part]] -= 1
            p /= len(part)
            for value, old, slope in zip((e, w, b), past, (x.T @ (p @ w.T), mean.T @ p, p.sum(axis=0)), strict=True):
                old += slope**2
                value -= RATE * slope / np.sqrt(old)
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float64), float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most about `sample` labelled rows (a parameter that bounds the driver's work), as many of
    each label; ids with several labels, or held out, are left out. Each row sends bounded bucket counts."""
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
    drawn = draw(one.where("label = other"), "id", "label", sample).select("id", "label")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for at, n in features(b["text"].tolist()):
                for part in np.split(at, np.cumsum(n)[:-1]):
                    c = np.bincount(part, minlength=1)
                    hit = np.flatnonzero(c)
                    rows.append((hit.astype(np.int16), (c[hit] / max(1, len(part))).astype(np.float32)))
            yield pd.DataFrame({"label": b["label"], "id": b["id"], "at": [r[0] for r in rows], "share": [r[1] for r in rows]})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    # a flat Arrow table: no object for each row or value reaches the driver
    got = texts.select("id", "label", "text").mapInPandas(featured, "label int, id bigint, at array<smallint>, share array<float>").toArrow()
    got = got.combine_chunks().sort_by("id")
    rows = []
    if len(got):
        at, share = (got[c].combine_chunks() for c in ("at", "share"))
        ends = at.offsets.to_numpy()
        flat, part = at.values.to_numpy(), share.values.to_numpy()
        rows = [(flat[i:j], part[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return train(rows, got["label"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out` of scores in 0 to 1, higher where label 1 is likelier; a column of docs that has that name, in
    either case, is replaced. An empty or null text gets the score of the bias alone. Rows that repeat an id are
    scored each by itself. Whole texts are read; a score depends on the text alone. Of an empty table nothing comes; with
    no labelled row all scores are 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.withColumn(out, predict(F.col(text_col)))

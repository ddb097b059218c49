"""Language ID by nearest centroid: normalised TF-IDF vectors of character n-grams, several clustered
centroids for each language, cosine, and rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, release
from .sampling import draw
from .wordhash import BASE

#: Bits of the hashed dimensions for each n-gram length, the lengths, centroids a language, training rows in all.
DIM_BITS, LENGTHS, CENTROIDS, SAMPLE = 13, (1, 2, 3), 4, 3000
#: A text is rejected if its best cosine is below this part of the lowest 1 in 1000 of the training texts.
REJECT = 0.3

_plane: list[np.ndarray] = []


def _letters(x: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _plane:
        _plane.append(np.array([chr(k).isalpha() for k in range(1 << 16)]))
    alpha = _plane[0][np.minimum(x, 0xFFFF)]
    for i in np.flatnonzero(x > 0xFFFF).tolist():
        alpha[i] = chr(int(x[i])).isalpha()
    return alpha


def _clean(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text between two spaces; all but letters become spaces, runs of those one space."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters(x)
    if not alpha.any():
        return np.zeros(0, np.uint32)
    x = np.concatenate([[0x20], np.where(alpha, x, np.uint32(0x20)), [0x20]]).astype(np.uint32)
    return x[(x != 0x20) | np.concatenate([[True], x[:-1] != 0x20])]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the whole text and how often each occurs, or None if it has no letter."""
    x = _clean(text).astype(np.uint64)
    if not len(x):
        return None
    h, at = np.zeros(len(x), np.uint64), []
    for n in range(1, min(max(LENGTHS), len(x)) + 1):
        h = (h[: len(x) - n + 1] + x[n - 1 :] + np.uint64(1)) * BASE
        at.append(((h ^ (h >> np.uint64(29))) * BASE >> np.uint64(64 - DIM_BITS)).astype(np.int64) + (n - 1) * (1 << DIM_BITS))
    c = np.bincount(np.concatenate(at))
    at = np.flatnonzero(c)
    return at, c[at]


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # unit columns
    owner: np.ndarray  # the language number of each
    languages: list[str]
    floor: np.ndarray  # by language, the cosine below which a text is rejected

    def nearest(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, best cosine, rejected) of each text."""
        out = []
        for t in texts:
            c = counts(t)
            if c is None or not self.languages:
                out.append(("und", 0.0, True))
                continue
            at, n = c
            v = np.log1p(n) * self.idf[at]
            cos = v @ self.centroids[at] / np.linalg.norm(v)
            k = int(cos.argmax())
            lang = int(self.owner[k])
            out.append((self.languages[lang], float(min(1.0, max(0.0, cos[k]))), bool(cos[k] < self.floor[lang])))
        return out


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is told and not rejected, with their columns as they were."""
    prefix = "told_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    told = identify(docs, model, text_col, prefix)
    return told.where(~F.col(f"{prefix}rejected")).select(*docs.columns)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts; deterministic."""
    start = [int((x @ x.mean(axis=0)).argmax())]
    far = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(far.argmin()))
        far = np.maximum(far, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        mine = (x @ c.T).argmax(axis=1)
        c = np.stack([x[mine == i].mean(axis=0) if (mine == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from at most about `sample` rows (a parameter that bounds the driver's work) that are not held
    out and whose language isn't null; each sends one bounded count vector of its whole text."""

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang, text in zip(b["lang"], b["text"], strict=True):
                if (c := counts(text)) is not None:
                    rows.append((lang, c[0].astype(np.int32), c[1].astype(np.int32)))
            yield pd.DataFrame(rows, columns=["lang", "at", "n"])

    drawn = draw(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "id", "lang", sample)
    got = drawn.select("lang", "text").mapInPandas(featured, "lang string, at array<int>, n array<int>").toArrow().combine_chunks()
    width = max(LENGTHS) << DIM_BITS
    names = got["lang"].to_pylist()
    languages, seen = sorted(set(names)), np.zeros(width)
    flat, ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
    if names:
        at, n = (got[c].combine_chunks() for c in ("at", "n"))
        flat, many, ends = at.values.to_numpy(), n.values.to_numpy(), at.offsets.to_numpy()
        seen = np.bincount(flat, minlength=width)
    model = Model(np.log((1 + len(names)) / (1 + seen)).astype(np.float32) + 1, np.zeros((width, 0), np.float32), np.zeros(0, int), languages, np.zeros(len(languages)))
    groups, owner = [], []
    for i, lang in enumerate(languages):
        rows = [k for k, name in enumerate(names) if name == lang]
        x = np.zeros((len(rows), width), np.float32)
        for r, k in enumerate(rows):
            part = slice(ends[k], ends[k + 1])
            v = np.log1p(many[part]) * model.idf[flat[part]]
            x[r, flat[part]] = v / max(np.linalg.norm(v), 1e-12)
        c = _cluster(x, CENTROIDS)
        groups.append(c)
        owner += [i] * len(c)
        model.floor[i] = REJECT * float(np.quantile((x @ c.T).max(axis=1), 0.001))
    if groups:
        model.centroids, model.owner = np.ascontiguousarray(np.concatenate(groups).T.astype(np.float32)), np.array(owner)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with <prefix>lang_pred, <prefix>score (the best cosine, 0 to 1) and <prefix>rejected; columns of docs that have these
    names, in either case, are replaced. Rows that repeat an id are predicted each by itself; of an empty table nothing comes.

    A text that is null or has no letter is `und` with score 0, rejected. Any other text gets a learned
    language, and is rejected if it is farther from its centroid than any training text by far. With no
    language learned all are `und`. Whole texts are read. Predictions depend on the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        release()
        return pd.DataFrame(shared.value.nearest(texts.tolist()), columns=["lang_pred", "score", "rejected"])

    at = fresh_name(docs, "identified")
    told = docs.withColumn(at, predict(F.col(text_col)))
    return told.withColumns({f"{prefix}{c}": F.col(at)[c] for c in ("lang_pred", "score", "rejected")}).drop(at)

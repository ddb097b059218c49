"""64-bit hashes of words, shingles and n-grams, vectorised over whole batches of texts.

Bytes are mapped to random 64-bit values and combined as a polynomial modulo 2**64; prefix sums give the
hash of any byte range in constant time. All constants come from one seed: every executor has the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: BASE is odd, so it has an inverse modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}

#: What separates words: the ASCII white space of the contracts.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose low and high bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1; kept, and doubled as longer batches come."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 2 * (0 if have is None else len(have)), 1 << 16)
        have = _powers[int(base)] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, base, np.uint64))])
    return have[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words."""
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte range; equal ranges have equal hashes wherever they stand."""
    n = len(data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * _power(BASE, n), dtype=np.uint64)])
    return mix64((total[ends] - total[starts]) * _power(INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def groups(texts: list[str | None], most: int = 1 << 18, count: int = 64) -> Iterator[tuple[int, int]]:
    """Ranges of texts of together at most `most` characters, or of one longer text: what is hashed at once, so
    that the memory of a task follows its longest text and not a number of long ones."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and (size + n > most or i - first >= count):
            yield first, i
            first, size = i, 0
        size += n
    if len(texts) > first:
        yield first, len(texts)


def texts_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, offsets: text i has words offsets[i] to offsets[i + 1]).
    lower: A-Z become a-z, other letters stay. Null is the empty text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    whole = b"\n".join(raw) + b"\n"
    data = np.frombuffer(whole.lower() if lower else whole, np.uint8)
    starts, ends = word_spans(data)
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return range_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words; with fewer words, of the whole sequence; of no words, none.
    The length takes part, so a short sequence never equals a full shingle."""
    if not len(words):
        return words
    k = min(width, len(words))
    n, h = len(words) - k + 1, np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        h = mix64(h * BASE + words[i : i + n])
    return h

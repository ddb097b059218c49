"""Sortable 26-character ids: 48 bits of milliseconds and 80 further bits, in Crockford's base 32.

The further bits come from a digest of the row's natural key, so that a run can be repeated."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"  # fixed value


def encode(value: int) -> str:
    """Of a number below 2 ** 128."""
    return "".join(ALPHABET[value >> 5 * i & 31] for i in range(25, -1, -1))


def parse(text: str) -> int:
    """The number of an id in either case; ValueError for what isn't one."""
    if len(text) != 26 or text.upper().strip(ALPHABET) or text[0] > "7":
        raise ValueError(f"not an id: {text!r}")
    return sum(ALPHABET.index(c) << 5 * (25 - i) for i, c in enumerate(text.upper()))


def millis(text: str) -> int:
    return parse(text) >> 80


def make(ms: int, key: str) -> str:
    return encode((max(0, ms) & (1 << 48) - 1) << 80 | int.from_bytes(hashlib.sha256(key.encode()).digest()[:10], "big"))


def make_id(ms: Column, *key: Column) -> Column:
    @F.pandas_udf("string")
    def run(at: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([make(int(a), k) for a, k in zip(at, keys, strict=True)])

    return run(ms, F.concat_ws("\x1f", *key))


def id_millis(column: Column) -> Column:
    """Milliseconds of an id, natively: its first ten characters are the 50 highest bits, two of them zero."""
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    value = F.lit(0).cast("long")
    for i in range(1, 11):
        value = F.shiftleft(value, 5) + F.array_position(letters, F.upper(F.substring(column, i, 1))) - 1
    return value

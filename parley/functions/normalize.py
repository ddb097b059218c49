"""Words and their two index forms: the surface (as written, invisible differences folded) and the lemma.

Segmentation is a native Column expression. Forms need Unicode normalisation and morphology, which the JVM
lacks as functions, so they are computed by an Arrow UDF over the word array of a row, with a memo of words."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import porter2

#: Version of these rules; an index that was built by another version must be built again.
VERSION = 3

# fixed values: characters inside words besides letters and numbers, the joiner, longest word with morphology, least stem
INNER, ZWNJ, LONGEST, LEAST_STEM = "_-./'", "‌", 25, 3
# fixed values: letters that are folded, and characters that are dropped
FOLDS = {0x0643: 0x06A9, 0x064A: 0x06CC, 0x0649: 0x06CC, 0x0623: 0x0627, 0x0625: 0x0627, 0x0624: 0x0648, 0x0626: 0x06CC, 0x06C0: 0x0647, 0x0629: 0x0647}
DROPPED = (*range(0x064B, 0x0656), 0x0670, 0x0640, 0x200D, 0x200E, 0x200F, 0xFEFF)
_TABLE = FOLDS | dict.fromkeys(DROPPED) | {first + d: 0x30 + d for first in (0x0660, 0x06F0) for d in range(10)}
# fixed values: Persian prefixes before the joiner, and suffixes in the order in which they are tried
PREFIXES = ("نمی" + ZWNJ, "می" + ZWNJ)
SUFFIXES = "هایمان هایتان هایشان انمان انتان انشان هایی هایم هایت هایش ترین های انم انت انش مان تان شان ها تر ام ات اش ان ای ی".split()
# fixed values: blocks of the Arabic script
ARABIC = "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿"

_WORD = regex.compile(rf"[\p{{Alphabetic}}\p{{N}}_\-./'{ZWNJ}]+")
_EDGE = regex.compile(rf"^[^\p{{Alphabetic}}\p{{N}}{ZWNJ}]+|[^\p{{Alphabetic}}\p{{N}}{ZWNJ}]+$")
_ARABIC = regex.compile(f"[{ARABIC}]")
_OTHER = regex.compile(rf"[[\p{{Alphabetic}}\p{{N}}]--[{ARABIC}a-zA-Z0-9]]", regex.V1)
_LATIN = regex.compile("[a-zA-Z0-9]")
_ODD = regex.compile(r"[_./\-\p{N}]")
_LETTER = regex.compile(r"\p{Alphabetic}")

JAVA_WORD = r"[\p{IsAlphabetic}\p{N}_\-./'\x{200C}]+"
JAVA_EDGE = r"^[^\p{IsAlphabetic}\p{N}\x{200C}]+|[^\p{IsAlphabetic}\p{N}\x{200C}]+$"


def words(text: Column) -> Column:
    """The array of words of a text, in order; null text has none."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(JAVA_WORD), F.lit(0))
    return F.filter(F.transform(runs, lambda w: F.regexp_replace(w, JAVA_EDGE, "")), lambda w: w != "")


def segment(text: str | None) -> list[str]:
    """The same words, in Python: for queries and for texts that are in Python anyway."""
    return [w for w in (_EDGE.sub("", m) for m in _WORD.findall(text or "")) if w]


def script(word: str) -> str:
    """latin, arabic, mixed or other; any letter or number of a third script makes it other."""
    if _OTHER.search(word):
        return "other"
    if _ARABIC.search(word):
        return "mixed" if _LATIN.search(word) else "arabic"
    return "latin" if _LATIN.search(word) else "other"


def script_class(word: Column) -> Column:
    """script() as a Column expression."""
    third = word.rlike(rf"[\p{{IsAlphabetic}}\p{{N}}&&[^a-zA-Z0-9{ARABIC}]]")
    arabic, latin = word.rlike(f"[{ARABIC}]"), word.rlike("[a-zA-Z0-9]")
    return F.when(third, "other").when(arabic & latin, "mixed").when(arabic, "arabic").when(latin, "latin").otherwise("other")


@lru_cache(maxsize=1 << 16)
def surface(word: str) -> str:
    return word if word.isascii() else unicodedata.normalize("NFC", word).translate(_TABLE)


def _shaped(folded: str, kind: str) -> bool:
    """Whether morphology may touch it: not an identifier, number, blob or word of a third script."""
    return kind != "other" and len(folded) <= LONGEST and not _ODD.search(folded) and bool(_LETTER.search(folded))


@lru_cache(maxsize=1 << 16)
def lemma(word: str, kind: str | None = None) -> str:
    kind = kind or script(word)
    folded = surface(word).lower()
    if not _shaped(folded, kind):
        return folded.replace(ZWNJ, "")
    return porter2.stem(folded) if kind == "latin" else _persian(folded)


def _persian(folded: str) -> str:
    base = folded.replace("آ", "ا")
    base = next((base[len(p) :] for p in PREFIXES if base.startswith(p)), base)
    for suffix in SUFFIXES:
        if not base.endswith(suffix):
            continue
        rest = base[: -len(suffix)]
        if len(rest) > 1 and rest.endswith(ZWNJ):
            base = rest[:-1]
            break
        if len(rest) >= LEAST_STEM:
            base = rest
            break
    return base.replace(ZWNJ, "")


def forms(column: Column) -> Column:
    """Of an array of words: the struct of their surfaces and lemmas, position by position (a lemma may be empty)."""

    @F.pandas_udf("surface array<string>, lemma array<string>")
    def run(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"surface": [[surface(w) for w in r] for r in rows], "lemma": [[lemma(w) for w in r] for r in rows]})

    return run(column)


def lower_forms(column: Column) -> Column:
    """forms() by plain rules, natively: words as they are, and in lower case as their lemmas."""
    return F.struct(column.alias("surface"), F.transform(column, F.lower).alias("lemma"))

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import ids, normalize, porter2
from parley.operators import split
from parley.plans.parser import label, parse


@pytest.mark.parametrize(("word", "stem"), [("links", "link"), ("migrations", "migrat"), ("expiry", "expiri"), ("password", "password"), ("borrowing", "borrow"), ("caresses", "caress"), ("hoping", "hope"), ("hopping", "hop"), ("relational", "relat"), ("skies", "sky"), ("flies", "fli"), ("agreed", "agre"), ("happy", "happi"), ("generous", "generous")])
def test_stems(word, stem):
    assert porter2.stem(word) == stem


@pytest.mark.parametrize(("word", "lemma"), [("منقضی", "منقض"), ("بیشتر", "بیش"), ("ماهی", "ماه"), ("می‌رود", "رود"), ("کتاب‌هایمان", "کتاب"), ("۱۴۰۴", "1404"), ("JWT_SECRET", "jwt_secret"), ("getUserByID", "getuserbyid"), ("été", "été")])
def test_lemmas(word, lemma):
    assert normalize.lemma(word) == lemma


def test_segments_agree(spark):
    texts = ["Hello, v0.26.1 don't e.g. 'x' _a- می‌رود é", "", None, "...", "a/b c-d ١٢ ñandú ‌ x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", normalize.words(F.col("t")).alias("w"), normalize.script_class(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.w for r in got] == [normalize.segment(t) for t in texts]
    assert normalize.segment("e.g. x") == ["e.g", "x"]


def test_units_of_a_note():
    note = "# Watering\n\nSeedlings dry out.\n\n- the can holds two litres\n- the hose is longer\n\n| bed | litres |\n|---|---|\n| north | 5 |\n\n```\nLITRES=15\n```"
    assert [note[a:b] for a, b, _ in split.units(note)] == ["# Watering", "Seedlings dry out.", "- the can holds two litres", "- the hose is longer", "| north | 5 |", "```\nLITRES=15\n```"]
    nested = "- top line\n  - inner one\n  - inner two\n- loose\n\n  with a paragraph\n\n1. alone"
    assert [nested[a:b] for a, b, _ in split.units(nested)] == ["-", "top line", "- inner one", "- inner two", "-", "loose", "with a paragraph", "1. alone"]
    tight = "* a\n  more of a\n  * b\n    ```\n    c\n    ```\n* d"
    assert [tight[a:b] for a, b, _ in split.units(tight)] == ["* a\n  more of a", "* b", "```\n    c\n    ```", "* d"]
    assert split.units("") == [] and split.units(None) == [] and split.units(" \n") == []
    assert split.sentences("One. Two? v1.2 is\nout") == ["One.", "Two?", "v1.2 is\nout"]
    assert len(split.sentences("x\n" * 45, True)) == 3 and len(split.sentences("x\r\x0b\x0c\u2028" * 45, True)) == 1


@given(st.text("ab#-*>`|. \n1", max_size=60))
def test_units_cover_and_are_ordered(text):
    found = split.units(text)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    assert bool(found) <= bool(text.strip()) and all(text[a:b].strip() == text[a:b] != "" for a, b, _ in found)


@given(st.integers(0, 2**128 - 1))
def test_ids_round_trip(value):
    assert ids.parse(ids.encode(value)) == value and ids.parse(ids.encode(value).lower()) == value


def test_id_millis(spark):
    text = ids.make(1_700_000_000_123, "k")
    assert spark.createDataFrame([(text,)], "i string").select(ids.id_millis(F.col("i"))).first()[0] == 1_700_000_000_123 == ids.millis(text)


@pytest.mark.parametrize("query", ["(a OR b)", '"p q"~2', "surface:w", "lemma: IN [a b]".replace(": ", ":"), "x^2", '"p q"*', "(+a +b)"])
def test_labels(query):
    parts = parse(query)
    assert len(parts) == 1 and label(parts[0][1]) == query


def test_escapes_and_quotes():
    assert parse(r"a\:b")[0][1].text == "a:b" and parse("'a b'")[0][1].quoted
    assert [o for o, _ in parse("+a -b c")] == ["+", "-", ""] and [o for o, _ in parse("a AND NOT b")] == ["+", "-"]


def test_or_counts_where_it_stands():
    """An OR in a phrase or inside parentheses says nothing about the ideas around it."""
    for query in ('c AND d "x OR y"', 'c AND d "x or y"', "(a OR b) c AND d"):
        assert [o for o, _ in parse(query)].count("+") == 2, query
    assert [label(n) for _, n in parse("a OR b AND c")] == ["a", "(+b +c)"]


def test_times_and_previews(spark):
    from parley.operators.render import preview, rfc3339

    rows = [(0, "a b"), (1_700_000_000_999, "x " * 60 + "y"), (-1, 'q"\\\n'), (951_782_400_000, "x " * 59 + "x"), (None, None)]
    got = spark.createDataFrame(rows, "ms bigint, t string").select(rfc3339(F.col("ms")), preview(F.col("t"))).collect()
    assert [r[0] for r in got] == ["1970-01-01T00:00:00Z", "2023-11-14T22:13:20Z", "1969-12-31T23:59:59Z", "2000-02-29T00:00:00Z", None]
    assert [r[1] for r in got] == ["a b", ("x " * 60).strip() + "…", 'q\\"\\\\\\n', "x " * 59 + "x", None]

import duckdb
import pytest

from parley import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "documents conversations".split()


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(str(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = q.QUERIES[name](spark, SF).toPandas(), con.execute(q.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE)))
def test_others_run(spark, name):
    """Their results are held against brute force in the tests of the engine and of the splitter; here each has rows."""
    assert q.QUERIES[name](spark, SF).count() > 0


def test_snippets_against_brute_force(spark):
    from parley.functions import normalize
    from parley.operators.split import sentences

    rows = q.QUERIES["snippets"](spark, SF).collect()
    texts = {(str(r.conv_id), str(r.turn)): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    assert len(rows) == 10
    for r in rows:
        text = texts[r.session_ref, r.message_ref].strip()
        held = [len({normalize.lemma(w) for w in normalize.segment(s)} & {"the", "and"}) for s in sentences(text)]
        assert r.words == len(text.split()) and r.snippet == (sentences(text)[held.index(max(held))] if len(held) > 1 and max(held) else text)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["bm25_term", "filter_role", "all_fields"])
def test_no_caps(spark, name, monkeypatch):
    """Queries that aren't top-k reports return every hit."""
    asked = []
    monkeypatch.setattr(q, "search", lambda *a, search=q.search, **k: asked.append((k["limit"], k["max_per_message"])) or search(*a, **k))
    assert q.QUERIES[name](spark, SF).count() > 0 and asked == [(None, None)]


def test_all_hits(spark):
    """Without a limit or cap: the hits of a limit that none exceeds."""
    _, index = q._index(spark, SF)
    told = lambda **k: sorted((r.unit_id, round(r.score, 9)) for r in q.search(index, "the and", as_of=q.AS_OF, **k).hits.collect())
    assert told(limit=None, max_per_message=None) == told(limit=10**6, max_per_message=10**6)

"""The registered queries of the retrieval engine over the driver's tables, and their SQL.

Searches run over conversations, a turn being a message; statistics and postings of a folder are kept for the
session, like an open index. Scores are rounded to six digits, as both sides sum in their own order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import normalize
from .operators import indexer, read
from .operators.search import Filter, Index, one_error, search
from .operators.split import sentence_pieces
from .plans.compiler import MOST_EXPANSIONS
from .sources.adapters import BASE_TS, STEP, conversations_as_messages, from_conversations, from_documents, known_role

AS_OF = BASE_TS + 100_000 * STEP

_open: dict[tuple, tuple[DataFrame, Index] | Engine] = {}


def _index(spark: SparkSession, sf_dir: str, kind: str = "turns") -> tuple[DataFrame, Index]:
    """Messages and index of conversations, persisted for the application."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _open:
        rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
        messages = conversations_as_messages(rows) if kind == "whole" else from_conversations(rows)
        units = (_index(spark, sf_dir)[1].units if kind == "lower" else indexer.units_of(messages)).persist()
        forms = normalize.lower_forms if kind == "lower" else normalize.forms
        _open[key] = messages, Index(units, indexer.postings_of(units, forms=forms).persist(), forms=forms)
    return _open[key]


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Conversations in two memories, which were written in several steps: added, one message replaced, one memory
    scanned again, the other compacted."""
    key = (spark.sparkContext.applicationId, sf_dir, "engine")
    if key not in _open:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        engine = Engine(spark, f"{shared or tempfile.mkdtemp(prefix='parley-')}/memories-{uuid.uuid4().hex}")
        rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
        ts = F.lit(BASE_TS) + (F.col("conv_id") * 100 + F.col("turn")) * STEP
        entries = rows.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("string").alias("message"), known_role(F.col("role"), "tool").alias("role"), F.col("role").alias("author"), ts.alias("ts"), F.col("text").alias("body"), F.col("turn").cast("bigint").alias("ord"))
        for name, which in (("even", "session % 2 = 0"), ("odd", "session % 2 <> 0")):
            engine.create(name, f"Conversations whose number is {name}, kept so that the steps of a memory's life are run")
            engine.add_all(name, entries.where(which))
            first = entries.where(which).orderBy("ts").first()
            if first:
                engine.replace(name, first.session, first.message, "now something else entirely", first.ts)
                engine.replace(name, first.session, first.message, first.body or "", first.ts)
        engine.rescan("odd")
        engine.compact("even")
        _open[key] = engine
    return _open[key]


def engine_list(spark, sf_dir):
    return _engine(spark, sf_dir).list().select("memory", "sessions", "messages", "units")


def engine_outline(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    both = engine.outline("even").unionByName(engine.outline("odd"))
    return both.select(F.col("session_ref").cast("long").alias("conv_id"), "messages", "units")


def engine_terms(spark, sf_dir):
    """The written statistics of each memory."""
    engine = _engine(spark, sf_dir)
    parts = [engine.index(m).term_stats().where("field = 'surface'").select(F.lit(m).alias("memory"), "term", "df") for m in ("even", "odd")]
    return parts[0].unionByName(parts[1])


def engine_search(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    parts = [engine.search(m, "surface:the", limit=None, max_per_message=None, as_of=AS_OF).hits for m in ("even", "odd")]
    return parts[0].unionByName(parts[1]).select(F.col("session_ref").cast("long").alias("conv_id"), F.col("message_ref").cast("long").alias("turn"), F.round("raw", 6).alias("raw"))


def _hits(spark, sf_dir, query, **more) -> DataFrame:
    _, index = _index(spark, sf_dir, more.pop("kind", "turns"))
    found = search(index, query, as_of=more.pop("as_of", AS_OF), limit=more.pop("limit", None), max_per_message=more.pop("cap", None), **more).hits
    return found.select(F.col("session_ref").cast("long").alias("conv_id"), F.col("message_ref").cast("long").alias("turn"), F.round("score", 6).alias("score"), F.round("raw", 6).alias("raw"), F.col("covered").cast("long").alias("covered"))


def _query(text: str, **more):
    return lambda spark, sf_dir: _hits(spark, sf_dir, text, **more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "surface:the surface:and", limit=10, cap=2)


def list_memories(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy(F.col("lang").alias("memory")).agg(F.count_distinct("source").alias("sessions"), F.count(F.lit(1)).alias("messages"))


def outline_sessions(spark, sf_dir):
    messages, index = _index(spark, sf_dir)
    return read.outline_sessions(messages, index.units).select(F.col("session_ref").cast("long").alias("conv_id"), "started_at", "messages", "units")


def outline_messages(spark, sf_dir):
    messages, index = _index(spark, sf_dir)
    return read.outline_messages(messages, index.units).select(F.col("session_ref").cast("long").alias("conv_id"), "seq", "role", "ts", F.col("characters").cast("long").alias("characters"), "units")


def segment_tokens(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", F.posexplode(normalize.words(F.col("text"))).alias("pos", "word")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "word")


def surface_postings(spark, sf_dir):
    _, index = _index(spark, sf_dir)
    place = index.units.select("unit_id", F.col("session_ref").cast("long").alias("conv_id"), F.col("message_seq").alias("turn"))
    held = index.postings.where("field = 'surface'").join(place, "unit_id")
    return held.select("conv_id", "turn", "term", F.col("tf").cast("long").alias("tf"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), F.col("len").cast("long").alias("len"))


def surface_df(spark, sf_dir):
    _, index = _index(spark, sf_dir)
    return index.term_stats().where("field = 'surface'").select("term", "df")


def field_totals(spark, sf_dir):
    _, index = _index(spark, sf_dir)
    return indexer.field_stats(index.units, index.postings.where("field = 'surface'")).select("field", "n_units", "total_len")


def _filtered(keep: Filter | None, session: str | None = None):
    def run(spark, sf_dir):
        messages, _ = _index(spark, sf_dir)
        some = keep
        if session is not None:
            row = messages.where(F.col("session_ref") == session).select("session_id").first()
            some = Filter(session=row[0] if row else "")
        return _hits(spark, sf_dir, "surface:the", keep=some).select("conv_id", "turn", "raw")

    return run


def topk_per_message(spark, sf_dir):
    """Ten best, at most one of each conversation: conversations are messages here and turns their units."""
    _, index = _index(spark, sf_dir, "whole")
    found = search(index, "surface:the surface:and", limit=10, max_per_message=1, as_of=AS_OF).hits
    return found.select(F.col("rank").cast("long").alias("rank"), F.col("message_ref").cast("long").alias("conv_id"), F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


def _cursor(messages: bool):
    def run(spark, sf_dir):
        _, index = _index(spark, sf_dir)
        cursors = index.units.where("message_seq = 1")
        rows = read.window(index.units, cursors, 1, 2, messages)
        place = index.units.select("unit_id", F.col("session_ref").cast("long").alias("conv_id"))
        return rows.join(place, "unit_id").select("conv_id", F.col("message_seq").alias("turn"), "anchor")

    return run


def context_terms(spark, sf_dir):
    """What each turn borrows from its conversation, over lower-cased words."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn is not null")
    own = rows.select(F.lit("m").alias("memory"), F.col("conv_id").alias("message_id"), F.concat_ws(":", "conv_id", "turn").alias("unit_id"), F.transform(normalize.words(F.col("text")), F.lower).alias("lemma"))
    return indexer.context_terms(own).select("unit_id", F.array_join("context", " ").alias("context"))


def fuzzy_terms(spark, sf_dir):
    """Surface terms one typing error away from a word."""
    _, index = _index(spark, sf_dir)
    return index.term_stats().where((F.col("field") == "surface") & one_error(F.col("term"), "ther")).select("term", "df")


def sentences(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", F.posexplode(sentence_pieces(F.col("text"))).alias("nth", "sentence")).select("conv_id", "turn", F.col("nth").cast("long").alias("nth"), "sentence")


def markdown_units(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return indexer.units_of(from_documents(docs)).select(F.col("message_ref").cast("long").alias("doc_id"), "unit_seq", "start", "end", "text")


def lexicon(spark, sf_dir):
    return read.lexicon(_index(spark, sf_dir, "lower")[1], ["the", "And", "nothinglikeit"])


def vocabulary(spark, sf_dir):
    return read.vocabulary(_index(spark, sf_dir, "lower")[1])


def hints(spark, sf_dir):
    return search(_index(spark, sf_dir, "lower")[1], "the and", as_of=AS_OF).hints


def snippets(spark, sf_dir):
    return search(_index(spark, sf_dir)[1], "the and", as_of=AS_OF).hits.select("session_ref", "message_ref", "snippet", "words")


def stemmed_search(spark, sf_dir):
    return _hits(spark, sf_dir, "lemma:the lemma:and")


def window_grouped(spark, sf_dir):
    """The first turn of each conversation and what follows it, by message."""
    _, index = _index(spark, sf_dir)
    told = read.group_window(read.window(index.units, index.units.where("message_seq = 0"), 0, 1))
    place = index.units.select("session_id", F.col("session_ref").cast("long").alias("conv_id")).distinct()
    return told.join(place, "session_id").select("conv_id", F.col("message_seq").alias("turn"), "role", F.size("units").cast("long").alias("units"), "anchor")


# SQL

_WORDS = r"list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_\-./''\x{200C}]+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}\x{200C}]+|[^\p{L}\p{N}\x{200C}]+$', '', 'g')), lambda w: w <> '')"
_BASE = rf"""
WITH turns AS (SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant', 'tool') THEN role ELSE 'tool' END AS role, text,
                      {BASE_TS} + (conv_id * 100 + turn) * {STEP} AS ts, {_WORDS} AS words FROM conversations WHERE trim(text) <> ''),
token AS (SELECT conv_id, turn, unnest(words) AS term, unnest(range(len(words))) AS pos FROM turns),
post AS (SELECT conv_id, turn, nfc_normalize(term) AS term, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM token GROUP BY ALL),
size AS (SELECT conv_id, turn, len(words) AS len FROM turns),
total AS (SELECT (SELECT count(*) FROM turns) AS n, (SELECT sum(len) FROM size) / (SELECT count(*) FROM turns) AS mean),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def _scored(words: list[str], boosts: dict[str, float] | None = None) -> str:
    """BM25 of surface words: one row per turn with s_0, s_1, .. (null where the word is absent) and its positions p_0, .."""
    parts = []
    for i, w in enumerate(words):
        weight = (boosts or {}).get(w, 1.0)
        parts.append(f"""w{i} AS (SELECT conv_id, turn, positions AS p_{i}, {weight} * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS s_{i}
            FROM post JOIN size USING (conv_id, turn) JOIN df USING (term), total WHERE term = '{w}')""")
    joined = "turns" + "".join(f" LEFT JOIN w{i} USING (conv_id, turn)" for i in range(len(words)))
    return f"{_BASE}, {', '.join(parts)}, scored AS (SELECT * FROM {joined})"


_RECENCY = f"(0.3 + 0.7 * pow(0.5, greatest(0, {AS_OF} - ts) / {90 * 24 * 3600 * 1000}.0))"
_SPAN = "(SELECT min(abs(a - b)) FROM unnest(p_0) x(a), unnest(p_1) y(b))"
_NEAR = f"CASE WHEN p_0 IS NULL OR p_1 IS NULL THEN 1.0 ELSE 1 + 0.5 / (1 + greatest(0, {_SPAN} - 1)) END"


_LOWER = f"""{_BASE}, lpost AS (SELECT conv_id, turn, lower(term) AS term, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM token GROUP BY ALL),
ldf AS (SELECT term, count(*) AS df FROM lpost GROUP BY term)"""


def _lower_scored(words: list[str], surface: float, lemma: float) -> str:
    """_scored with lower-cased words as lemmas, and words as they are: the better of the two weighted scores."""
    bm25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / mean))"
    parts = []
    for i, w in enumerate(words):
        parts.append(f"""l{i} AS (SELECT conv_id, turn, positions AS p_{i}, {lemma} * {bm25} AS ls FROM lpost JOIN size USING (conv_id, turn) JOIN ldf USING (term), total WHERE term = '{w}'),
            u{i} AS (SELECT conv_id, turn, {surface} * {bm25} AS us FROM post JOIN size USING (conv_id, turn) JOIN df USING (term), total WHERE term = '{w}'),
            w{i} AS (SELECT conv_id, turn, p_{i}, greatest(ls, coalesce(us, 0)) AS s_{i} FROM l{i} LEFT JOIN u{i} USING (conv_id, turn))""")
    joined = "turns" + "".join(f" LEFT JOIN w{i} USING (conv_id, turn)" for i in range(len(words)))
    return f"{_LOWER}, {', '.join(parts)}, scored AS (SELECT * FROM {joined})"


def _ranked(words: list[str], where: str, total: str, covered: str, boosts=None, scored: str | None = None) -> str:
    return f"""{scored or _scored(words, boosts)}, ranked AS (SELECT conv_id, turn, {total} AS total, {covered} AS covered FROM scored WHERE {where})
    SELECT conv_id, turn, round(total / max(total) OVER (), 6) AS score, round(total, 6) AS raw, CAST(covered AS BIGINT) AS covered FROM ranked"""


_SUM2 = "(coalesce(s_0, 0) + coalesce(s_1, 0))"
_COVER2 = "(CASE WHEN s_0 IS NULL THEN 0 ELSE 1 END + CASE WHEN s_1 IS NULL THEN 0 ELSE 1 END)"
_TWO = f"{_SUM2} * pow({_COVER2} / 2.0, 1.5) * {_NEAR} * {_RECENCY}"


def _phrase_sql(words: list[str], slop: int) -> str:
    """A phrase of two words: a start counts if the next later place of the second word is near enough."""
    count = f"len(list_filter(p_0, lambda x: coalesce(list_min(list_filter(p_1, lambda y: y > x)) - x - 1 <= {slop}, false)))"
    return f"""{_scored(words)}, counted AS (SELECT conv_id, turn, ts, len(words) AS size, {count} AS k FROM scored WHERE p_0 IS NOT NULL AND p_1 IS NOT NULL),
    ranked AS (SELECT conv_id, turn, (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) FROM df WHERE term IN ('{words[0]}', '{words[1]}')) * 2.2 * k / (k + 1.2 * (0.25 + 0.75 * size / mean)) * {_RECENCY} AS total
               FROM counted, total WHERE k > 0)
    SELECT conv_id, turn, round(total / max(total) OVER (), 6) AS score, round(total, 6) AS raw, CAST(1 AS BIGINT) AS covered FROM ranked"""


def _prefix_sql(word: str, start: str) -> str:
    """A word followed by any of the first terms that start so; the word alone has weight."""
    return f"""{_scored([word])}, tails AS (SELECT term FROM df WHERE starts_with(term, '{start}') ORDER BY term LIMIT {MOST_EXPANSIONS}),
    later AS (SELECT conv_id, turn, flatten(list(positions)) AS q FROM post WHERE term IN (SELECT term FROM tails) GROUP BY ALL),
    counted AS (SELECT conv_id, turn, ts, len(words) AS size, len(list_filter(p_0, lambda x: list_contains(q, x + 1))) AS k FROM scored JOIN later USING (conv_id, turn) WHERE p_0 IS NOT NULL),
    ranked AS (SELECT conv_id, turn, (SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM df WHERE term = '{word}') * 2.2 * k / (k + 1.2 * (0.25 + 0.75 * size / mean)) * {_RECENCY} AS total FROM counted, total WHERE k > 0)
    SELECT conv_id, turn, round(total / max(total) OVER (), 6) AS score, round(total, 6) AS raw, CAST(1 AS BIGINT) AS covered FROM ranked"""


_EITHER = "s_0 IS NOT NULL OR s_1 IS NOT NULL"


def _filter_sql(where: str) -> str:
    return f"{_scored(['the'])} SELECT conv_id, turn, round(s_0 * {_RECENCY}, 6) AS raw FROM scored WHERE s_0 IS NOT NULL AND {where}"


_T0 = BASE_TS + 5 * 100 * STEP
_T1 = BASE_TS + 40 * 100 * STEP

QUERIES = {
    "list_memories": list_memories,
    "outline_sessions": outline_sessions,
    "outline_messages": outline_messages,
    "segment_tokens": segment_tokens,
    "surface_postings": surface_postings,
    "surface_df": surface_df,
    "field_totals": field_totals,
    "bm25_term": _query("surface:the"),
    "bm25_two_ideas": _query("surface:the surface:and"),
    "best_in_clause": _query("(surface:the surface:and)"),
    "sum_in_clause": _query("(+surface:the +surface:and)"),
    "boosted": _query("(surface:the surface:and^2.5)"),
    "required_excluded": _query("+surface:the -surface:and"),
    "all_required": _query("surface:the AND surface:and"),
    "in_list": _query("surface: IN [the and]"),
    "phrase_exact": _query('surface:"of the"'),
    "phrase_slop": _query('surface:"the of"~3'),
    "proximity_span": _query("+surface:of +surface:the"),
    "recency_decay": _query("surface:the", as_of=AS_OF + 400 * 24 * 3600 * 1000),
    "filter_role": _filtered(Filter(roles=("assistant", "tool"))),
    "filter_time": _filtered(Filter(after=_T0, before=_T1)),
    "filter_session": _filtered(None, "3"),
    "topk_per_message": topk_per_message,
    "cursor_units": _cursor(False),
    "cursor_messages": _cursor(True),
    "context_terms": context_terms,
    "fuzzy_terms": fuzzy_terms,
    "sentences": sentences,
    "markdown_units": markdown_units,
    "phrase_prefix": _query('surface:"of th"*'),
    "lemma_search": _query("lemma:the lemma:and", kind="lower"),
    "stemmed_search": stemmed_search,
    "all_fields": _query("the and", kind="lower"),
    "lexicon": lexicon,
    "vocabulary": vocabulary,
    "hints": hints,
    "snippets": snippets,
    "window_grouped": window_grouped,
    "engine_list": engine_list,
    "engine_outline": engine_outline,
    "engine_terms": engine_terms,
    "engine_search": engine_search,
}

ORACLE = {
    "list_memories": "SELECT lang AS memory, count(DISTINCT source) AS sessions, count(*) AS messages FROM documents GROUP BY lang",
    "outline_sessions": f"SELECT conv_id, {BASE_TS} + (conv_id * 100 + min(turn)) * {STEP} AS started_at, count(*) AS messages, count(*) FILTER (WHERE trim(text) <> '') AS units FROM conversations GROUP BY conv_id",
    "outline_messages": f"SELECT conv_id, turn AS seq, CASE WHEN role IN ('user', 'assistant', 'tool') THEN role ELSE 'tool' END AS role, {BASE_TS} + (conv_id * 100 + turn) * {STEP} AS ts, length(text) AS characters, CAST(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END AS BIGINT) AS units FROM conversations",
    "segment_tokens": f"{_BASE} SELECT conv_id, turn, pos, term AS word FROM token",
    "surface_postings": f"{_BASE} SELECT conv_id, turn, term, tf, array_to_string(positions, ',') AS positions, CAST(len AS BIGINT) AS len FROM post JOIN size USING (conv_id, turn)",
    "surface_df": f"{_BASE} SELECT term, df FROM df",
    "field_totals": f"{_BASE} SELECT 'surface' AS field, n AS n_units, (SELECT CAST(sum(len) AS BIGINT) FROM size) AS total_len FROM total",
    "bm25_term": _ranked(["the"], "s_0 IS NOT NULL", f"s_0 * {_RECENCY}", "1"),
    "bm25_two_ideas": _ranked(["the", "and"], "s_0 IS NOT NULL OR s_1 IS NOT NULL", _TWO, _COVER2),
    "best_in_clause": _ranked(["the", "and"], "s_0 IS NOT NULL OR s_1 IS NOT NULL", f"greatest(coalesce(s_0, 0), coalesce(s_1, 0)) * {_RECENCY}", "1"),
    "sum_in_clause": _ranked(["the", "and"], "s_0 IS NOT NULL AND s_1 IS NOT NULL", f"{_SUM2} * {_RECENCY}", "1"),
    "boosted": _ranked(["the", "and"], "s_0 IS NOT NULL OR s_1 IS NOT NULL", f"greatest(coalesce(s_0, 0), coalesce(s_1, 0)) * {_RECENCY}", "1", {"and": 2.5}),
    "required_excluded": _ranked(["the", "and"], "s_0 IS NOT NULL AND s_1 IS NULL", f"s_0 * {_RECENCY}", "1"),
    "all_required": _ranked(["the", "and"], "s_0 IS NOT NULL AND s_1 IS NOT NULL", _TWO, _COVER2),
    "in_list": _ranked(["the", "and"], "s_0 IS NOT NULL OR s_1 IS NOT NULL", f"greatest(coalesce(s_0, 0), coalesce(s_1, 0)) * {_RECENCY}", "1"),
    "phrase_exact": _phrase_sql(["of", "the"], 0),
    "phrase_slop": _phrase_sql(["the", "of"], 3),
    "proximity_span": _ranked(["of", "the"], "s_0 IS NOT NULL AND s_1 IS NOT NULL", _TWO, _COVER2),
    "recency_decay": _ranked(["the"], "s_0 IS NOT NULL", f"s_0 * {_RECENCY.replace(str(AS_OF), str(AS_OF + 400 * 24 * 3600 * 1000))}", "1"),
    "filter_role": _filter_sql("role IN ('assistant', 'tool')"),
    "filter_time": _filter_sql(f"ts BETWEEN {_T0} AND {_T1}"),
    "filter_session": _filter_sql("conv_id = 3"),
    "topk_per_message": f"""{_scored(["the", "and"]).replace("(conv_id * 100 + turn)", "conv_id")},
        best AS (SELECT conv_id, turn, {_TWO} AS total FROM scored WHERE s_0 IS NOT NULL OR s_1 IS NOT NULL ORDER BY total DESC, conv_id, turn LIMIT 40),
        capped AS (SELECT *, max(total) OVER () AS top, row_number() OVER (PARTITION BY conv_id ORDER BY total DESC, turn) AS nth FROM best),
        placed AS (SELECT *, row_number() OVER (ORDER BY total DESC, conv_id, turn) AS rank FROM capped WHERE nth <= 1)
        SELECT rank, conv_id, round(total, 6) AS raw, round(total / top, 6) AS score FROM placed WHERE rank <= 10""",
    "cursor_units": "SELECT conv_id, turn, turn = 1 AS anchor FROM conversations WHERE turn BETWEEN 0 AND 3 AND trim(text) <> '' AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 1)",
    "cursor_messages": "SELECT conv_id, turn, turn = 1 AS anchor FROM conversations WHERE turn BETWEEN 0 AND 3 AND trim(text) <> '' AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 1)",
    "context_terms": f"""WITH own AS (SELECT conv_id, turn, list_distinct(list_transform({_WORDS}, lambda w: lower(w))) AS words FROM conversations),
        every AS (SELECT conv_id, list_sort(list_distinct(flatten(list(words)))) AS words FROM own GROUP BY conv_id)
        SELECT CAST(o.conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS unit_id, array_to_string(list_filter(e.words, lambda w: NOT list_contains(o.words, w))[1:8], ' ') AS context
        FROM own o JOIN every e USING (conv_id)""",
    "fuzzy_terms": f"{_BASE} SELECT term, df FROM df WHERE damerau_levenshtein(term, 'ther') = 1",
    "sentences": r"""WITH cut AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?؟؛\n])(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10) || chr(9) || chr(13))), lambda s: s <> '') AS s FROM conversations)
        SELECT conv_id, turn, unnest(range(len(s))) AS nth, unnest(s) AS sentence FROM cut""",
    "phrase_prefix": _prefix_sql("of", "th"),
    "lemma_search": _ranked(["the", "and"], _EITHER, _TWO, _COVER2, scored=_lower_scored(["the", "and"], 0.0, 0.9)),
    "all_fields": _ranked(["the", "and"], _EITHER, _TWO, _COVER2, scored=_lower_scored(["the", "and"], 1.0, 0.9)),
    "lexicon": f"""{_LOWER} SELECT word, surface, lemma, coalesce(df.df, 0) AS surface_units, coalesce(ldf.df, 0) AS lemma_units, CAST(0 AS BIGINT) AS context_units
        FROM (VALUES ('the', 'the', 'the'), ('And', 'And', 'and'), ('nothinglikeit', 'nothinglikeit', 'nothinglikeit')) v(word, surface, lemma)
        LEFT JOIN df ON df.term = surface LEFT JOIN ldf ON ldf.term = lemma""",
    "vocabulary": f"{_LOWER} SELECT term, df AS units FROM ldf, total WHERE df <= floor(0.15 * n) ORDER BY units DESC, term LIMIT 60",
    "hints": f"""{_lower_scored(["the", "and"], 1.0, 0.9)},
        best AS (SELECT conv_id, turn, words, {_TWO} AS total FROM scored WHERE {_EITHER} ORDER BY total DESC, conv_id, turn LIMIT 10),
        held AS (SELECT DISTINCT lower(unnest(words)) AS term FROM best)
        SELECT term, df AS units FROM held JOIN ldf USING (term) WHERE term NOT IN ('the', 'and') AND df >= 2 ORDER BY units, term LIMIT 6""",
    "window_grouped": "SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant', 'tool') THEN role ELSE 'tool' END AS role, CAST(1 AS BIGINT) AS units, turn = 0 AS anchor FROM conversations WHERE turn IN (0, 1) AND trim(text) <> '' AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0 AND trim(text) <> '')",
    "engine_list": "SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS memory, count(DISTINCT conv_id) AS sessions, count(*) AS messages, count(*) FILTER (WHERE trim(text) <> '') AS units FROM conversations GROUP BY 1",
    "engine_outline": "SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE trim(text) <> '') AS units FROM conversations GROUP BY conv_id",
    "engine_terms": f"{_BASE} SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS memory, term, count(*) AS df FROM post GROUP BY 1, 2",
    "engine_search": " UNION ALL ".join(f"({_filter_sql('true').replace('FROM conversations WHERE', f'FROM conversations WHERE conv_id % 2 = {k} AND')})" for k in (0, 1)),
}

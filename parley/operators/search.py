"""Search: a compiled query over the postings of one memory, ranked, capped per message and cut into snippets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize
from ..plans.compiler import COVERAGE_POWER, MOST_EXPANSIONS, Compiler, Plan, Statistics, proximity, recency, wanted
from ..plans.parser import FIELDS, parse

#: Candidates for each hit asked for, hints, and the units that a hint must stand in (fixed values).
OVERFETCH, HINTS, HINT_LEAST = 4, 6, 2
#: The most hits that are sent to the texts; more meet them in a join that Spark chooses.
SENT = 10_000


@dataclass
class Index:
    """The tables of one memory, or of several of which one is chosen by name. Statistics are always the memory's own."""

    units: DataFrame
    postings: DataFrame
    memory: str | None = None
    stats: DataFrame | None = None  # written term statistics, else they are counted from the postings
    sizes: DataFrame | None = None  # written numbers of units and terms
    forms: Callable[[Column], Column] = normalize.forms  # the rules that made the postings
    _counts: tuple[int, dict[str, float]] | None = field(default=None, repr=False)

    def of(self, table: DataFrame) -> DataFrame:
        return table if self.memory is None else table.where(F.col("memory") == self.memory)

    def counts(self) -> tuple[int, dict[str, float]]:
        """The number of units and each field's mean number of terms; asked once."""
        if self._counts is None and self.sizes is not None:
            rows = {r.field: r for r in self.of(self.sizes).groupBy("field").agg(F.sum("n_units").alias("n"), F.sum("total_len").alias("total")).collect()}
            n = rows["*"].n if "*" in rows else 0
            self._counts = n, {f: (rows[f].total if f in rows else 0) / max(n, 1) for f in FIELDS}
        if self._counts is None:
            n = self.of(self.units).count()
            total = {r[0]: r[1] for r in self.of(self.postings).groupBy("field").agg(F.sum("tf")).collect()}
            self._counts = n, {f: total.get(f, 0) / max(n, 1) for f in FIELDS}
        return self._counts

    def term_stats(self, only: DataFrame | None = None) -> DataFrame:
        """(field, term, df), of the terms in only(term) if that is given. Sums over the segments' written statistics."""
        some = (lambda t: t) if only is None else (lambda t: t.join(only, "term", "left_semi"))
        if self.stats is not None:
            return some(self.of(self.stats)).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
        return some(self.of(self.postings)).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))

    def lemma_stats(self) -> DataFrame:
        return self.term_stats().where("field = 'lemma'").select("term", "df")

    def lookup(self, terms: set, prefixes: set, loose: set) -> Statistics:
        """Frequencies of a query's terms; what it may expand to. One small job, bounded by the query."""
        n, mean = self.counts()
        held = self.term_stats()
        some = [(F.col("field") == f) & F.col("term").isin(*sorted(t for g, t in terms if g == f)) for f in sorted({f for f, _ in terms})]
        df = {}
        if some:
            df = {(r.field, r.term): r.df for r in held.where(reduce(lambda a, b: a | b, some)).collect()}
        starting: dict = {}
        for f, p in sorted(prefixes):
            rows = held.where((F.col("field") == f) & F.col("term").startswith(p)).orderBy("term").limit(MOST_EXPANSIONS).collect()
            starting[f, p] = [r.term for r in rows]
            df |= {(f, r.term): r.df for r in rows}
        similar: dict = {}
        for w in sorted(loose):
            stem = normalize.lemma(w)
            rows = self.term_stats().where((F.col("field") == "lemma") & one_error(F.col("term"), stem)).orderBy("term").collect()
            similar[w] = [r.term for r in rows]
            df |= {("lemma", r.term): r.df for r in rows}
        return Statistics(n, mean, df, starting, similar)


def one_error(term: Column, word: str) -> Column:
    """One substitution, insertion, deletion or swap of neighbours away. The length is compared first."""
    near = F.abs(F.length(term) - len(word)) <= 1
    swaps = sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})
    swapped = term.isin(*swaps) if swaps else F.lit(False)
    return near & (term != word) & ((F.levenshtein(term, F.lit(word), 1) == 1) | swapped)


@dataclass
class Filter:
    session: str | None = None
    after: int | None = None  # inclusive, as is before
    before: int | None = None
    roles: tuple[str, ...] = ()

    def keeps(self) -> Column:
        out = F.lit(True)
        if self.session is not None:
            out = out & (F.col("session_id") == self.session)
        if self.after is not None:
            out = out & (F.col("ts") >= self.after)
        if self.before is not None:
            out = out & (F.col("ts") <= self.before)
        return out & F.col("role").isin(*self.roles) if self.roles else out


@dataclass
class Found:
    hits: DataFrame
    unknown: list[tuple[str, str]]  # clause, word
    fuzzy: list[tuple[str, list[str]]]  # word, lemmas taken instead
    hints: DataFrame  # term, units


HIT = "rank int, unit_id string, message_id string, session_id string, session_ref string, message_ref string, author string, role string, ts bigint, score double, raw double, covered int, ideas int, matched array<string>, nearby array<string>, words int, snippet string, text string"


def occurrences(postings: DataFrame, terms: dict) -> DataFrame:
    """One row per unit that holds any of the terms: tf_i and at_i of each, and the field lengths. One shuffle, with
    partial aggregation; the terms reach the scan as filters."""
    fields = sorted({f for f, _ in terms})
    some = [(F.col("field") == f) & F.col("term").isin(*sorted(t for g, t in terms if g == f)) for f in fields]
    aggs = []
    for (f, t), i in terms.items():
        here = (F.col("field") == f) & (F.col("term") == t)
        aggs += [F.max(F.when(here, F.col("tf"))).alias(f"tf_{i}"), F.first(F.when(here, F.col("positions")), ignorenulls=True).alias(f"at_{i}")]
    lens = [F.max(F.when(F.col("field") == f, F.col("len"))).alias(f"len_{f}") for f in FIELDS]
    return postings.where(reduce(lambda a, b: a | b, some)).groupBy("unit_id").agg(*aggs, *lens)


def score_units(index: Index, plan: Plan, compiler: Compiler, keep: Filter, as_of: int) -> DataFrame:
    """Every matching unit with its scores; filters narrow the units, never the statistics."""
    place = index.of(index.units).where(keep.keeps()).select("unit_id", "message_id", "session_id", "ts", "ord", "message_seq", "unit_seq")
    rows = occurrences(index.of(index.postings), compiler.columns.number).join(place, "unit_id").where(plan.match)
    rows = rows.select("*", *[c.score.alias(f"s_{i}") for i, (_, _, c) in enumerate(plan.ideas)], *[c.direct.alias(f"d_{i}") for i, (_, _, c) in enumerate(plan.ideas)], *[F.array_distinct(c.positions).alias(f"p_{i}") for i, (_, _, c) in enumerate(plan.ideas)])
    n = len(plan.ideas)
    hits = reduce(lambda a, b: a + b, [(F.col(f"s_{i}") > 0).cast("int") for i in range(n)])
    raw = reduce(lambda a, b: a + b, [F.greatest(F.col(f"s_{i}"), F.lit(0.0)) for i in range(n)])
    name = F.array(*[F.lit(text) for _, text, _ in plan.ideas])
    chosen = lambda test: F.filter(F.transform(F.array(*[F.when(test(i), F.lit(i)) for i in range(n)]), lambda k: F.when(k.isNotNull(), F.element_at(name, k + 1))), lambda x: x.isNotNull())
    rows = rows.select("*", hits.alias("covered"), F.lit(n).alias("ideas"), raw.alias("raw_sum")).where("covered > 0")
    total = F.col("raw_sum") * F.pow(F.col("covered") / float(n), COVERAGE_POWER) * proximity([F.col(f"p_{i}") for i in range(n)]) * recency(F.col("ts"), as_of)
    return rows.select(
        "unit_id", "message_id", "ord", "message_seq", "unit_seq", "covered", "ideas", F.col("raw_sum").alias("raw"), total.alias("total"),
        chosen(lambda i: (F.col(f"s_{i}") > 0) & F.col(f"d_{i}")).alias("matched"), chosen(lambda i: (F.col(f"s_{i}") > 0) & ~F.col(f"d_{i}")).alias("nearby"),
    )


def snippet(sentences: Column, text: Column, ideas: list[set[str]]) -> Column:
    """The first sentence with a word of the most ideas; the whole text if it has one sentence or none has a word."""

    @F.pandas_udf("string")
    def run(parts: pd.Series, whole: pd.Series) -> pd.Series:
        out = []
        for p, w in zip(parts, whole, strict=True):
            best, most = w, 0
            for s in p if p is not None and len(p) > 1 else []:
                forms = {f for word in normalize.segment(s) for f in (normalize.surface(word), normalize.lemma(word))}
                n = sum(not forms.isdisjoint(i) for i in ideas)
                if n > most:
                    best, most = s, n
            out.append(best)
        return pd.Series(out)

    return run(sentences, text)


def search(index: Index, query: str, fuzzy: bool = False, limit: int | None = 10, max_per_message: int | None = 2, keep: Filter | None = None, as_of: int = 0) -> Found:
    """The ranked hits of a query. as_of is the time that recency counts from, in milliseconds; a limit or cap of 0 has no hits.
    Without a limit (None) every hit is returned, unordered and with a null rank; without a cap (None) every unit of a message counts."""
    spark, keep = index.units.sparkSession, keep or Filter()
    parts = parse(query)
    terms, prefixes, loose = wanted(parts)
    compiler = Compiler(index.lookup(terms, prefixes, loose if fuzzy else set()), fuzzy)
    plan = compiler.plan(parts)
    none = spark.createDataFrame([], "term string, units bigint")
    if plan.empty or (limit is not None and limit < 1) or (max_per_message is not None and max_per_message < 1):
        return Found(spark.createDataFrame([], HIT), plan.unknown, plan.fuzzy, none)
    order = [F.desc("total"), "ord", "message_seq", "unit_seq", "unit_id"]
    top = score_units(index, plan, compiler, keep, as_of)
    if limit is not None:
        top = top.orderBy(*order).limit(OVERFETCH * limit)
        # at most OVERFETCH * limit rows from here on
        top = top.withColumn("best", F.max("total").over(Window.partitionBy()))
    else:
        top = top.crossJoin(F.broadcast(top.agg(F.max("total").alias("best"))))
    if max_per_message is not None:
        top = top.withColumn("nth", F.row_number().over(Window.partitionBy("message_id").orderBy(*order))).where(F.col("nth") <= max_per_message)
    if limit is not None:
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).where(F.col("rank") <= limit)
        top = F.broadcast(top) if limit <= SENT else top
    else:
        top = top.withColumn("rank", F.lit(None).cast("int"))
    # texts are read for the hits only
    text = index.of(index.units).select("unit_id", "session_id", "session_ref", "message_ref", "author", "role", "ts", "text", "sentences")
    full = top.join(text, "unit_id")
    ideas = [c.texts for _, _, c in plan.ideas]
    hits = full.select(
        "rank", "unit_id", "message_id", "session_id", "session_ref", "message_ref", "author", "role", "ts",
        F.when(F.col("best") > 0, F.col("total") / F.col("best")).otherwise(0.0).alias("score"), F.col("total").alias("raw"), "covered", "ideas", "matched", "nearby",
        F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"), snippet(F.col("sentences"), F.col("text"), ideas).alias("snippet"), "text",
    )
    hits = hits if limit is None else hits.orderBy("rank")
    return Found(hits, plan.unknown, plan.fuzzy, hints(index, hits, set().union(*ideas), limit is not None and limit <= SENT))


def hints(index: Index, hits: DataFrame, asked: set[str], few: bool = True) -> DataFrame:
    """Lemmas of the hits that the query didn't ask for and that HINT_LEAST units or more hold, rarest first."""
    lemmas = hits.select(F.explode(index.forms(normalize.words(F.col("text")))["lemma"]).alias("term")).where("term <> ''").distinct()
    if asked:
        lemmas = lemmas.where(~F.col("term").isin(*sorted(asked)))
    # only the statistics of those lemmas are summed
    known = index.term_stats(F.broadcast(lemmas) if few else lemmas).where("field = 'lemma'").where(F.col("df") >= HINT_LEAST)
    return known.select("term", F.col("df").alias("units")).orderBy("units", "term").limit(HINTS)

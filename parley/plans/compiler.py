"""From a parsed query to Columns over one row per unit.

A query is compiled on the driver with the statistics of its own terms only. It yields probes (a term or
phrase in one field) and, per idea, Column expressions for whether a unit matches, what it scores, whether
the idea is written there itself, and where. Matching and scoring are separate trees: a required part
inside an idea decides matching at the top level only, while the score adds it up in any case."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import normalize
from .parser import FIELDS, MOST_IDEAS, MUST, NOT, SHOULD, AnyOf, Boost, Clause, Leaf, Node, NoPrefix, OnlyUnwanted, TooManyIdeas, label

# fixed values of the ranking
K1, B = 1.2, 0.75
TIER = {"surface": 1.0, "lemma": 0.9, "fuzzy": 0.5, "context": 0.35}
COVERAGE_POWER, NEARNESS, FLOOR, HALF_LIFE_MS = 1.5, 0.5, 0.3, 90 * 24 * 3600 * 1000
FUZZY_LEAST = 5
#: Terms that a phrase's last word may stand for.
MOST_EXPANSIONS = 50

Term = tuple[str, str]  # field, term


@dataclass
class Statistics:
    """What the driver knows of a memory: the units, each field's mean length, and the units that hold the query's terms."""

    n_units: int
    mean_len: dict[str, float]
    df: dict[Term, int]
    starting: dict[Term, list[str]] = field(default_factory=dict)  # terms that start with a prefix
    similar: dict[str, list[str]] = field(default_factory=dict)  # lemmas one typing error away from a word


@dataclass
class Compiled:
    match: Column
    score: Column
    direct: Column
    positions: Column  # array<int>
    terms: set[Term]
    texts: set[str]
    empty: bool  # no probe: it can match nothing


@dataclass
class Plan:
    ideas: list[tuple[str, str, Compiled]]  # occur, label, of the ideas that count
    match: Column
    terms: set[Term]
    unknown: list[tuple[str, str]] = field(default_factory=list)  # clause, word
    fuzzy: list[tuple[str, list[str]]] = field(default_factory=list)  # word, lemmas taken
    empty: bool = False


class Columns:
    """Names of the columns of a term: how often it stands in the unit, and where; and of a field's length."""

    def __init__(self):
        self.number: dict[Term, int] = {}

    def of(self, term: Term) -> int:
        return self.number.setdefault(term, len(self.number))

    def tf(self, term: Term) -> Column:
        return F.col(f"tf_{self.of(term)}")

    def at(self, term: Term) -> Column:
        return F.coalesce(F.col(f"at_{self.of(term)}"), F.expr("cast(array() as array<int>)"))


NOWHERE = "cast(array() as array<int>)"


def bm25(tf: Column, length: Column, idf: float, mean: float) -> Column:
    return F.lit(idf * (K1 + 1)) * tf / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def phrase_count(places: list[Column], slop: int) -> Column:
    """How many positions of the first word start the phrase: each later word after the one before it, with at
    most `slop` other words in between altogether. The nearest later position is the best choice at each step."""

    def reach(start: Column) -> Column:
        last = start
        for p in places[1:]:
            last = _next(p, last)
        return last

    if len(places) == 1:
        return F.size(places[0])
    return F.size(F.filter(places[0], lambda x: F.coalesce(reach(x) - x - (len(places) - 1) <= slop, F.lit(False))))


def _next(places: Column, after: Column) -> Column:
    return F.array_min(F.filter(places, lambda y: y > after))


def words_of(leaf: Leaf) -> list[str]:
    return normalize.segment(leaf.text)


def form(word: str, name: str) -> str:
    return normalize.surface(word) if name == "surface" else normalize.lemma(word)


def wanted(parts: list[tuple[str, Node]]) -> tuple[set[Term], set[Term], set[str]]:
    """Of a query: the terms whose frequencies it needs, the prefixes it needs expanded, and the words that may be
    read with a typing error."""
    terms, prefixes, loose = set(), set(), set()

    def visit(node: Node, negated: bool) -> None:
        if isinstance(node, Clause):
            for o, n in node.parts:
                visit(n, negated or o == NOT)
        elif isinstance(node, Boost):
            visit(node.node, negated)
        elif isinstance(node, AnyOf):
            for item in node.items:
                visit(Leaf(item, node.field), negated)
        else:
            words = words_of(node)
            for f in (node.field,) if node.field else FIELDS:
                terms.update((f, form(w, f)) for w in words)
                if node.prefix and words:
                    prefixes.add((f, form(words[-1], f)))
            if len(words) == 1 and not node.prefix and not negated and node.field in (None, "lemma") and len(words[0]) >= FUZZY_LEAST and form(words[0], "lemma"):
                loose.add(words[0])

    for o, n in parts:
        visit(n, o == NOT)
    return terms, prefixes, loose


class Compiler:
    def __init__(self, stats: Statistics, fuzzy: bool):
        self.stats, self.fuzzy, self.columns = stats, fuzzy, Columns()
        self.unknown: list[tuple[str, str]] = []
        self.taken: dict[str, list[str]] = {}

    def plan(self, parts: list[tuple[str, Node]]) -> Plan:
        if all(o == NOT for o, _ in parts):
            raise OnlyUnwanted("every part is excluded")
        compiled = [(o, label(n), self.node(n, o == NOT, label(n))) for o, n in parts]
        ideas = [x for x in compiled if x[0] != NOT and not x[2].empty]
        if len(ideas) > MOST_IDEAS:
            raise TooManyIdeas(f"at most {MOST_IDEAS} ideas")
        empty = not ideas or any(o == MUST and c.empty for o, _, c in compiled)
        terms = set().union(*(c.terms for _, _, c in compiled))
        return Plan(ideas, _boolean([(o, c.match) for o, _, c in compiled]), terms, self.unknown, list(self.taken.items()), empty)

    def node(self, node: Node, negated: bool, clause: str) -> Compiled:
        if isinstance(node, Boost):
            c = self.node(node.node, negated, clause)
            return Compiled(c.match, c.score * node.by, c.direct, c.positions, c.terms, c.texts, c.empty)
        if isinstance(node, AnyOf):
            node = Clause(tuple((SHOULD, Leaf(i, node.field)) for i in node.items))
        if isinstance(node, Leaf):
            return self.leaf(node, negated, clause)
        parts = [(o, self.node(n, negated or o == NOT, clause)) for o, n in node.parts]
        scored = [(o, c) for o, c in parts if o != NOT and not c.empty]
        zero = F.lit(0.0)
        must = reduce(lambda a, b: a + b, [F.greatest(c.score, zero) for o, c in scored if o == MUST], zero)
        best = reduce(F.greatest, [c.score for o, c in scored if o != MUST], zero)
        direct = reduce(lambda a, b: a | b, [c.direct & (c.score > 0) for _, c in scored], F.lit(False))
        positions = reduce(F.concat, [c.positions for _, c in scored], F.expr(NOWHERE))
        terms, texts = set().union(*(c.terms for _, c in parts)), set().union(*(c.texts for _, c in scored))
        return Compiled(_boolean([(o, c.match) for o, c in parts]), must + best, direct, positions, terms, texts, not scored)

    def leaf(self, leaf: Leaf, negated: bool, clause: str) -> Compiled:
        words = words_of(leaf)
        if leaf.prefix and len(words) < 2:
            raise NoPrefix("a prefix needs a word before it")
        probes: list[Compiled] = []
        known: set[int] = set()
        for f in (leaf.field,) if leaf.field else FIELDS:
            terms = [(f, form(w, f)) for w in words]
            held = [self.stats.df.get(t, 0) > 0 for t in terms]
            known |= {i for i, h in enumerate(held) if h}
            if not words:
                continue
            if len(words) == 1:
                if held[0]:
                    probes.append(self.term(terms[0], TIER[f]))
            elif f != "context":
                tails = [(f, t) for t in self.stats.starting.get(terms[-1], [])[:MOST_EXPANSIONS]] if leaf.prefix else [terms[-1]]
                if all(held[:-1]) and (tails if leaf.prefix else held[-1]):
                    probes.append(self.phrase(terms[:-1], tails, leaf.slop, TIER[f], leaf.prefix))
        if not negated:
            for i, w in enumerate(words):
                if i in known or (leaf.prefix and i == len(words) - 1):
                    continue
                near = self.stats.similar.get(w, []) if self.fuzzy and len(words) == 1 else []
                if near:
                    self.taken[w] = near
                    probes += [self.term(("lemma", t), TIER["fuzzy"]) for t in near]
                elif (clause, w) not in self.unknown:
                    self.unknown.append((clause, w))
        if not probes:
            return Compiled(F.lit(False), F.lit(0.0), F.lit(False), F.expr(NOWHERE), set(), set(), True)
        any_ = reduce(lambda a, b: a | b, [p.match for p in probes])
        direct = reduce(lambda a, b: a | b, [p.direct for p in probes])
        positions = F.concat(*[p.positions for p in probes])
        score = reduce(F.greatest, [p.score for p in probes], F.lit(0.0))
        return Compiled(any_, score, direct, positions, set().union(*(p.terms for p in probes)), set().union(*(p.texts for p in probes)), False)

    def term(self, term: Term, weight: float) -> Compiled:
        f, tf = term[0], self.columns.tf(term)
        here = tf.isNotNull()
        score = bm25(tf, F.col(f"len_{f}"), idf(self.stats.n_units, self.stats.df[term]), self.stats.mean_len[f]) * weight
        places = F.expr(NOWHERE) if f == "context" else self.columns.at(term)
        return Compiled(here, F.when(here, score).otherwise(0.0), here & F.lit(f != "context"), places, {term}, {term[1]}, False)

    def phrase(self, head: list[Term], tails: list[Term], slop: int, weight: float, prefix: bool) -> Compiled:
        f = head[0][0]
        last = reduce(F.concat, [self.columns.at(t) for t in tails])
        count = phrase_count([*(self.columns.at(t) for t in head), last], slop)
        weighed = head if prefix else head + tails
        total = sum(idf(self.stats.n_units, self.stats.df[t]) for t in weighed)
        here = count > 0
        score = bm25(count, F.col(f"len_{f}"), total, self.stats.mean_len[f]) * weight
        every = F.concat(*[self.columns.at(t) for t in head], last)
        return Compiled(here, F.when(here, score).otherwise(0.0), here, F.when(here, every).otherwise(F.expr(NOWHERE)), {*head, *tails}, {t for _, t in (*head, *tails)}, False)


def _boolean(parts: list[tuple[str, Column]]) -> Column:
    """All required, none excluded, and at least one of the others if none is required."""
    must = [c for o, c in parts if o == MUST]
    may = [c for o, c in parts if o == SHOULD]
    out = reduce(lambda a, b: a & b, must) if must else reduce(lambda a, b: a | b, may) if may else F.lit(False)
    for c in (c for o, c in parts if o == NOT):
        out = out & ~c
    return out


def narrowest(ideas: list[Column]) -> Column:
    """The width, last less first position, of the narrowest window with a position of each idea that has any, and
    the number k of those: struct(k, span). One pass over all positions in order, with each idea's last one."""
    tagged = F.array_sort(F.concat(*[F.transform(p, _tag(i)) for i, p in enumerate(ideas)]))
    has = F.array(*[F.size(p) > 0 for p in ideas])
    k = F.size(F.filter(has, lambda x: x))
    zero = F.struct(F.transform(F.array(*[F.lit(i) for i in range(len(ideas))]), lambda i: F.lit(-1)).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(state: Column, x: Column) -> Column:
        last = F.transform(state["last"], lambda v, i: F.when(i == x["idea"], x["at"]).otherwise(v))
        seen = F.filter(last, lambda v: v >= 0)
        width = F.when(F.size(seen) == k, x["at"] - F.array_min(seen))
        return F.struct(last.alias("last"), F.least(state["best"], width).alias("best"))

    return F.struct(k.alias("k"), F.aggregate(tagged, zero, step)["best"].alias("span"))


def _tag(i: int):
    return lambda x: F.struct(x.alias("at"), F.lit(i).alias("idea"))


def proximity(ideas: list[Column]) -> Column:
    if len(ideas) < 2:
        return F.lit(1.0)
    w = narrowest(ideas)
    return F.when(w["k"] < 2, 1.0).otherwise(1 + NEARNESS / (1 + F.greatest(F.lit(0), w["span"] - (w["k"] - 1))))


def recency(ts: Column, as_of: int) -> Column:
    age = F.greatest(F.lit(0), F.lit(as_of) - ts)
    return FLOOR + (1 - FLOOR) * F.pow(F.lit(0.5), age / float(HALF_LIFE_MS))

"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regex gives a Boolean query over trigrams that any match must contain. The index holds postings
(trigram, texts) for the trigrams that the rules' queries name; a query intersects and unites postings, and
only its candidates are verified with the regex. A rule without mandatory trigrams scans all texts."""

from __future__ import annotations

import re._parser as sre  # the standard library's regex parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # Java and Python read it alike; kinds match without overlap, leftmost first
    group: int  # the group whose length counts
    least: int  # code points


# fixed values: the rules that every scan has
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Rules that the method adds.
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
#: Strings that a part of a regex may stand for before it counts as unknown.
MOST_STRINGS = 64

Query = frozenset  # of frozensets of trigrams: any of the sets, all of a set's trigrams; the empty set in it: no condition
ANY: Query = frozenset({frozenset()})


def _trigrams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a: Query, b: Query) -> Query:
    joined = {x | y for x in a for y in b}
    return frozenset(x for x in joined if not any(y < x for y in joined))


def trigram_query(regex: str) -> Query:
    """What lower-cased trigrams a text that matches must contain."""

    def strings(items) -> set[str] | None:
        """All strings that the items match, or None if they are unknown or too many."""
        out = {""}
        for op, arg in items:
            part = one(op, arg)
            if part is None or len(out) * len(part) > MOST_STRINGS:
                return None
            out = {x + y for x in out for y in part}
        return out

    def one(op, arg) -> set[str] | None:
        if op is sre.LITERAL:
            return {chr(arg)}
        if op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg):
            return {chr(c) for _, c in arg}
        if op is sre.SUBPATTERN:
            return strings(arg[3])
        if op is sre.BRANCH:
            parts = [strings(p) for p in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is sre.MAX_REPEAT and arg[1] <= 4:
            inner = strings(arg[2])
            if inner is None:
                return None
            out = set()
            for n in range(arg[0], arg[1] + 1):
                step = {""}
                for _ in range(n):
                    step = {x + y for x in step for y in inner}
                    if len(step) > MOST_STRINGS:
                        return None
                out |= step
            return out
        return None

    def ask(items) -> Query:
        """Runs of known parts are joined, so that trigrams may span them; unknown parts split the runs."""
        out, run = ANY, {""}

        def end() -> None:
            nonlocal out, run
            out, run = _both(out, frozenset(_trigrams(s) for s in run)), {""}

        for op, arg in items:
            part = one(op, arg)
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = {x + y for x in run for y in part}
                continue
            end()
            if part is not None:
                run = part
            elif op is sre.SUBPATTERN:
                out = _both(out, ask(arg[3]))
            elif op is sre.BRANCH:
                out = _both(out, frozenset().union(*(ask(p) for p in arg[1])))
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                out = _both(out, ask(arg[2]))
        end()
        return ANY if frozenset() in out else out

    return ask(list(sre.parse(regex)))


def build_index(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Postings (trigram, key) of texts(key, text), for the trigrams of a vocabulary, over lower-cased whole texts."""
    low = F.lower(F.col("text"))
    present = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)]), lambda x: x.isNotNull())
    return texts.select("key", F.explode(present).alias("trigram"))


#: Trigrams that one number has bits for.
WORD_BITS = 62


def candidates(index: DataFrame, queries: dict[str, Query], vocabulary: list[str]) -> DataFrame:
    """(key, kinds): for each key that satisfies a query, the kinds whose query it satisfies. The postings of a
    key meet as one bit each, so intersecting and uniting are bit operations, and maps send one row a key. A
    vocabulary has as many numbers of WORD_BITS bits as it needs."""
    place = {t: divmod(i, WORD_BITS) for i, t in enumerate(vocabulary)}
    words = range(-(-len(vocabulary) // WORD_BITS))
    bit = F.expr(f"shiftleft(cast(1 as bigint), trigram % {WORD_BITS})")
    found = index.groupBy("key").agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("trigram") / WORD_BITS) == w, bit)), F.lit(0)).alias(f"bits_{w}") for w in words])

    def all_of(trigrams: frozenset) -> Column:
        masks = {w: sum(1 << b for v, b in map(place.get, trigrams) if v == w) for w in words}
        return reduce(lambda a, b: a & b, [F.col(f"bits_{w}").bitwiseAND(F.lit(m)) == m for w, m in masks.items() if m])

    def holds(q: Query) -> Column:
        return reduce(lambda a, b: a | b, [all_of(s) for s in sorted(q, key=sorted)])

    named = F.filter(F.array(*[F.when(holds(q), F.lit(k)) for k, q in sorted(queries.items())]), lambda x: x.isNotNull())
    return found.select("key", named.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points. Pieces between matches and the matches
    themselves alternate, so their lengths give the offsets."""
    pieces = F.split(text, rule.regex, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    parts = F.zip_with(F.zip_with(whole, counted, lambda w, c: F.struct(F.length(w).alias("w"), F.length(c).alias("c"))), F.slice(pieces, 1, F.size(whole)), lambda m, p: F.struct(m["w"].alias("w"), m["c"].alias("c"), F.length(p).alias("p")))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["p"]
        span = F.struct(start.alias("start"), (start + m["w"]).alias("end"))
        return F.struct((start + m["w"]).alias("at"), F.when(m["c"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(parts, zero, step)["spans"]


def fast_regex(rule: Rule) -> str:
    """A regex with the same matches of sufficient length, for rules that are one class repeated or a literal
    and a class repeated: a maximal run that is too short can be passed over at once."""
    if rule.group == 0 and (m := sre.parse(rule.regex)) and rule.regex.endswith("]+") and all(op is sre.LITERAL for op, _ in list(m)[:-1]):
        return f"{rule.regex[:-1]}{{{rule.least - (len(m) - 1)},}}"
    return rule.regex


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans and found, an array of (kind,
    start, end) of all spans in order.

    Null text counts as empty: no spans. Rows that repeat an id are scanned each by itself; they share
    their candidates, which verification tells apart. A null id is an id. Whole texts are scanned; offsets are
    code points, ends exclusive; spans are ordered by start, then kind in the order of the rules. Of an empty table nothing
    comes; other columns are ignored, whatever their names."""
    rules = BASE_RULES + more
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) != ANY}
    vocabulary = sorted({t for q in queries.values() for s in q for t in s})
    if queries:
        index = build_index(rows, vocabulary)
        asked = materialise(candidates(index, queries, vocabulary), "secret-candidates").withColumnRenamed("key", "k")
        rows = rows.join(asked, rows["key"].eqNullSafe(F.col("k")), "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    told = rows.select("key", *[
        F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if r.kind in queries else F.col("text").rlike(fast_regex(r)), _spans(F.col("text"), Rule(r.kind, fast_regex(r), r.group, r.least))).otherwise(none).alias(r.kind)
        for r in rules
    ])
    kinds = [r.kind for r in rules]

    def tagged(kind: str, i: int) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    def joined(some: list[str]) -> Column:
        named = F.array(*map(F.lit, some))
        return F.transform(F.array_sort(F.concat(*[tagged(k, i) for i, k in enumerate(some)])), lambda s: F.struct(F.element_at(named, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [r.kind for r in BASE_RULES]
    told = told.select("key", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], joined(base).alias("base"), joined(kinds).alias("found"))
    return told.select(F.col("key").alias(id_col), *[f"n_{k}" for k in base], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), "found")

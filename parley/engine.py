"""The engine: memories of conversations, with the operations of a retrieval service as methods that return DataFrames."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.ids import parse as parse_id
from .functions.normalize import VERSION
from .operators import indexer, read, render
from .operators.search import Filter, Found, Index, search
from .plans.parser import NoGroups
from .sources.adapters import messages_of
from .sources.store import MOST_REF, ROLES, BadField, Duplicate, Store, StoreError

#: Messages of a batch whose sessions are named in a filter.
FEW = 1000
ENTRY = "session string, message string, role string, author string, ts bigint, body string, ord bigint"


class UnknownSession(StoreError): ...


class UnknownMessage(StoreError): ...


class Engine:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.store = spark, Store(spark, home)

    # the catalog

    def create(self, name: str, description: str, languages: str | None = None) -> dict:
        return self.store.create(name, description, languages)

    def update(self, name: str, description: str | None = None, languages: str | None = None) -> dict:
        return self.store.update(name, description, languages)

    def delete(self, name: str) -> dict:
        """What the memory held, which is gone then."""
        held = self._held(name)
        self.store.delete(name)
        return held

    def list(self) -> DataFrame:
        """Every memory with its numbers of sessions, messages and units, oldest first. The memories are counted together."""
        told = [self.store.memory(n) for n in self.store.names()]
        schema = "id string, memory string, description string, languages string, created_at bigint"
        rows = self.spark.createDataFrame([tuple(m[c.split()[0]] for c in schema.split(", ")) for m in told], schema)
        every = lambda table: reduce(DataFrame.unionByName, [table(m["memory"]) for m in told])
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        if told:
            held = every(lambda n: self.messages(n).select("memory", "session_id")).groupBy("memory").agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("messages"))
            pieces = every(lambda n: self.units(n).select("memory")).groupBy("memory").agg(F.count(F.lit(1)).alias("units"))
            rows = rows.join(held, "memory", "left").join(pieces, "memory", "left").select(*[c.split()[0] for c in schema.split(", ")], zero("sessions"), zero("messages"), zero("units"))
        else:
            rows = rows.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("sessions", "messages", "units")])
        return rows.orderBy("created_at", "memory")

    def _held(self, name: str) -> dict:
        got = self.messages(name).agg(F.count_distinct("session_id").alias("s"), F.count(F.lit(1)).alias("m")).first()
        return {"sessions": got.s, "messages": got.m, "units": self.units(name).count()}

    # tables

    def messages(self, name: str) -> DataFrame:
        return self.store.read(name, "message", indexer.MESSAGE)

    def units(self, name: str) -> DataFrame:
        return self.store.read(name, "unit", indexer.UNIT)

    def index(self, name: str) -> Index:
        self.store.check_version(name)
        read_ = lambda table, schema: self.store.read(name, table, schema)
        return Index(self.units(name), read_("posting", indexer.POSTING), name, stats=read_("term_stat", indexer.TERM_STAT), sizes=read_("field_stat", indexer.FIELD_STAT))

    # writing

    def add(self, name: str, session: str, body: str, message: str | None = None, role: str | None = None, author: str | None = None, ts: int | None = None, context: str = "arrival") -> DataFrame:
        """add_all of one message."""
        return self.add_all(name, [{"session": session, "message": message, "role": role, "author": author, "ts": ts, "body": body}], context=context)

    def add_all(self, name: str, entries: Iterable[dict] | DataFrame, key: str | None = None, context: str = "rebuilt") -> DataFrame:
        """Adds messages in order: (session, message, role, author, ts, body) dicts, or a DataFrame of those and ord, whose
        rows of a session are added in the order of ord. Returns (message_id, session_id, seq, units).

        The role is user unless told, the author is the role, the time is now. A session is found or begun; its messages
        are numbered from 0. A message reference that the session has is refused, as a whole batch. key: see Store.write.
        context tells how the lemmas are chosen that units borrow from their message: "arrival" takes the rarest in what the
        memory held before this batch and none that is too common there, "rebuilt" the first in byte order, as a rescan does."""
        if context not in ("arrival", "rebuilt"):
            raise BadField("context is arrival or rebuilt")
        now = int(time.time() * 1000)
        if isinstance(entries, DataFrame):
            rows = entries
        else:
            told = [(e.get("session"), e.get("message"), e.get("role"), e.get("author"), e.get("ts"), e.get("body"), i) for i, e in enumerate(entries)]
            rows = self.spark.createDataFrame(told, ENTRY)
        rows = rows.withColumn("role", F.coalesce("role", F.lit("user"))).withColumn("author", F.coalesce("author", "role")).withColumn("ts", F.coalesce("ts", F.lit(now))).withColumn("body", F.coalesce("body", F.lit("")))
        bad = rows.agg(
            F.count_if(~F.col("role").isin(*ROLES)).alias("role"), F.count_if(F.col("session").isNull() | (F.length("session") > MOST_REF)).alias("session"), F.count_if(F.length("message") > MOST_REF).alias("message"),
        ).first()
        if bad.role or bad.session or bad.message:
            raise BadField("a role is user, assistant or tool; references have at most 64 characters" if bad.role or bad.message else "a session reference has 1 to 64 characters")
        have = self.messages(name)
        count = have.count()  # from the files' footers
        if not isinstance(entries, DataFrame) and len(told) <= FEW:
            # the sessions of a small batch reach the scan as a filter
            have = have.where(F.col("session_ref").isin(*sorted({t[0] for t in told})))
        named = rows.where("message is not null").select(F.col("session").alias("session_ref"), F.col("message").alias("message_ref"))
        if not named.groupBy("session_ref", "message_ref").count().where("count > 1").isEmpty() or not named.join(have.select("session_ref", "message_ref"), ["session_ref", "message_ref"], "left_semi").isEmpty():
            raise Duplicate("a session has this message already")
        last = have.groupBy("session_ref").agg((F.max("seq") + 1).alias("next"), F.min("ord").alias("first"))
        nth = F.row_number().over(Window.partitionBy("session_ref").orderBy("ord")) - 1
        placed = rows.withColumnRenamed("session", "session_ref").join(last, "session_ref", "left").withColumn("seq", (F.coalesce("next", F.lit(0)) + nth).cast("bigint"))
        begun = F.min("ord").over(Window.partitionBy("session_ref"))
        placed = placed.withColumn("ord", F.coalesce("first", F.lit(count) + begun).cast("bigint"))
        made = messages_of(placed.withColumn("memory", F.lit(name)).withColumnRenamed("message", "message_ref"))
        segment = self._write(name, made, key, index=self.index(name) if context == "arrival" else None)
        return self._written(name, segment)

    def _write(self, name: str, messages: DataFrame, key: str | None = None, replaces: list[str] | None = None, supersedes: list[str] | None = None, index: Index | None = None) -> str:
        """index: of what was there before, if context words are chosen by it."""
        messages = messages.persist()
        units = indexer.units_of(messages).persist()
        postings = indexer.postings_of(units, None if index is None else index.lemma_stats(), 0 if index is None else index.counts()[0]).persist()
        try:
            stats, sizes = indexer.term_stats(postings), indexer.size_stats(units, postings)
            if replaces:  # what they had is taken off
                was = {t: self.store.read(name, t, s).where(F.col("message_id").isin(*replaces)) for t, s in (("unit", indexer.UNIT), ("posting", indexer.POSTING))}
                stats = stats.unionByName(indexer.term_stats(was["posting"]).withColumn("df", -F.col("df")))
                sizes = sizes.unionByName(indexer.size_stats(was["unit"], was["posting"]).withColumns({c: -F.col(c) for c in ("n_units", "total_len")}))
            tables = {"message": messages, "unit": units, "posting": indexer.layout(postings), "term_stat": indexer.layout_stats(stats), "field_stat": sizes}
            return self.store.write(name, tables, key, replaces, supersedes)
        finally:
            postings.unpersist()
            units.unpersist()
            messages.unpersist()

    def _written(self, name: str, segment: str) -> DataFrame:
        root = self.store._at(name, "segments", segment)
        units = self.spark.read.schema(indexer.UNIT).parquet(f"{root}/unit").groupBy("message_id").agg(F.count(F.lit(1)).alias("units"))
        rows = self.spark.read.schema(indexer.MESSAGE).parquet(f"{root}/message").join(units, "message_id", "left")
        return rows.select("message_id", "session_id", "seq", F.coalesce("units", F.lit(0)).alias("units"))

    def replace(self, name: str, session: str, message: str, body: str, ts: int | None = None) -> DataFrame:
        """New text and time for a message; its number, role and author stay. Returns (message_id, units, messages of the session)."""
        old = self.messages(name).where((F.col("session_ref") == session) & (F.col("message_ref") == message))
        rows = old.collect()  # one row
        if not rows:
            raise UnknownMessage(f"{session} {message}")
        was = rows[0]
        told = self.spark.createDataFrame([was], indexer.MESSAGE).withColumn("body", F.lit(body)).withColumn("ts", F.lit(int(ts if ts is not None else time.time() * 1000)))
        new = messages_of(told)
        segment = self._write(name, new, replaces=[was.message_id])
        count = self.messages(name).where(F.col("session_ref") == session).count()
        return self._written(name, segment).select("message_id", "units", F.lit(count).alias("messages"))

    def rescan(self, name: str) -> dict:
        """Splits and indexes all messages again, as one segment. From the moment that it is complete the earlier segments
        aren't read; then they are removed. After a failure at any point readers see either all of them or it alone."""
        old = self.store.segments(name)
        if old:
            self._write(name, self.messages(name), key=f"rescan-{uuid.uuid4().hex[:8]}", supersedes=sorted({*old, *self.store.leftovers(name)}))
            self.store.drop_segments(name, old)
        self.store.set_meta(name, normalization_version=str(VERSION), built_at=str(int(time.time() * 1000)))
        held = self._held(name)
        return {"messages": held["messages"], "units": held["units"]}

    def compact(self, name: str) -> None:
        """Joins the segments into one, without splitting or indexing again: what a search reads stays the same."""
        old = self.store.segments(name)
        if len(old) < 2:
            return
        kept = {t: self.store.read(name, t, s) for t, s in (("message", indexer.MESSAGE), ("unit", indexer.UNIT), ("posting", indexer.POSTING))}
        tables = kept | {"posting": indexer.layout(kept["posting"]), "term_stat": indexer.layout_stats(indexer.term_stats(kept["posting"])), "field_stat": indexer.size_stats(kept["unit"], kept["posting"])}
        self.store.write(name, tables, key=f"compact-{uuid.uuid4().hex[:8]}", supersedes=sorted({*old, *self.store.leftovers(name)}))
        self.store.drop_segments(name, old)

    def rescan_all(self) -> dict[str, dict]:
        return {n: self.rescan(n) for n in self.store.names()}

    # reading

    def search(self, name: str, query: str, fuzzy: bool = False, limit: int = 10, max_per_message: int = 2, session: str | None = None, after: int | None = None, before: int | None = None, roles: tuple[str, ...] = (), as_of: int | None = None, groups: list | None = None) -> Found:
        if groups is not None:
            raise NoGroups("groups can't be asked; a clause in parentheses is one idea")
        if session is not None:
            parse_id(session)
        if any(r not in ROLES for r in roles):
            raise BadField("a role is user, assistant or tool")
        return search(self.index(name), query, fuzzy, limit, max_per_message, Filter(session, after, before, tuple(roles)), int(time.time() * 1000) if as_of is None else as_of)

    def outline(self, name: str, session: str | None = None) -> DataFrame:
        if session is None:
            return read.outline_sessions(self.messages(name), self.units(name))
        told = read.outline_messages(self.messages(name), self.units(name), session)
        if told.isEmpty():
            raise UnknownSession(session)
        return told

    def cursor(self, name: str, cursors: list[str], before: int = 2, after: int = 2, messages: bool = False) -> tuple[DataFrame, DataFrame]:
        """The units around each cursor, and the cursors that no unit has."""
        for c in cursors:
            parse_id(c)
        asked = self.spark.createDataFrame([(c.upper(),) for c in cursors], "unit_id string")
        return read.window(self.units(name), asked, before, after, messages), read.missing(self.units(name), asked)

    def lexicon(self, name: str, words: list[str]) -> DataFrame:
        return read.lexicon(self.index(name), words)

    def vocabulary(self, name: str, limit: int = 60) -> DataFrame:
        return read.vocabulary(self.index(name), limit)

    def json(self, name: str, operation: str, *args, **more) -> DataFrame:
        """One row with the answer of an operation as JSON: list, search, outline, cursor or lexicon."""
        return render.render(self, name, operation, *args, **more)

    def message(self, name: str, message_id: str) -> DataFrame:
        return self.messages(name).where(F.col("message_id") == message_id).select("body", "role", "ts")

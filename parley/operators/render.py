"""Answers as JSON and as short text. Rows become structs with the answer's names; Spark writes them as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a preview (fixed value).
PREVIEW_WORDS = 60


def rfc3339(ms: Column) -> Column:
    """Milliseconds as a time in UTC, to the second."""
    days, rest = F.floor(ms / 86_400_000), F.pmod(ms, F.lit(86_400_000))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    seconds = F.floor(rest / 1000)
    day = F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd")
    return F.concat(day, F.lit("T"), two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60), F.lit("Z"))


def preview(text: Column, words: int = PREVIEW_WORDS) -> Column:
    """The text up to its white space number `words`, with an ellipsis if that leaves something out; breaks, quotes and
    backslashes are escaped."""
    head = F.regexp_extract(text, rf"^(?s)(?:\S*\s){{{words - 1}}}\S*(?=\s)", 0)
    cut = F.when(head != "", head).otherwise(text)
    for raw, told in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        cut = F.replace(cut, F.lit(raw), F.lit(told))
    return F.when(head != "", F.concat(cut, F.lit("…"))).otherwise(cut)


def _listed(rows: DataFrame, order: list[str], fields: dict[str, str]) -> DataFrame:
    """One row with `rows`: the array of structs, in order, and an empty one without rows."""
    item = F.struct(*[F.expr(e).alias(n) for n, e in fields.items()])
    kept = rows.select(F.struct(*order).alias("o"), item.alias("x"))
    return kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda y: y["x"]).alias("rows"))


def _json(**parts: DataFrame) -> DataFrame:
    """One row with a JSON object of the parts, each a one-row table with `rows`."""
    whole = None
    for name, part in parts.items():
        one = part.withColumnRenamed("rows", name)
        whole = one if whole is None else whole.crossJoin(one)  # of one row each
    return whole.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("json"))


def _told(spark, rows: list, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"nth int, {schema}")
    return _listed(table, ["nth"], {n: n for n in names})


def render(engine, name: str, operation: str, *args, **more) -> DataFrame:
    """Engine.json."""
    spark = engine.spark
    if operation == "list":
        return _json(memory_list=_listed(engine.list(), ["created_at", "memory"], {"id": "id", "name": "memory"} | {c: c for c in ("description", "languages", "created_at", "sessions", "messages", "units")}))
    if operation == "search":
        found = engine.search(name, *args, **more)
        same = {c: c for c in ("author", "role", "ts", "words", "snippet")}
        hits = _listed(found.hits, ["rank"], {
            "cursor": "unit_id", "unit": "unit_id", "score": "score", "raw": "raw", "coverage": "array(covered, ideas)", "matched_list": "matched", "nearby_list": "nearby",
            "session": "session_id", "session_ref": "session_ref", "message": "message_id", "message_ref": "message_ref", **same,
        })
        return _json(hit_list=hits, unknown_list=_told(spark, found.unknown, "clause string, word string"), fuzzy_list=_told(spark, found.fuzzy, "word string, matched_list array<string>"), hint_list=_listed(found.hints, ["units", "term"], {"term": "term", "units": "units"}))
    if operation == "outline":
        rows = engine.outline(name, *args, **more)
        if "seq" in rows.columns:
            return _json(message_list=_listed(rows, ["seq"], {"id": "message_id", "message": "message_ref"} | {c: c for c in ("seq", "author", "role", "ts", "characters", "units")}))
        at = rows.withColumn("at", F.monotonically_increasing_id())  # rows are in order of creation
        return _json(session_list=_listed(at, ["at"], {"id": "session_id", "session": "session_ref"} | {c: c for c in ("started_at", "ended_at", "messages", "units")}))
    if operation == "cursor":
        whole = bool(more.get("messages"))
        rows, gone = engine.cursor(name, *args, **more)
        place = engine.messages(name).select("message_id", "message_ref", "session_ref", F.col("author"), F.col("body"), F.col("ord"))
        units = F.array_sort(F.collect_list(F.struct("unit_seq", F.col("unit_id").alias("unit"), "anchor", "text")))
        per = rows.groupBy("session_id", "message_id", "message_seq", "role", "ts").agg(F.max("anchor").alias("anchor"), F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), u["unit_seq"].alias("unit_seq"), u["anchor"].alias("anchor"), u["text"].alias("text"))).alias("unit_list"))
        fields = {"message": "message_id", "message_ref": "message_ref", "session": "session_id", "session_ref": "session_ref", "seq": "message_seq", "author": "author", "role": "role", "ts": "ts", "anchor": "anchor"}
        fields |= {"body": "body"} if whole else {"unit_list": "unit_list"}
        return _json(message_list=_listed(per.join(place, "message_id"), ["ord", "session_id", "message_seq"], fields), missing_list=_listed(gone, ["unit_id"], {"unit": "unit_id"}).select(F.transform("rows", lambda x: x["unit"]).alias("rows")))
    if operation == "lexicon":
        rows = engine.lexicon(name, *args, **more)
        return _json(word_list=_listed(rows.withColumn("at", F.monotonically_increasing_id()), ["at"], {c: c for c in rows.columns}))
    raise ValueError(f"{operation} has no answer in JSON")

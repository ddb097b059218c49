"""The catalog: memories under a home folder, each an append-only series of Parquet segments.

A write adds one segment, complete before its marker appears, so readers never see half of it. A segment may
replace messages of earlier ones, or supersede earlier segments as a whole: its marker does both, in one step. Everything derived from a message depends on that message alone, except
document frequencies, which are sums over segments; so a write never touches old data, and a rescan
compacts all into one segment. Files are reached through Hadoop, so the home may be in any store."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import VERSION

# fixed values: limits of the fields, in characters, and roles
NAME = re.compile(r"[a-z0-9_]{1,40}")
MOST_DESCRIPTION, LEAST_WORDS, MOST_LANGUAGES, MOST_REF = 2000, 11, 64, 64
ROLES = ("user", "assistant", "tool")


class StoreError(ValueError):
    """A request that the store refuses."""


class UnknownMemory(StoreError): ...


class MemoryExists(StoreError): ...


class BadField(StoreError): ...


class Duplicate(StoreError): ...


class StaleIndex(StoreError):
    """The index was built by other normalisation rules; rescan."""


def check_description(text: str) -> None:
    if len(text.split()) < LEAST_WORDS or len(text) > MOST_DESCRIPTION:
        raise BadField(f"a description has at least {LEAST_WORDS} words and at most {MOST_DESCRIPTION} characters")


@dataclass
class Store:
    spark: SparkSession
    home: str

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _put(self, path: str, value: dict) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _get(self, path: str) -> dict:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _at(self, name: str, *rest: str) -> str:
        return "/".join((self.home.rstrip("/"), name, *rest))

    # the catalog

    def names(self) -> list[str]:
        """Folders without a memory file are skipped."""
        return [n for n in self._children(self.home) if self._exists(self._at(n, "memory.json"))]

    def memory(self, name: str) -> dict:
        if not NAME.fullmatch(name) or not self._exists(self._at(name, "memory.json")):
            raise UnknownMemory(name)
        return self._get(self._at(name, "memory.json"))

    def create(self, name: str, description: str, languages: str | None = None) -> dict:
        if not NAME.fullmatch(name):
            raise BadField("a name has 1 to 40 of a-z, 0-9 and _")
        check_description(description)
        languages = languages or "fa,en"
        if len(languages) > MOST_LANGUAGES:
            raise BadField(f"languages have at most {MOST_LANGUAGES} characters")
        if self._exists(self._at(name, "memory.json")):
            raise MemoryExists(name)
        now = int(time.time() * 1000)
        made = {"memory": name, "id": uuid.uuid4().hex, "description": description, "languages": languages, "created_at": now, "meta": {"normalization_version": str(VERSION), "built_at": str(now)}}
        self._put(self._at(name, "memory.json"), made)
        return made

    def update(self, name: str, description: str | None = None, languages: str | None = None) -> dict:
        if description is None and languages is None:
            raise BadField("nothing to update")
        made = self.memory(name)
        if description is not None:
            check_description(description)
            made["description"] = description
        if languages is not None:
            if len(languages) > MOST_LANGUAGES:
                raise BadField(f"languages have at most {MOST_LANGUAGES} characters")
            made["languages"] = languages
        self._put(self._at(name, "memory.json"), made)
        return made

    def delete(self, name: str) -> None:
        self.memory(name)
        self._remove(self._at(name))

    def meta(self, name: str) -> dict:
        return self.memory(name)["meta"]

    def set_meta(self, name: str, **values: str) -> None:
        made = self.memory(name)
        made["meta"] |= values
        self._put(self._at(name, "memory.json"), made)

    def check_version(self, name: str) -> None:
        """An index of another version is refused; one without a version has never been built and is taken."""
        found = self.meta(name).get("normalization_version")
        if found is not None and int(found) != VERSION:
            raise StaleIndex(f"{name} was indexed by version {found} of the rules; rescan it for version {VERSION}")

    # segments

    def _markers(self, name: str) -> dict[str, dict]:
        """The markers of the segments that are complete and not superseded, in order."""
        root = self._at(name, "segments")
        found = {x: self._get(f"{root}/{x}/done.json") for x in self._children(root) if self._exists(f"{root}/{x}/done.json")}
        gone = {x for marker in found.values() for x in marker.get("supersedes", [])}
        return {x: marker for x, marker in found.items() if x not in gone}

    def segments(self, name: str) -> list[str]:
        return list(self._markers(name))

    def leftovers(self, name: str) -> list[str]:
        """Folders of segments that readers don't see: superseded ones, and those of writers that failed or aren't done."""
        return sorted(set(self._children(self._at(name, "segments"))) - set(self._markers(name)))

    def _claimed(self, name: str, first: int) -> int:
        """A number from `first` on that no other writer has: who creates its file owns it."""
        while True:
            fs, p = self._fs(self._at(name, "numbers", f"{first:010d}"))
            if fs.createNewFile(p):
                return first
            first += 1

    def write(self, name: str, tables: dict[str, DataFrame], key: str | None = None, replaces: list[str] | None = None, supersedes: list[str] | None = None) -> str:
        """A new segment; with a key that has been written before, nothing is done: a retried batch counts once.
        replaces: ids of messages in earlier segments that it takes the place of; supersedes: earlier segments that it
        takes the place of, from the moment that it is complete."""
        done = self.segments(name)
        again = next((s for s in done if key and s.split("-", 1)[1] == key), None)
        if again:
            return again
        number = self._claimed(name, max((int(s.split("-")[0]) for s in done), default=-1) + 1)
        segment = f"{number:010d}-{key or uuid.uuid4().hex[:8]}"
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(self._at(name, "segments", segment, table))
        self._put(self._at(name, "segments", segment, "done.json"), {"replaces": replaces or [], "supersedes": supersedes or []})
        return segment

    def drop_segments(self, name: str, segments: list[str]) -> None:
        """Removes superseded segments; until then they only cost space."""
        for s in segments:
            self._remove(self._at(name, "segments", s))

    def read(self, name: str, table: str, schema: str) -> DataFrame:
        """The rows of all segments, in one scan, without those that a later segment replaces, by their message_id."""
        self.memory(name)
        markers = self._markers(name)
        if not markers:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[self._at(name, "segments", s, table) for s in markers])
        last = {m: int(s.split("-")[0]) for s, marker in markers.items() for m in marker["replaces"]}
        if not last or "message_id" not in rows.columns:  # statistics have the replaced messages taken off
            return rows
        columns = rows.columns
        number = F.regexp_extract(F.col("_metadata.file_path"), rf"/segments/(\d+)-[^/]*/{table}/[^/]*$", 1).cast("long")
        gone = self.spark.createDataFrame(list(last.items()), "replaced string, number long")
        rows = rows.withColumn("segment_number", number)
        return rows.join(gone, (rows["message_id"] == gone["replaced"]) & (rows["segment_number"] < gone["number"]), "left_anti").select(*columns)

"""What the operators of this subpackage share: tables, the shared folder, word rules, held-out rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []

#: What a Python worker keeps from task to task.
_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Drops what a worker keeps and gives the memory back. Spark hands workers on from one operator to the next, so an operator
    that needs much memory itself calls this in its tasks, lest it also holds the tables of an earlier one."""
    if not _kept:
        return
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one of spark.checkpoint.dir. Only in local mode, where all
    share one disk, a temporary folder serves if the session names none; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="parley-"))
    return f"file://{_own_dir[0]}"


#: While a table is written, Spark drops the shuffle files of the query once it has ended, and what reaches Python at
#: once is bounded in rows and in bytes, so that a worker's memory doesn't grow with the length of texts or arrays.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again. It cuts the lineage, survives a lost
    executor, and what is used several times is computed once. Columns compress as Parquet does. The written
    table is all that stays: the shuffle files behind it are dropped at once, not when the driver's garbage is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, or with underscores so that no column of df has it, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """The rows that no classifier learns from: crc32 of the id as text, modulo 4, is 2. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))

"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, source mixing, BPE encoding.

Each stage takes all that its predecessor kept and returns the columns of documents; the last returns token
ids. Extra columns stay as they are, whatever their names, up to the last stage. Of an empty table each stage
returns an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import bpe, language
from parley.llm.common import materialise
from parley.llm.exact_dedup import without_copies
from parley.llm.jaccard_join import without_near_duplicates
from parley.llm.mixing import mixed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised: they have letters and are not far from every centroid. Null and
    empty texts go, rows that repeat an id are judged each by itself, and of an empty table nothing comes."""
    return language.recognised(docs, language.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of each group of equal texts; null counts as the empty text. Of rows that repeat an id and a text
    one stays; a null id only if no other row has the text."""
    return without_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of documents with a Jaccard similarity of at least 0.8 over
    runs of five words; documents without words are each their own component, so they stay. Null ids come after
    others; rows that are equal in id and text stay or go together."""
    return without_near_duplicates(docs, width=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; not at all, once or twice. The null source is a source; documents
    without words are taken as often as is sure for their source; rows that agree in id and size are taken equally often."""
    return mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests and those of the decoded text. Null and empty texts have no tokens; each
    row is encoded by itself, whatever its id."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the classifier, nor pivotal rounding, nor BPE; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

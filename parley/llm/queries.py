"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, quality
from .common import held_out, table
from .exact_dedup import exact_dedup
from .html_text import extract
from .jaccard_join import jaccard_components
from .mixing import mix
from .near_vectors import near_vectors
from .passages import repeated_passages
from .secrets import BASE_RULES, MORE_RULES, fast_regex, scan


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")


def _secret_sql() -> str:
    """The same spans by plain scans of every text: pieces and matches alternate, their lengths are the offsets."""
    parts = []
    for i, r in enumerate(BASE_RULES + MORE_RULES):
        regex = fast_regex(r).replace("'", "''")
        parts.append(f"""
            SELECT doc_id, {i} AS k, '{r.kind}' AS kind, start, start + length(w) AS stop FROM (
              SELECT doc_id, unnest(w) AS w, unnest(c) AS c,
                     unnest(list_transform(range(1, len(w) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
                            + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))) AS start
              FROM (SELECT doc_id, regexp_extract_all(t, '{regex}', 0) AS w, regexp_extract_all(t, '{regex}', {r.group}) AS c,
                           regexp_split_to_array(t, '{regex}') AS p FROM d)) WHERE length(c) >= {r.least}""")
    base = ", ".join(f"count(s.k) FILTER (WHERE s.kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    text = "string_agg(s.kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.stop AS BIGINT), ',' ORDER BY s.start, s.k)"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)})
        SELECT d.doc_id, {base}, sha256(coalesce({text} FILTER (WHERE s.k < {len(BASE_RULES)}), '')) AS base_sha256, coalesce({text}, '') AS spans
        FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_near_vectors": op1_near_vectors,
    "op2_passage_dedup": op2_passage_dedup,
    "op3_language_id": op3_language_id,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality": op5_quality,
    "op6_secret_scan": op6_secret_scan,
    "op7_html_text": op7_html_text,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

#: All that links reach.
_REACH = "reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)"

ORACLE = {
    "op6_secret_scan": _secret_sql(),
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op1_near_vectors": f"""
        WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        fine AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
        {_REACH}
        SELECT vec_id, coalesce(many, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
        FROM embeddings LEFT JOIN (SELECT a, count(*) AS many FROM link GROUP BY a) c ON c.a = vec_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = vec_id""",
    "op10_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        link AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        {_REACH}
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = doc_id""",
}

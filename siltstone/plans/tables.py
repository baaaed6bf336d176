"""The driver's tables as the engine's, in Spark and in SQL.

owner = source, a knowledge base for each language (English is global), searchable = 20 characters
or more, deleted = the text says "Draft".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("owner"), F.col("lang").alias("kb_id"), "n_chars",
        (F.col("n_chars") >= 20).alias("searchable"), F.contains("text", F.lit("Draft")).alias("deleted"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


CATALOG = """catalog AS (SELECT doc_id AS id, text, source AS owner, lang AS kb_id, n_chars, n_chars >= 20 AS searchable, contains(text, 'Draft') AS deleted FROM documents),
live AS (SELECT * FROM catalog WHERE coalesce(searchable, false) AND NOT coalesce(deleted, false))"""
UNIT = """unit AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS u FROM embeddings)"""
#: functions.text.normalized of the column text.
NORMALIZED = r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g'), '[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g')), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')"
#: Arms of a search: the 50 nearest of {vectors} to each of {queries}, and the 50 texts of `live` with most of a benchmark item's terms.
DENSE = """scored AS (SELECT q.id AS query_id, v.id, round(list_sum(list_transform(list_zip(q.u, v.u), lambda p: p[1] * p[2])), 6) AS score FROM {queries} q CROSS JOIN {vectors} v),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 50)"""
SPARSE = """found AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM live) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)),
sparse AS (SELECT query_id, id, CAST(sum(n) AS BIGINT) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(n) DESC, id) AS rank FROM found JOIN asked USING (term) GROUP BY query_id, id QUALIFY rank <= 50)"""

"""English full-text search over the driver's documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import stemming as s
from siltstone.operators import access, fulltext
from siltstone.plans import tables as t

#: Terms of a question that must all be there.
EVERY = 3


def _asked(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark, sf_dir) -> DataFrame:
    return t.catalog(spark, sf_dir).filter(access.live()).select("id", "text")


def fulltext_topk(spark, sf_dir) -> DataFrame:
    """Each benchmark item as a question of which any term counts: the 50 documents of highest rank."""
    return fulltext.top_k(_docs(spark, sf_dir), fulltext.questions(_asked(spark, sf_dir)), 50)


def fulltext_covers(spark, sf_dir) -> DataFrame:
    """The first three terms of each benchmark item, all of which must be there: the 50 documents of highest cover density."""
    return fulltext.top_k(_docs(spark, sf_dir), fulltext.questions(_asked(spark, sf_dir), EVERY), 50, every=True)


def lexeme_counts(spark, sf_dir) -> DataFrame:
    """Each stem of the documents: words that have it, occurrences and documents."""
    return fulltext.stem_counts(t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


_STOPS = ", ".join(repr(w) for w in s.STOP_WORDS)
_STEM = s.stems_sql("[word]") + "[1]"
_OCCURRENCES = f"""places AS (SELECT id, word, position FROM (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS position FROM (SELECT id, {s.words_sql('text')} AS w FROM live)) WHERE word NOT IN ({_STOPS})),
asked_words AS (SELECT query_id, word, place FROM (SELECT item_id AS query_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT item_id, {s.words_sql('text')} AS w FROM benchmark)) WHERE word NOT IN ({_STOPS})),
stemmed AS MATERIALIZED (SELECT word, {_STEM} AS stem FROM (SELECT word FROM places UNION SELECT word FROM asked_words)),
asked AS MATERIALIZED (SELECT query_id, stem, row_number() OVER (PARTITION BY query_id ORDER BY min(place)) AS nth FROM asked_words JOIN stemmed USING (word) GROUP BY query_id, stem),
occurs AS MATERIALIZED (SELECT id, position, stem FROM places JOIN stemmed USING (word))"""
SQL = {
    "fulltext_topk": f"""WITH {t.CATALOG}, {_OCCURRENCES},
found AS (SELECT query_id, id, count(*) AS covers, round(count(*) * CAST(0.1 AS DOUBLE), {fulltext.DIGITS}) AS score FROM occurs JOIN asked USING (stem) GROUP BY query_id, id)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM found QUALIFY rank <= 50""",
    # by brute force over covers: each stretch between two occurrences that holds all terms, of which no part does
    "fulltext_covers": f"""WITH {t.CATALOG}, {_OCCURRENCES}, few AS (SELECT query_id, stem, count(*) OVER (PARTITION BY query_id) AS terms FROM asked WHERE nth <= {EVERY}),
hits AS MATERIALIZED (SELECT query_id, id, position, stem, terms FROM occurs JOIN few USING (stem)),
whole AS (SELECT query_id, id FROM hits GROUP BY query_id, id, terms HAVING count(DISTINCT stem) = terms),
own AS MATERIALIZED (SELECT * FROM hits JOIN whole USING (query_id, id)),
ends AS (SELECT a.query_id, a.id, a.position AS p, min(b.position) AS q FROM own a JOIN own b ON b.query_id = a.query_id AND b.id = a.id AND b.position >= a.position
  WHERE (SELECT count(DISTINCT c.stem) FROM own c WHERE c.query_id = a.query_id AND c.id = a.id AND c.position BETWEEN a.position AND b.position) = a.terms GROUP BY ALL),
covers AS (SELECT query_id, id, max(p) AS p, q FROM ends GROUP BY query_id, id, q),
sized AS (SELECT v.query_id, v.id, v.p, v.q, count(*) AS n FROM covers v JOIN own o ON o.query_id = v.query_id AND o.id = v.id AND o.position BETWEEN v.p AND v.q GROUP BY ALL),
found AS (SELECT query_id, id, count(*) AS covers, round(sum(CAST(0.1 AS DOUBLE) / (1 + (q - p) - (n - 1))), {fulltext.DIGITS}) AS score FROM sized GROUP BY query_id, id)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM found QUALIFY rank <= 50""",
    "lexeme_counts": f"""WITH w AS (SELECT doc_id, unnest({s.words_sql('text')}) AS word FROM documents), k AS (SELECT doc_id, word FROM w WHERE word NOT IN ({_STOPS})),
x AS MATERIALIZED (SELECT word, {_STEM} AS stem FROM (SELECT DISTINCT word FROM k))
SELECT stem, count(DISTINCT word) AS forms, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM k JOIN x USING (word) GROUP BY stem""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}

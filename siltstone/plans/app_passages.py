"""Queries of blocks before chunking and of answers' citations with their passages, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import blocks, citations
from siltstone.plans.tables import NORMALIZED, table

BLOCK_CHARS, DOCUMENT_CHARS = 400, 8_000
#: Marks after commas and sentences by turn and conversation: of four sources, and of none.
_ANSWER = "replace(replace(coalesce(text, ''), ', ', ', [S3] [S9] '), '. ', '. [S' || CAST(1 + (conv_id + turn) % 5 AS STRING) || '] ') || CASE conv_id % 3 WHEN 0 THEN ' [S2][S1]' WHEN 1 THEN '[S04]' ELSE '' END"
#: The first source once more as the fourth, the second often unknown; a conversation in four has too few scores.
_SOURCES = tuple(f"CAST({e} AS STRING)" for e in ("conv_id", "conv_id + CASE WHEN turn % 4 = 1 THEN 1000000000 ELSE 1 END", "conv_id * 3 + turn", "conv_id"))
_SCORES = tuple(f"CAST(turn AS DOUBLE) / 4 + {k}" for k in range(4))


def emitted_blocks(spark, sf_dir) -> DataFrame:
    """Documents' paragraphs as pieces, for every third document with a header line, in small blocks; long documents are beyond the budget."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 == 0).alias("headed"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("piece_order", "text"))
    found = blocks.emit(docs, most_block=BLOCK_CHARS, most_document=DOCUMENT_CHARS)
    return found.select("id", F.col("block_order").cast("int").alias("block_order"), F.sha2("text", 256).alias("block_hash"), F.length("header").alias("header_chars"), "error")


def citation_envelopes(spark, sf_dir) -> DataFrame:
    """Assistant's turns as answers with planted marks; documents are the passages that may be cited."""
    scores = [F.expr(e) for e in _SCORES]
    answers = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr(_ANSWER).alias("answer"), F.array(*[F.expr(e) for e in _SOURCES]).alias("sources"),
        F.when(F.col("conv_id") % 4 == 0, F.array(*scores[:3])).otherwise(F.array(*scores)).alias("scores"),
    )
    name = F.concat(F.lit("file"), F.col("doc_id").cast("string"))
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), name.alias("doc"), F.concat(F.lit("p. "), (F.col("doc_id") % 9).cast("string")).alias("page"), F.struct(F.lit("page").alias("kind"), (F.col("doc_id") % 9).alias("page")).alias("locator"), F.coalesce("text", F.lit("")).alias("quote"))
    s = F.col("segments")
    cites = F.filter(s, lambda x: x["is_cite"])
    joined = lambda rows, of: F.array_join(F.transform(rows, of), ",")
    return citations.envelopes(answers, hits).select(
        "id", F.size(s).alias("n"), F.sha2(F.array_join(F.transform(F.filter(s, lambda x: ~x["is_cite"]), lambda x: x["text"]), "|"), 256).alias("texts"),
        joined(cites, lambda x: x["chunk_id"]).alias("cited"), F.sha2(joined(cites, lambda x: F.concat(x["doc"], F.lit(" "), x["page"], F.lit(" "), F.md5(x["quote"]))), 256).alias("passages"),
        joined(F.filter(cites, lambda x: x["score"].isNotNull()), lambda x: x["score"].cast("string")).alias("scores"), "dropped",
    )


_TWO = "string_split(coalesce(text, ''), chr(10) || chr(10))"
SQL = {
    "emitted_blocks": rf"""WITH RECURSIVE raw AS (SELECT doc_id AS id, unnest({_TWO}) AS text, generate_subscripts({_TWO}, 1) AS piece FROM documents),
clean AS (SELECT * FROM (SELECT id, piece, {NORMALIZED} AS t FROM raw) WHERE t <> ''),
pieces AS (SELECT *, length(t) AS n, sum(length(t)) OVER (PARTITION BY id) > {DOCUMENT_CHARS} AS refused, CASE WHEN id % 3 = 0 THEN split_part(t, chr(10), 1) ELSE '' END AS header FROM clean),
cut AS (SELECT id, piece, t, n, 1 AS pos, 0 AS step, CAST(NULL AS VARCHAR) AS part FROM pieces WHERE NOT refused AND n > {BLOCK_CHARS}
UNION ALL SELECT id, piece, t, n, stop + CASE WHEN lined THEN 1 ELSE 0 END, step + 1, substring(t, pos, stop - pos) FROM (SELECT *, CASE WHEN n - pos + 1 < {BLOCK_CHARS} THEN n + 1 WHEN back > 0 THEN pos + length(w) - back ELSE least(pos + {BLOCK_CHARS}, n + 1) END AS stop, n - pos + 1 >= {BLOCK_CHARS} AND (back > 0 OR substring(t, pos + {BLOCK_CHARS}, 1) = chr(10)) AS lined
FROM (SELECT *, substring(t, pos, {BLOCK_CHARS}) AS w, strpos(reverse(substring(t, pos, {BLOCK_CHARS})), chr(10)) AS back FROM cut WHERE pos <= n))),
parts AS (SELECT id, piece, step, part FROM cut WHERE step > 0 AND trim(regexp_replace(part, '\s+', '', 'g')) <> '' UNION ALL SELECT id, piece, 1, t FROM pieces WHERE NOT refused AND n <= {BLOCK_CHARS}),
numbered AS (SELECT p.id, header, part, row_number() OVER (PARTITION BY p.id, p.piece ORDER BY step) AS i, row_number() OVER (PARTITION BY p.id ORDER BY p.piece, step) - 1 AS block_order FROM parts p JOIN pieces o ON o.id = p.id AND o.piece = p.piece)
SELECT id, CAST(block_order AS INTEGER) AS block_order, sha256(CASE WHEN header <> '' AND i > 1 THEN header || chr(10) || part ELSE part END) AS block_hash, CAST(length(header) AS INTEGER) AS header_chars, NULL AS error FROM numbered
UNION ALL SELECT DISTINCT id, NULL, NULL, NULL, '{blocks.TOO_COMPLEX}' FROM pieces WHERE refused""",
    "citation_envelopes": rf"""WITH a AS (SELECT conv_id * 1000 + turn AS id, {_ANSWER} AS answer, [{', '.join(_SOURCES)}] AS sources, CASE WHEN conv_id % 4 > 0 THEN [{', '.join(_SCORES)}] END AS scores FROM conversations WHERE role = 'assistant'),
k AS (SELECT a.id, list(pos) FILTER (WHERE CAST(doc_id AS STRING) IS NOT NULL) AS known FROM a, (VALUES (1), (2), (3), (4)) p(pos) LEFT JOIN documents ON doc_id = CAST(sources[pos] AS BIGINT) GROUP BY a.id),
b AS (SELECT a.*, coalesce(known, []) AS known, regexp_replace(answer, '\[S0*([1-4])\]', '[S\1]', 'g') AS m FROM a JOIN k USING (id)),
c AS (SELECT *, regexp_replace(CASE WHEN list_contains(known, 4) THEN m3 ELSE replace(m3, '[S4]', '[S0]') END, '\[S[5-9]\]', '[S0]', 'g') AS body FROM (SELECT *, CASE WHEN list_contains(known, 3) THEN m2 ELSE replace(m2, '[S3]', '[S0]') END AS m3 FROM (SELECT *, CASE WHEN list_contains(known, 2) THEN m1 ELSE replace(m1, '[S2]', '[S0]') END AS m2 FROM (SELECT *, CASE WHEN list_contains(known, 1) THEN m ELSE replace(m, '[S1]', '[S0]') END AS m1 FROM b)))),
d AS (SELECT *, list_filter(list_transform(regexp_split_to_array(body, '\[S[1-4]\]'), lambda x: replace(regexp_replace(x, ' (?:(?:\[S0\])+ )+', ' ', 'g'), '[S0]', '')), lambda x: x <> '') AS runs, list_transform(regexp_extract_all(body, '\[S([1-4])\]', 1), lambda x: CAST(x AS INTEGER)) AS marks FROM c),
u AS (SELECT id, sources, unnest(marks) AS mark, generate_subscripts(marks, 1) AS i FROM d),
q AS (SELECT id, string_agg('file' || doc_id || ' p. ' || doc_id % 9 || ' ' || md5(coalesce(text, '')), ',' ORDER BY i) AS passages FROM u JOIN documents ON doc_id = CAST(sources[mark] AS BIGINT) GROUP BY id)
SELECT id, CAST(greatest(len(runs) + len(marks), 1) AS INTEGER) AS n, sha256(array_to_string(runs, '|')) AS texts, array_to_string(list_transform(marks, lambda x: sources[x]), ',') AS cited, sha256(coalesce(passages, '')) AS passages,
CASE WHEN scores IS NULL THEN '' ELSE array_to_string(list_transform(marks, lambda x: CAST(scores[CASE x WHEN 1 THEN 4 ELSE x END] AS STRING)), ',') END AS scores,
CAST(len(regexp_extract_all(m, '\[S[1-4]\]')) - len(marks) AS INTEGER) AS dropped FROM d LEFT JOIN q USING (id)""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}

"""Queries of prompts, metadata, file types, golden sets and small lookups, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import prompts as pr
from siltstone.operators import documents as d
from siltstone.operators import golden
from siltstone.plans.app import PIPELINE, app, app_sql
from siltstone.plans.tables import table


def prompt_sources(spark, sf_dir) -> DataFrame:
    """Each base's documents by size as sources of a prompt: the first eight, in batches of five."""
    docs = app(spark, sf_dir, "docs").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    place = F.row_number().over(Window.partitionBy("knowledge_base_id").orderBy(F.desc("size_bytes"), "id"))
    first = docs.withColumn("place", place).filter("place <= 8").withColumn("b", pr.batch_of(F.col("place")))
    block = pr.source_block(F.col("place"), F.col("filename"), F.concat(F.lit("p. "), F.col("page_count").cast("string")), F.col("text"))
    return first.select("knowledge_base_id", "place", F.col("b.batch").alias("batch"), F.col("b.number").cast("int").alias("number"), F.sha2(block, 256).alias("block"))


def chunk_metadata(spark, sf_dir) -> DataFrame:
    """Metadata written for chunks and read back; some have no label, some metadata is null or no JSON."""
    i = F.col("id")
    chunks = app(spark, sf_dir, "chunks").select("id", "chunk_index")
    meta = pr.chunk_meta(
        (i % 9).cast("int"), (i % 4).cast("int"), F.when(i % 5 > 0, F.concat(F.lit("rows "), (i % 50).cast("string"))), F.lit("table"), PIPELINE,
        char_start=(i % 100).cast("int"), char_end=(i % 100 + i % 30).cast("int"), text=F.repeat(F.lit("x"), (i % 30 + i % 2).cast("int")), extraction=F.when(i % 3 == 0, "table").when(i % 3 == 1, "ocr").otherwise("text"))
    meta = F.when(i % 7 == 0, F.lit(None).cast("string")).when(i % 7 == 1, F.lit("not json")).when(i % 7 == 2, F.lit('{"block_order":"x","locator":3}')).otherwise(meta)
    return chunks.select("id", pr.place_of(meta).alias("p"), pr.stretch_of(meta).alias("s")).select("id", "p.*", "s.*")


def detected_types(spark, sf_dir) -> DataFrame:
    """Files of every suffix with contents that agree and that don't."""
    docs = app(spark, sf_dir, "docs").select("id", "filename")
    i = F.col("id")
    content = F.when(i % 3 == 0, F.lit("%PDF-1.7")).when(i % 3 == 1, F.concat(F.unhex(F.lit("504B0304")).cast("string"), F.lit("x"))).otherwise(F.when(i % 5 == 0, F.concat(F.lit("a"), F.chr(F.lit(7)))).otherwise(F.lit("a,b\n1,2")))
    return docs.select("id", pr.file_type(F.col("filename"), content.cast("binary")).alias("suffix"))


def failure_texts(spark, sf_dir) -> DataFrame:
    code = F.when(F.col("user_id") % 6 == 0, "TIMEOUT").when(F.col("user_id") % 6 == 1, "RATE_LIMITED").when(F.col("user_id") % 6 == 2, "LLM_FAILED").when(F.col("user_id") % 6 == 3, "SEARCH_FAILED").when(F.col("user_id") % 6 == 4, "ODD")
    named = table(spark, sf_dir, "events").filter("event_type = 'error'").select(pr.failure_class(code).alias("failure"))
    return named.groupBy("failure").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", pr.failure_copy(F.col("failure")))


def probe_lists(spark, sf_dir) -> DataFrame:
    text = F.col("text")
    subs = F.array(F.lit("one"), text, F.lit("one"), F.lit("two"), F.concat(F.lit("three "), F.col("item_id").cast("string")), F.lit("four"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.array_join(pr.probes(text, subs), "|"), 256).alias("probes"))


def golden_integrity(spark, sf_dir) -> DataFrame:
    """Documents as passages (two of them twice) and benchmark items as questions, some with unknown passages or the wrong band."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    passages = docs.unionByName(docs.filter("id IN (3, 8)"))
    i = F.col("item_id")
    none = F.array().cast("array<bigint>")
    questions = table(spark, sf_dir, "benchmark").select(i.alias("id"), F.when(i % 4 == 0, "unanswerable").otherwise("answerable").alias("band"), F.when(i % 5 == 0, none).otherwise(F.array(i, i + F.when(i % 7 == 0, 10**9).otherwise(1))).alias("supporting"), F.when(i % 3 == 0, F.array(F.lit(-1).cast("long"))).otherwise(none).alias("distractors"))
    return golden.integrity(passages, questions)


def cited_subsets(spark, sf_dir) -> DataFrame:
    """Whether a turn's first words all stand in the turn before it."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), 0))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"))
    before = F.coalesce(F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    return turns.withColumn("before", before).select("conv_id", "turn", golden.subset(F.slice("words", 1, 2), F.col("before")).alias("all_known"))


def model_overrides(spark, sf_dir) -> DataFrame:
    """Defaults for each region's slot; overrides by nations of the same number, some blank, some for slots that don't exist."""
    slots = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("slot"), F.lit("default").alias("model"))
    stored = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("slot"), F.when(F.col("n_nationkey") % 3 == 1, " ").otherwise(F.col("n_name")).alias("model"))
    return golden.overrides(slots, stored)


def sidebar(spark, sf_dir) -> DataFrame:
    """Each owner's chats with their place: last updated first, then last created."""
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("created_at"), F.desc("id")))
    return app(spark, sf_dir, "chats").select("owner_id", "id", place.alias("place"))


def base_lookups(spark, sf_dir) -> DataFrame:
    """Bases of an owner, global ones, and a conversation's."""
    bases, out = app(spark, sf_dir, "kb"), None
    for name, hit in (("owner", F.col("owner_id") == 3), ("global", F.col("visibility") == "GLOBAL"), ("chat", F.col("conversation_id") == 12)):
        rows = bases.filter(hit).select(F.lit(name).alias("how"), "id", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


def document_pages(spark, sf_dir) -> DataFrame:
    """A page of all documents by id, and one document by its key."""
    docs = app(spark, sf_dir, "docs").select("id", "status")
    return d.page(docs, F.col("id"), limit=100, offset=50).unionByName(docs.filter("id = 7"))


def status_changes(spark, sf_dir) -> DataFrame:
    """Jobs of a document in order: those whose status differs from the one before, and what they announce."""
    w = Window.partitionBy("document_id").orderBy("created_at", "id")
    jobs = app(spark, sf_dir, "jobs").withColumn("before", F.lag("status").over(w))
    changed = jobs.filter(~F.col("status").eqNullSafe(F.col("before")))
    return changed.select("document_id", "id", F.concat(F.coalesce("before", F.lit("new")), F.lit(" > "), F.col("status")).alias("change"))


_FENCES = (pr.FENCE_OPEN, pr.FENCE_CLOSE)
SQL = {
    "prompt_sources": f"""WITH {app_sql('docs')}, p AS (SELECT d.*, t.text, row_number() OVER (PARTITION BY knowledge_base_id ORDER BY size_bytes DESC, id) AS place FROM docs d JOIN documents t ON t.doc_id = d.id QUALIFY place <= 8)
SELECT knowledge_base_id, CAST(place AS INTEGER) AS place, (place - 1) // 5 AS batch, CAST((place - 1) % 5 + 1 AS INTEGER) AS number, sha256(concat_ws(chr(10), '{_FENCES[0]}', '[S' || place || '] filename=' || filename || ' locator=' || coalesce('p. ' || page_count, ''), substring(text, 1, 1200), '{_FENCES[1]}')) AS block FROM p""",
    "chunk_metadata": f"""WITH {app_sql('chunks')} SELECT id, CASE WHEN id % 7 > 2 THEN CAST(id % 9 AS INTEGER) END AS block_order, CASE WHEN id % 7 > 2 THEN CAST(id % 4 AS INTEGER) END AS block_chunk_index, CASE WHEN id % 7 > 2 AND id % 5 > 0 THEN 'rows ' || (id % 50) END AS label,
CASE WHEN id % 7 > 2 THEN CAST(id % 100 AS INTEGER) END AS char_start, CASE WHEN id % 7 > 2 THEN CAST(id % 100 + id % 30 AS INTEGER) END AS char_end, CASE WHEN id % 7 > 2 THEN CAST(id % 30 + id % 2 AS INTEGER) END AS char_count,
CASE WHEN id % 7 > 2 THEN CASE id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'ocr' ELSE 'text' END END AS extraction FROM chunks""",
    "detected_types": f"""WITH {app_sql('docs')} SELECT id, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN 'pdf' WHEN id % 4 = 1 AND id % 3 = 1 THEN 'docx' WHEN id % 4 > 1 AND id % 3 = 2 AND id % 5 > 0 THEN CASE id % 4 WHEN 2 THEN 'csv' ELSE 'md' END END AS suffix FROM docs""",
    "failure_texts": "WITH c AS (SELECT CASE user_id % 6 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'RATE_LIMITED' WHEN 2 THEN 'LLM_ERROR' WHEN 3 THEN 'RETRIEVAL_UNAVAILABLE' ELSE 'SYSTEM_FAILURE' END AS failure FROM events WHERE event_type = 'error') SELECT failure, count(*) AS n, CASE failure " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in pr.COPY.items()) + f" ELSE '{pr.SYSTEM[1]}' END AS copy FROM c GROUP BY failure",
    "probe_lists": "SELECT item_id, sha256(concat_ws('|', text, 'one', 'two', 'three ' || item_id)) AS probes FROM benchmark",
    "golden_integrity": """WITH q AS (SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN [] ELSE [item_id, item_id + CASE WHEN item_id % 7 = 0 THEN 1000000000 ELSE 1 END] END AS s, CASE WHEN item_id % 3 = 0 THEN [-1] ELSE [] END AS n FROM benchmark),
r AS (SELECT id, unnest(list_concat(s, n)) AS p FROM q)
SELECT 'repeated_passage' AS what, doc_id AS id FROM documents WHERE doc_id IN (3, 8) UNION ALL SELECT DISTINCT 'unknown_reference', id FROM r WHERE p NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'band_rule', id FROM q WHERE (id % 4 = 0) = (len(s) > 0)""",
    "cited_subsets": "WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS words FROM conversations), p AS (SELECT *, list_filter(words, lambda x, i: list_position(words, x) = i)[1:2] AS cited, coalesce(lag(words) OVER (PARTITION BY conv_id ORDER BY turn), []) AS before FROM w) SELECT conv_id, turn, list_has_all(before, cited) AS all_known FROM p",
    "model_overrides": "SELECT CAST(r_regionkey AS BIGINT) AS slot, CASE WHEN r_regionkey % 3 = 1 THEN 'default' ELSE n_name END AS model FROM region JOIN nation ON n_nationkey = r_regionkey",
    "sidebar": f"WITH {app_sql('chats')} SELECT owner_id, id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC NULLS LAST, created_at DESC, id DESC) AS INTEGER) AS place FROM chats",
    "base_lookups": f"WITH {app_sql('kb')} SELECT 'owner' AS how, id, name FROM kb WHERE owner_id = 3 UNION ALL SELECT 'global', id, name FROM kb WHERE visibility = 'GLOBAL' UNION ALL SELECT 'chat', id, name FROM kb WHERE conversation_id = 12",
    "document_pages": f"WITH {app_sql('docs')} (SELECT id, status FROM docs ORDER BY id LIMIT 100 OFFSET 50) UNION ALL SELECT id, status FROM docs WHERE id = 7",
    "status_changes": f"WITH {app_sql('jobs')}, b AS (SELECT *, lag(status) OVER (PARTITION BY document_id ORDER BY created_at, id) AS before FROM jobs) SELECT document_id, id, coalesce(before, 'new') || ' > ' || status AS change FROM b WHERE status IS DISTINCT FROM before",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}

"""The application's tables, derived from the driver's in expressions that Spark and DuckDB read alike.

Times are whole seconds. Each entry: source table, {column: expression}, and whether rows are made distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PIPELINE = "'1/2000/200/200/0.5'"
APP: dict[str, tuple[str, dict[str, str], bool]] = {
    "kb": ("nation", {
        "id": "CAST(n_nationkey AS BIGINT)",
        "tenant_id": "'t' || CAST(n_nationkey % 2 AS STRING)",
        "owner_id": "CAST(n_nationkey % 7 AS BIGINT)",
        "conversation_id": "CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey AS BIGINT) END",
        "visibility": "CASE WHEN n_nationkey % 5 = 0 THEN 'GLOBAL' ELSE 'CONVERSATION' END",
        "name": "n_name",
    }, False),
    "docs": ("documents", {
        "id": "doc_id",
        "tenant_id": "'t' || CAST(doc_id % 2 AS STRING)",
        "owner_id": "doc_id % 7",
        "knowledge_base_id": "doc_id % 25",
        "filename": "'file' || CAST(doc_id AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.csv' ELSE '.md' END",
        "checksum": "md5(text)",
        "size_bytes": "CAST(n_chars AS BIGINT)",
        "current_version": "CAST(1 + doc_id % 3 AS INT)",
        "status": "CASE doc_id % 8 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'DELETED' ELSE 'ACTIVE' END",
        "searchable": "doc_id % 8 <> 3 AND doc_id % 8 <> 0",
        "page_count": "CASE WHEN doc_id % 4 < 2 THEN CAST(doc_id % 60 AS INT) END",
        "chunk_count": "CAST(doc_id % 40 AS INT)",
        "error_message": "CASE WHEN doc_id % 8 = 2 THEN 'broken' END",
        "deleted_at": "CASE WHEN doc_id % 8 = 3 OR doc_id % 13 = 0 THEN doc_id * 10 + 5 END",
        "created_at": "doc_id * 10",
        "updated_at": "doc_id * 10 + doc_id % 900",
    }, False),
    "chunks": ("lineitem", {
        "id": "l_orderkey * 10 + l_linenumber",
        "document_id": "l_partkey",
        "document_version": "CAST(1 + l_suppkey % 3 AS INT)",
        "chunk_index": "l_orderkey * 10 + l_linenumber",
        "tenant_id": "'t' || CAST(l_partkey % 2 AS STRING)",
        "knowledge_base_id": "l_partkey % 25",
        "embedding_fingerprint": "CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
        "token_count": "CAST(l_quantity AS BIGINT)",
        "vector": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax END",
        "meta": f"""CASE WHEN l_suppkey % 11 = 0 THEN '{{}}' ELSE '{{"embedding_model":"embed-' || CASE WHEN l_partkey % 6 = 0 THEN '1' ELSE '2' END || '","chunking_version":"' || CASE WHEN l_partkey % 9 = 0 THEN '1/1000/100/100/0.5' ELSE {_PIPELINE} END || '","preprocessing_version":"1"}}' END""",
    }, False),
    "jobs": ("orders", {
        "id": "o_orderkey",
        "document_id": "o_custkey",
        "job_type": "CASE WHEN o_orderkey % 5 = 0 THEN 'DELETE' ELSE 'INGEST' END",
        "document_version": "CAST(1 + o_orderkey % 4 AS INT)",
        "status": "CASE WHEN o_orderkey % 9 = 0 THEN 'QUEUED' WHEN o_orderkey % 9 = 1 THEN 'RUNNING' WHEN o_orderkey % 9 = 2 THEN 'FAILED' ELSE 'SUCCEEDED' END",
        "progress": "CAST(o_orderkey % 100 AS INT)",
        "attempt_count": "CAST(o_orderkey % 6 AS INT)",
        "idempotency_key": "'job:' || CAST(o_orderkey AS STRING)",
        "error_code": "CASE WHEN o_orderkey % 9 = 0 AND o_orderkey % 2 = 0 THEN 'ENQUEUE_FAILED' WHEN o_orderkey % 9 = 2 THEN 'PARSE_FAILED' END",
        "started_at": "CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey * 10 + 1 END",
        "completed_at": "CASE WHEN o_orderkey % 9 > 1 THEN o_orderkey * 10 + 9 END",
        "created_at": "o_orderkey * 10",
    }, False),
    "chats": ("conversations", {
        "id": "conv_id",
        "tenant_id": "'t' || CAST(conv_id % 2 AS STRING)",
        "owner_id": "conv_id % 7",
        "title": "'Chat ' || CAST(conv_id AS STRING)",
        "created_at": "conv_id * 100",
        "updated_at": "conv_id * 100 + conv_id % 3 * 1000",
    }, True),
    "messages": ("conversations", {
        "id": "conv_id * 1000 + turn",
        "conversation_id": "conv_id",
        "seq": "CAST(turn AS BIGINT)",
        "role": "CASE role WHEN 'assistant' THEN 'AI' WHEN 'user' THEN 'USER' ELSE 'SYSTEM' END",
        "content": "text",
        "feedback": "CASE WHEN role = 'assistant' AND (conv_id + turn) % 4 = 0 THEN 'UP' WHEN role = 'assistant' AND (conv_id + turn) % 4 = 1 THEN 'DOWN' END",
        "evaluation": """CASE WHEN role = 'assistant' AND conv_id % 3 > 0 THEN '{"relevancy":' || CAST(conv_id % 11 AS STRING) || ',"faithfulness":' || CAST((conv_id + turn) % 11 AS STRING) || '}' END""",
        "citations": """CASE WHEN role = 'assistant' AND conv_id % 4 > 0 THEN '{"segments":[{"chunkId":"c' || CAST(conv_id % 5 AS STRING) || '","doc":"d' || CAST(conv_id % 5 AS STRING) || '"},{"text":"and"},{"chunkId":"c' || CAST(turn % 5 AS STRING) || '","doc":"d' || CAST(turn % 5 AS STRING) || '"}]}' END""",
        "model_name": "CASE WHEN role = 'assistant' AND conv_id % 5 > 0 THEN 'model-' || CAST((conv_id + turn) % 3 AS STRING) ELSE '' END",
        "created_at": "conv_id * 100 + turn",
    }, False),
    "telemetry": ("conversations", {
        "message_id": "conv_id * 1000 + turn",
        "conversation_id": "conv_id",
        "owner_id": "conv_id % 7",
        "role": "role",
        "outcome": "CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL WHEN (conv_id + turn) % 5 = 1 THEN 'abstained' ELSE 'answered' END",
        "error_code": "CASE WHEN conv_id % 3 = 0 AND (conv_id + turn) % 5 = 0 THEN 'TIMEOUT' END",
        "groundedness": "CASE WHEN conv_id % 6 = 0 THEN NULL ELSE CAST((conv_id * 7 + turn * 3) % 11 AS DOUBLE) / 10 END",
        "created_at": "conv_id * 100 + turn",
    }, False),
    "audit": ("events", {
        "id": "event_id",
        "event_type": "upper(event_type)",
        "actor_id": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END",
        "target_type": "CASE WHEN event_id % 2 = 0 THEN 'document' END",
        "target_id": "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 50 AS STRING) END",
        "details": "props",
        "created_at": "event_id % 97",
    }, False),
    "checkpoints": ("events", {
        "thread_id": "user_id",
        "checkpoint_ns": "event_type",
        "checkpoint_id": "event_id",
        "ts": "ts",
        "checkpoint": """'{"channel_versions":{"messages":"' || CAST(event_id % 3 AS STRING) || '","state":"' || CAST(event_id % 7 AS STRING) || '"}}'""",
    }, False),
    "writes": ("events", {"thread_id": "user_id", "checkpoint_ns": "event_type", "checkpoint_id": "event_id", "idx": "CAST(event_id % 4 AS INT)"}, False),
    "blobs": ("events", {"thread_id": "user_id", "checkpoint_ns": "event_type", "channel": "CASE WHEN event_id % 2 = 0 THEN 'messages' ELSE 'state' END", "version": "CAST(event_id % 7 AS STRING)"}, True),
}
PIPELINE = {"embedding_model": "embed-2", "chunking_version": "1/2000/200/200/0.5", "preprocessing_version": "1"}


def app(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, distinct = APP[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    return rows.distinct() if distinct else rows


def app_sql(*names: str) -> str:
    """The same tables as common table expressions."""
    made = []
    for name in names:
        source, columns, distinct = APP[name]
        made.append(f"{name} AS (SELECT {'DISTINCT ' if distinct else ''}{', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})")
    return ", ".join(made)

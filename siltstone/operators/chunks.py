"""Stored chunks: what has drifted from the configured pipeline, sources of vectors, and checks after a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INPUTS = ("embedding_model", "chunking_version", "preprocessing_version")


def drifted(name: str, configured: dict[str, str], meta: str = "meta") -> Column:
    """Whether a chunk's provenance says anything but the configured value; a missing one does."""
    return ~F.get_json_object(meta, f"$.{name}").eqNullSafe(F.lit(configured[name]))


def drift_by_document(chunks: DataFrame, docs: DataFrame, configured: dict[str, str], *, owner_id: int | None = None) -> DataFrame:
    """(document_id, chunks, tokens, a flag for each input, inputs) of live searchable documents' current versions of which any chunk has drifted."""
    live = docs.filter(F.col("searchable") & F.col("deleted_at").isNull() & (F.lit(True) if owner_id is None else F.col("owner_id") == owner_id))
    own = live.select(F.col("id").alias("document_id"), F.col("current_version").alias("document_version"), "created_at")
    flags = [F.bool_or(drifted(name, configured)).alias(name) for name in INPUTS]
    grouped = chunks.join(own, ["document_id", "document_version"]).groupBy("document_id", "created_at").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), *flags)
    inputs = F.array_join(F.array_compact(F.array(*[F.when(F.col(name), F.lit(name)) for name in INPUTS])), ",")
    return grouped.withColumn("inputs", inputs).filter(" OR ".join(INPUTS))


def split_by_work(stale: DataFrame, jobs: DataFrame) -> DataFrame:
    """stale with `in_flight`: whether an ingestion of the document is open."""
    busy = jobs.filter((F.col("job_type") == "INGEST") & F.col("status").isin("QUEUED", "RUNNING")).select("document_id").distinct().withColumn("in_flight", F.lit(True))
    return stale.join(busy, "document_id", "left").withColumn("in_flight", F.coalesce("in_flight", F.lit(False)))


def drift_totals(stale: DataFrame) -> DataFrame:
    """Documents, chunks and tokens to rebuild, for those that wait and those at work."""
    return stale.groupBy("in_flight").agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"))


def is_stale(chunks: DataFrame, document_id: int, version: int, configured: dict[str, str]) -> DataFrame:
    """One row: whether any chunk of a version has drifted; false where it has none."""
    own = chunks.filter((F.col("document_id") == document_id) & (F.col("document_version") == version))
    any_of = F.bool_or(drifted(INPUTS[0], configured) | drifted(INPUTS[1], configured) | drifted(INPUTS[2], configured))
    return own.agg(F.coalesce(any_of, F.lit(False)).alias("stale"))


def rebuilds(docs: DataFrame, chunks: DataFrame, originals: DataFrame, jobs: DataFrame, configured: dict[str, str]) -> DataFrame:
    """(id, verdict, version, idempotency_key, superseded) of live documents asked to be built anew by the configured pipeline.

    originals: (id, checksum) of what is stored now. In this order: not_active, not_stale (no chunk of the
    current version has drifted), corrupt (the original is gone or isn't the one that was recorded), or
    queued, as the version after the last one that an ingestion was begun for; its open ingestions are superseded.
    """
    any_of = F.bool_or(drifted(INPUTS[0], configured) | drifted(INPUTS[1], configured) | drifted(INPUTS[2], configured))
    stale = chunks.groupBy(F.col("document_id").alias("id"), F.col("document_version").alias("current_version")).agg(any_of.alias("stale"))
    begun = jobs.filter("job_type = 'INGEST'").groupBy(F.col("document_id").alias("id")).agg(F.max("document_version").alias("begun"), F.count_if(F.col("status").isin("QUEUED", "RUNNING")).alias("open"))
    live = docs.filter(F.col("deleted_at").isNull()).select("id", "status", "checksum", "current_version")
    met = live.join(stale, ["id", "current_version"], "left").join(originals.select("id", F.col("checksum").alias("found")), "id", "left").join(begun, "id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    verdict = F.when(no(F.col("status") == "ACTIVE"), "not_active").when(no(F.col("stale")), "not_stale").when(no(F.col("found") == F.col("checksum")), "corrupt").otherwise("queued")
    version = F.when(F.col("verdict") == "queued", F.coalesce("begun", "current_version") + 1)
    key = F.concat(F.lit("ingest:"), F.col("id").cast("string"), F.lit(":v"), F.col("version").cast("string"))
    found = met.withColumn("verdict", verdict).withColumn("version", version)
    return found.select("id", "verdict", "version", key.alias("idempotency_key"), F.when(F.col("version").isNotNull(), F.coalesce("open", F.lit(0))).alias("superseded"))


def vector_sources(chunks: DataFrame, exclude: DataFrame) -> DataFrame:
    """(document_id, embedding_fingerprint, version): the newest version that has a vector of each fingerprint, not the document's excluded one (document_id, version)."""
    other = exclude.select("document_id", F.col("version").alias("__excluded"))
    kept = chunks.filter(F.col("vector").isNotNull()).join(other, "document_id", "left").filter("__excluded IS NULL OR document_version <> __excluded")
    return kept.groupBy("document_id", "embedding_fingerprint").agg(F.max("document_version").alias("version"))


def missing_vectors(chunks: DataFrame) -> DataFrame:
    """(document_id, document_version, missing): the check after an ingestion; versions without a gap have 0."""
    return chunks.groupBy("document_id", "document_version").agg(F.count_if(F.col("vector").isNull()).alias("missing"))


def of_version(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The current versions' chunks with their place, in the order of chunk_index within the document."""
    from pyspark.sql import Window

    own = docs.select(F.col("id").alias("document_id"), F.col("current_version").alias("document_version"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))
    return chunks.join(own, ["document_id", "document_version"]).select("document_id", "chunk_index", place.alias("place"))

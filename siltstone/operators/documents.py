"""Documents, their knowledge bases, chunks and jobs: who may read what, listings, lookups, and states as rewrites.

States are functions from a table to its next one: `on` says which rows change.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("QUEUED", "RUNNING")
DONE = ("SUCCEEDED", "FAILED", "DEAD_LETTER")


# ---- access -------------------------------------------------------------------------------------


class Reader(NamedTuple):
    """Who reads and from where. None leaves a restriction out, but for the scope: documents is what a question mentions."""

    tenant_id: str
    owner_id: int
    conversation_id: int | None = None
    ambient: bool = True
    knowledge_bases: list[int] | None = None
    documents: list[int] | None = None


def reader_of(tenant_id: str, owner_id: int, conversation_id: int | None, mentioned: list[str] | None, knowledge_bases: list[int] | None = None) -> Reader | None:
    """The filter of a turn; mentions of which none can be read as an id give None: retrieve nothing, not everything."""
    ids = None if not mentioned else [int(x) for x in mentioned if x.strip().isdecimal()]
    return None if ids == [] else Reader(tenant_id, owner_id, conversation_id, ids is None and knowledge_bases is None, knowledge_bases, ids)


def readable(chunks: DataFrame, docs: DataFrame, bases: DataFrame, reader: Reader | None) -> DataFrame:
    """Chunks joined with their documents, those that the reader may see: one tenant on both sides, own live searchable documents, current version.

    The document's status takes no part. Ambient scope: knowledge bases that are global or the
    conversation's. Seven columns of the retrieval arms, and the document's owner.
    """
    if reader is None:
        return readable(chunks, docs, bases, Reader("", -1)).limit(0)
    own = docs.filter((F.col("tenant_id") == reader.tenant_id) & (F.col("owner_id") == reader.owner_id) & F.col("searchable") & F.col("deleted_at").isNull())
    if reader.documents is not None:
        own = own.filter(F.col("id").isin(reader.documents))
    if reader.knowledge_bases is not None:
        own = own.filter(F.col("knowledge_base_id").isin(reader.knowledge_bases))
    if reader.ambient:
        mine = F.lit(False) if reader.conversation_id is None else F.coalesce(F.col("conversation_id") == reader.conversation_id, F.lit(False))
        scope = bases.filter((F.col("visibility") == "GLOBAL") | mine).select(F.col("id").alias("knowledge_base_id"))
        own = own.join(scope, "knowledge_base_id", "left_semi")
    own = own.select(F.col("id").alias("document_id"), F.col("current_version").alias("document_version"), "filename", "owner_id")
    of = chunks.filter(F.col("tenant_id") == reader.tenant_id)
    return of.join(own, ["document_id", "document_version"]).select("id", "document_id", "document_version", "chunk_index", "knowledge_base_id", "filename", "meta", "owner_id")


def scope_base(bases: DataFrame, owner_id: int, scope: str, conversation_id: int | None) -> DataFrame:
    """(knowledge_base_id) of an upload's scope: the owner's global base or the conversation's; none where it is unknown."""
    own = bases.filter(F.col("owner_id") == owner_id)
    if scope == "GLOBAL":
        return own.filter(F.col("visibility") == "GLOBAL").select(F.min("id").alias("knowledge_base_id")).filter("knowledge_base_id IS NOT NULL")
    return own.filter(F.col("conversation_id") == F.lit(conversation_id)).select(F.col("id").alias("knowledge_base_id"))


# ---- listings and lookups -----------------------------------------------------------------------


def page(df: DataFrame, *order: Column, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in a given order; the order should end in a unique key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def listing(docs: DataFrame, bases: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each document with its base's visibility and its newest job (created, then id), null without one.

    The newest job is one aggregation with partial results, not a sort of all jobs of a document.
    """
    newest = jobs.groupBy("document_id").agg(F.max_by(F.struct("id", "status", "document_version", "error_code"), F.struct("created_at", "id")).alias("job"))
    named = docs.join(bases.select(F.col("id").alias("knowledge_base_id"), "visibility"), "knowledge_base_id")
    met = named.join(newest.withColumnRenamed("document_id", "id"), "id", "left")
    return met.select(*docs.columns, "visibility", F.col("job.id").alias("job_id"), F.col("job.status").alias("job_status"), F.col("job.document_version").alias("job_version"), F.col("job.error_code").alias("job_error"))


def owner_page(listed: DataFrame, owner_id: int, *, knowledge_base_id: int | None = None, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """An owner's live documents, newest first."""
    own = listed.filter((F.col("owner_id") == owner_id) & F.col("deleted_at").isNull())
    for name, value in (("knowledge_base_id", knowledge_base_id), ("status", status)):
        own = own if value is None else own.filter(F.col(name) == value)
    return page(own, F.desc("created_at"), F.desc("id"), limit=limit, offset=offset)


def one_listing(listed: DataFrame, document_id: int, owner_id: int | None) -> DataFrame:
    """One document, deleted ones too; without an owner (an administrator) any."""
    return listed.filter((F.col("id") == document_id) & (F.lit(True) if owner_id is None else F.col("owner_id") == owner_id))


def same_checksum(docs: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, id): for each new upload (id, knowledge_base_id, checksum) the oldest live document of its base with the same content."""
    live = docs.filter(F.col("deleted_at").isNull()).groupBy("knowledge_base_id", "checksum").agg(F.min("id").alias("id"))
    return new.select(F.col("id").alias("new_id"), "knowledge_base_id", "checksum").join(live, ["knowledge_base_id", "checksum"]).filter("id < new_id").select("new_id", "id")


def scoped_jobs(jobs: DataFrame, docs: DataFrame, owner_id: int | None) -> DataFrame:
    """Jobs whose document belongs to the owner; all jobs of known documents for an administrator."""
    own = docs if owner_id is None else docs.filter(F.col("owner_id") == owner_id)
    return jobs.join(own.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def job_facts(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each document: open ingestions, whether it has a deletion, its latest ingested version (null if none), and ingestions of its current version."""
    ingest = F.col("job_type") == "INGEST"
    met = docs.select("id", "current_version").join(jobs.select(F.col("document_id").alias("id"), "job_type", "status", "document_version"), "id", "left")
    return met.groupBy("id").agg(
        F.count_if(ingest & F.col("status").isin(*OPEN)).alias("open_ingests"),
        F.coalesce(F.bool_or(F.col("job_type") == "DELETE"), F.lit(False)).alias("has_deletion"),
        F.max(F.when(ingest, F.col("document_version"))).alias("latest_version"),
        F.count_if(ingest & (F.col("document_version") == F.col("current_version"))).alias("current_ingests"),
    )


def undispatched(jobs: DataFrame, older_than: int, limit: int = 100) -> DataFrame:
    """Ingestions that wait because they could not be queued, oldest first."""
    stuck = (F.col("job_type") == "INGEST") & (F.col("status") == "QUEUED") & (F.col("error_code") == "ENQUEUE_FAILED") & (F.col("created_at") < older_than)
    return page(jobs.filter(stuck), F.col("created_at"), F.col("id"), limit=limit)


def row_state(listed: DataFrame, conversation_id: int, now: int, stall_after: int = 900) -> DataFrame:
    """How a document's row is shown: its section, whether it is stalled, whether a failed one replaces a version, and what may be done with it."""
    idle = F.col("status").isin(*OPEN) & (F.lit(now) - F.col("updated_at") > stall_after)
    block = F.when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("status").isin(*OPEN) & ~idle, "busy")
    return listed.select(
        "id",
        F.when(F.col("visibility") == "GLOBAL", "global").when(F.col("knowledge_base_id") == conversation_id, "chat").alias("section"),
        idle.alias("stalled"),
        F.coalesce((F.col("status") == "FAILED") & (F.col("job_version") > F.col("current_version")), F.lit(False)).alias("replace_failed"),
        block.alias("blocked"),
    )


# ---- states -------------------------------------------------------------------------------------


def _changed(df: DataFrame, on: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(on, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def set_status(docs: DataFrame, on: Column, status: str, *, error_message: str | None = None, clear_error: bool = False) -> DataFrame:
    """A status; an error is kept unless one is given or it is cleared."""
    error = F.lit(error_message) if error_message is not None else F.lit(None).cast("string") if clear_error else F.col("error_message")
    return _changed(docs, on, status=F.lit(status), error_message=error)


def mark_active(docs: DataFrame, swapped: DataFrame) -> DataFrame:
    """docs after the swap: those of swapped (id, chunk_count, version, page_count) serve the new version, without an error; page_count is set even to null."""
    new = swapped.select("id", F.struct("chunk_count", "version", "page_count").alias("__new"))
    met, hit = docs.join(new, "id", "left"), F.col("__new").isNotNull()
    none = F.lit(None).cast("string")
    return _changed(met, hit, status=F.lit("ACTIVE"), chunk_count=F.col("__new.chunk_count"), current_version=F.col("__new.version"), page_count=F.col("__new.page_count"), searchable=F.lit(True), error_message=none).select(docs.columns)


def delete_gate(docs: DataFrame, on: Column) -> DataFrame:
    """Out of every search at once, before anything is purged."""
    return _changed(docs, on, status=F.lit("DELETE_PENDING"), searchable=F.lit(False))


def tombstone(docs: DataFrame, on: Column, now: int) -> DataFrame:
    return _changed(docs, on, status=F.lit("DELETED"), deleted_at=F.lit(now).cast("long"), chunk_count=F.lit(0))


def update_jobs(jobs: DataFrame, on: Column, status: str, now: int, *, progress: int | None = None, error_code: str | None = None, clear_error: bool = False) -> DataFrame:
    """A job's next state: started once, completed when final; null arguments leave their column."""
    values = {"status": F.lit(status)}
    if progress is not None:
        values["progress"] = F.lit(progress)
    if clear_error:
        values["error_code"] = F.lit(None).cast("string")
    if error_code is not None:
        values["error_code"] = F.lit(error_code)
    if status == "RUNNING":
        values["started_at"] = F.coalesce("started_at", F.lit(now).cast("long"))
    if status in DONE:
        values["completed_at"] = F.lit(now).cast("long")
    return _changed(jobs, on, **values)


def requeue(jobs: DataFrame, on: Column) -> DataFrame:
    """Back to the queue; the number of attempts stays."""
    return _changed(jobs, on, status=F.lit("QUEUED"), progress=F.lit(0), error_code=F.lit(None).cast("string"), completed_at=F.lit(None).cast("long"))


def after_failure(jobs: DataFrame, on: Column, now: int, error_code: str, *, terminal: Column, most: int = 5) -> DataFrame:
    """Failed for good, to the dead letters at the last try, or back to the queue for another."""
    last = F.col("attempt_count") >= most
    status = F.when(terminal, "FAILED").when(last, "DEAD_LETTER").otherwise("QUEUED")
    return _changed(jobs, on, status=status, error_code=F.lit(error_code), completed_at=F.when(terminal | last, F.lit(now).cast("long")))


def supersede(jobs: DataFrame) -> DataFrame:
    """Open ingestions that are older than another one of their document are superseded."""
    newest = Window.partitionBy("document_id", "job_type")
    older = (F.col("job_type") == "INGEST") & F.col("status").isin(*OPEN) & (F.col("id") < F.col("__newest"))
    return _changed(jobs.withColumn("__newest", F.max("id").over(newest)), older, status=F.lit("SUPERSEDED")).drop("__newest")


def next_version(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, version): one above every version that a document has or that any ingestion was begun for."""
    begun = jobs.filter("job_type = 'INGEST'").groupBy(F.col("document_id").alias("id")).agg(F.max("document_version").alias("begun"))
    return docs.select("id", "current_version").join(begun, "id", "left").select("id", (F.greatest("current_version", F.coalesce("begun", F.lit(0))) + 1).alias("version"))


def admit(docs: DataFrame, uploads: DataFrame, quota: int) -> DataFrame:
    """(id, verdict) of uploads (id, owner_id, knowledge_base_id, checksum, size_bytes), judged one after another by id: over_quota, duplicate or accepted.

    Each is held against what is stored and what was accepted before it; only accepted ones take room. A base
    has one owner and equal checksums equal sizes, so a further copy in a base never takes room: its first
    one did, or was beyond the quota too. That leaves one number an owner, the room. Owners whose uploads
    all fit, and uploads larger than the room at the start, need no order; the others' go through a task as
    a sorted stream, nothing of it is held.
    """
    live = docs.filter(F.col("deleted_at").isNull())
    used = live.groupBy("owner_id").agg(F.sum("size_bytes").alias("used"))
    known = live.filter("checksum IS NOT NULL").groupBy("knowledge_base_id", "checksum").agg(F.lit(True).alias("known"))
    first = uploads.filter("checksum IS NOT NULL").groupBy("knowledge_base_id", "checksum").agg(F.min("id").alias("first"))
    met = uploads.join(used, "owner_id", "left").join(known, ["knowledge_base_id", "checksum"], "left").join(first, ["knowledge_base_id", "checksum"], "left")
    rows = met.select("id", "owner_id", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size"), (F.lit(quota).cast("long") - F.coalesce("used", F.lit(0))).alias("room"), (F.col("known").isNull() & F.coalesce(F.col("first") == F.col("id"), F.lit(True))).alias("fresh"))
    rows = rows.withColumn("fits", F.col("size") <= F.col("room"))
    # with all that fit at the start accepted, is there still room for the largest of them?
    asked = rows.groupBy("owner_id").agg((F.coalesce(F.sum(F.when(F.col("fresh") & F.col("fits"), F.col("size"))), F.lit(0)) + F.coalesce(F.max(F.when(F.col("fits"), F.col("size"))), F.lit(0)) > F.min("room")).alias("tight"))
    rows = rows.join(asked.select(F.col("owner_id").alias("asker"), "tight"), F.col("owner_id").eqNullSafe(F.col("asker"))).drop("asker")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, left = object(), 0
        for batch in batches:
            fits = []
            for of, size, room, fresh in zip(*(batch.column(c).to_pylist() for c in ("owner_id", "size", "room", "fresh"))):
                owner, left = of, left if of == owner else room
                fits.append(size <= left)
                left -= size if fresh and fits[-1] else 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fresh"), pa.array(fits, pa.bool_())], ["id", "fresh", "fits"])

    kind = uploads.schema["id"].dataType.simpleString()
    ordered = rows.filter("tight AND fits").select("owner_id", "id", "size", "room", "fresh").repartition("owner_id").sortWithinPartitions("owner_id", "id")
    judged = ordered.mapInArrow(judge, f"id {kind}, fresh boolean, fits boolean").unionByName(rows.filter("NOT (tight AND fits)").select("id", "fresh", "fits"))
    return judged.select("id", F.when(~F.col("fits"), "over_quota").when(~F.col("fresh"), "duplicate").otherwise("accepted").alias("verdict"))


def swept(jobs: DataFrame, refused: DataFrame, older_than: int, limit: int = 100) -> DataFrame:
    """jobs after a sweep: the undispatched ones are sent again, oldest first, up to the first that the queue refuses (id); their error is cleared."""
    oldest = Window.orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)  # over `limit` rows at most
    no = refused.select("id").distinct().withColumn("no", F.lit(True))
    sent = undispatched(jobs, older_than, limit).join(no, "id", "left").withColumn("stopped", F.max(F.coalesce("no", F.lit(False))).over(oldest))
    done = sent.filter("NOT stopped").select("id", F.lit(True).alias("sent"))
    clear = lambda c: F.when(F.col("sent"), None).otherwise(F.col(c)).alias(c)
    return jobs.join(done, "id", "left").select(*[clear(c) if c in ("error_code", "error_message") else F.col(c) for c in jobs.columns], F.coalesce("sent", F.lit(False)).alias("sent"))

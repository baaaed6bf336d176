"""Ingestion in stages with one commit: readers see a document's old version until all of the new one is there.

Stages: parse (normalise; what can't be read is an error row, not a failure of the run), chunk, plan
(fingerprints against the stored chunks, so that only new ones need a vector), write. Each is written to the
run's own partition. The commit is one small write at the end, of pointers: which version of each
document lives in which run. A run that fails before it has changed nothing that readers see, and can
be run again under the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import chunking
from siltstone.functions.text import is_blank, normalized
from siltstone.streaming.consumer import read

MOST_CHARS = 5_000_000
CHUNKS = "document_id bigint, version bigint, chunk_index int, chunk_text string, chunk_hash string, embedding_fingerprint string, token_count bigint, reused boolean, run bigint"
POINTERS = "document_id bigint, version bigint, run bigint"
ERRORS = "document_id bigint, version bigint, stage string, error string, run bigint"


def parse(sources: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """sources (document_id, version, text) with the normalised `body`, or an `error`."""
    size = F.length("text")
    error = F.when(F.col("text").isNull(), "NO_CONTENT").when(size > most_chars, "TOO_LARGE").when(is_blank(F.col("text")), "EMPTY")
    return sources.withColumn("error", error).withColumn("body", F.when(F.col("error").isNull(), normalized(F.col("text")))).drop("text")


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, version, run): what readers see of each document; the last committed run counts."""
    return read(spark, f"{path}/pointers", POINTERS).groupBy("document_id").agg(F.max_by(F.struct("version", "run"), "run").alias("last")).select("document_id", "last.version", "last.run")


def visible(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that readers see."""
    return read(spark, f"{path}/chunks", CHUNKS).join(pointers(spark, path), ["document_id", "version", "run"], "left_semi")


def errors(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, f"{path}/errors", ERRORS)


def ingest(spark: SparkSession, sources: DataFrame, path: str, run: int, *, sizes: chunking.Sizes = chunking.Sizes(), before_commit: Callable[[], None] | None = None) -> None:
    """Take in new versions as one run (numbers rise). A version that isn't above the visible one is left out."""
    save = lambda df, name: df.withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{name}")
    own = F.col("run") == run
    seen = pointers(spark, path).select("document_id", F.col("version").alias("seen"))
    newest = sources.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.max_by(F.struct("version", "text"), F.struct("version", "text")).alias("s")).select("document_id", F.col("s.version").cast("long").alias("version"), "s.text")
    fresh = newest.join(seen, "document_id", "left").filter("seen IS NULL OR version > seen").drop("seen")
    save(parse(fresh), "parsed")
    parsed = spark.read.schema("document_id bigint, version bigint, error string, body string, run bigint").parquet(f"{path}/parsed").filter(own)
    save(parsed.filter("error IS NOT NULL").select("document_id", "version", F.lit("parse").alias("stage"), "error"), "errors")
    good = parsed.filter("error IS NULL")
    # the version goes along with the id, so that chunks' texts needn't meet it again
    cut = chunking.chunk_rows(good.select(F.struct("document_id", "version").alias("of"), "body"), key="of", text="body", sizes=sizes).select("of.*", "*").drop("of")
    stored = visible(spark, path).select("document_id", "embedding_fingerprint").distinct().withColumn("reused", F.lit(True))
    planned = cut.join(stored, ["document_id", "embedding_fingerprint"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
    save(planned.select("document_id", "version", F.col("chunk_index").cast("int"), "chunk_text", "chunk_hash", "embedding_fingerprint", "token_count", "reused"), "chunks")
    if before_commit is not None:
        before_commit()
    save(good.select("document_id", "version"), "pointers")

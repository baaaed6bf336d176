"""Sources as a prompt shows them, chunks' metadata, file types, failure classes, and probes of a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.screening import FENCE_CLOSE, FENCE_OPEN, defused

# First bytes of files by family, families by suffix, failure classes by error code.
MAGIC = {"pdf": "25504446", "zip": "504B0304"}
FAMILY = {"pdf": "pdf", "docx": "zip", "csv": "text", "md": "text"}
FAILURES = {"TIMEOUT": "TIMEOUT", "RATE_LIMITED": "RATE_LIMITED", "LLM_FAILED": "LLM_ERROR", "SEARCH_FAILED": "RETRIEVAL_UNAVAILABLE"}
#: What a user reads of each failure class; anything else is a failure of the system.
COPY = {"TIMEOUT": "That took too long. Please try again.", "RATE_LIMITED": "Too many requests at once. Please wait a moment.", "LLM_ERROR": "No answer could be written. Please try again.", "RETRIEVAL_UNAVAILABLE": "The documents can't be searched now. Please try again."}
SYSTEM = ("SYSTEM_FAILURE", "Something went wrong. Please try again.")


def source_marker(place: Column) -> Column:
    return F.concat(F.lit("[S"), place.cast("string"), F.lit("]"))


def source_block(place: Column, filename: Column, locator: Column, text: Column, most: int = 1200) -> Column:
    """A source between fences, under its mark, file name and place; its text is defused, and cut at `most` characters."""
    head = F.concat(source_marker(place), F.lit(" filename="), F.coalesce(filename, F.lit("")), F.lit(" locator="), F.coalesce(locator, F.lit("")))
    return F.concat_ws("\n", F.lit(FENCE_OPEN), head, F.substring(defused(text), 1, most), F.lit(FENCE_CLOSE))


def batch_of(place: Column, size: int = 5) -> Column:
    """The scoring batch of a 1-based place, and the 1-based number within it."""
    return F.struct(F.floor((place - 1) / size).alias("batch"), ((place - 1) % size + 1).alias("number"))


def chunk_meta(block_order: Column, block_chunk_index: Column, label: Column, kind: Column, configured: dict[str, str], *, char_start: Column, char_end: Column, text: Column, extraction: Column) -> Column:
    """A chunk's metadata as JSON: its place, its stretch of the block and its own length, how its text was got, and what made it; absent parts are left out."""
    locator = F.struct(kind.alias("kind"), label.alias("label"))
    stretch = [char_start.alias("char_start"), char_end.alias("char_end"), F.length(text).alias("char_count")]
    made = [F.lit(v).alias(k) for k, v in configured.items()]
    return F.to_json(F.struct(locator.alias("locator"), block_order.alias("block_order"), block_chunk_index.alias("block_chunk_index"), *stretch, *made, extraction.alias("extraction")))


def stretch_of(meta: Column) -> Column:
    """struct<char_start, char_end, char_count, extraction> of the metadata; null parts as in place_of."""
    number = lambda name: F.get_json_object(meta, f"$.{name}").try_cast("int").alias(name)
    return F.struct(number("char_start"), number("char_end"), number("char_count"), F.get_json_object(meta, "$.extraction").alias("extraction"))


def place_of(meta: Column) -> Column:
    """struct<block_order, block_chunk_index, label> of the metadata; null parts where it is null, no JSON, or of another type."""
    number = lambda name: F.get_json_object(meta, f"$.{name}").try_cast("int")
    return F.struct(number("block_order").alias("block_order"), number("block_chunk_index").alias("block_chunk_index"), F.get_json_object(meta, "$.locator.label").alias("label"))


def file_type(filename: Column, content: Column) -> Column:
    """The suffix, if it is known and the content agrees: by its first bytes, or for text by having no control bytes and being UTF-8; else null."""
    suffix = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    family = F.coalesce(*[F.when(suffix == s, F.lit(f)) for s, f in FAMILY.items()])
    starts = lambda name: F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(MAGIC[name]))
    plain = ~F.hex(content).rlike("^(..)*(0[0-8EF]|1[0-9A-F])") & F.try_validate_utf8(content.cast("string")).isNotNull() & ~starts("pdf") & ~starts("zip")
    good = F.when(family == "text", plain).when(family == "pdf", starts("pdf")).when(family == "zip", starts("zip"))
    return F.when(good, suffix)


def failure_class(code: Column) -> Column:
    return F.coalesce(*[F.when(code == c, F.lit(name)) for c, name in FAILURES.items()], F.lit(SYSTEM[0]))


def failure_copy(name: Column) -> Column:
    return F.coalesce(*[F.when(name == c, F.lit(text)) for c, text in COPY.items()], F.lit(SYSTEM[1]))


def probes(query: Column, sub_queries: Column, extra: int = 3) -> Column:
    """The question, then its distinct sub-questions, `extra` at most."""
    return F.concat(F.array(query), F.slice(F.array_except(sub_queries, F.array(query)), 1, extra))

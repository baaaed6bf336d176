"""Which documents a reader may see: one place for the predicates that every read shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(searchable: str = "searchable", deleted: str = "deleted") -> Column:
    """Searchable and not deleted; the ingestion status takes no part, and a null flag is false."""
    return F.coalesce(F.col(searchable), F.lit(False)) & ~F.coalesce(F.col(deleted), F.lit(False))


def in_scope(docs: DataFrame, bases: DataFrame, conversation: str | None) -> DataFrame:
    """docs of the knowledge bases that are global or belong to the conversation: a semi join on the base."""
    own = F.lit(False) if conversation is None else F.coalesce(F.col("conversation_id") == conversation, F.lit(False))
    return docs.join(bases.filter((F.col("visibility") == "GLOBAL") | own).select("kb_id"), "kb_id", "left_semi")

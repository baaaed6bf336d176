"""Search with several probes to a question: all probes of all questions are one set of queries for both arms.

A question's probes are its own text and up to a number of rewritten ones. Each arm ranks for every
probe in one scan of the chunks; a probe's arms are fused, then the question's probes are. Those
questions alone whose answer was rejected are asked with other probes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import embedding
from siltstone.operators import retrieval

MOST_SUB, MOST_CHARS, ARM, FUSED, TOP = 3, 600, 50, 50, 30
#: A question's probes are numbered below this.
STEP = 100


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def probes_of(questions: DataFrame, most_sub: int = MOST_SUB, most_chars: int = MOST_CHARS) -> DataFrame:
    """(question_id, probe, text): the question (probe 0) and its rewritten forms of questions (question_id, text, sub_queries).

    Forms are stripped and shortened, blank and repeated ones are left out, and of the rest the first
    most_sub stay. A blank question has no probes.
    """
    if not 0 <= most_sub < STEP:
        raise ValueError(f"a question may have fewer than {STEP} probes")
    own = stripped(F.col("text"))
    forms = F.transform(F.coalesce("sub_queries", F.array().cast("array<string>")), lambda x: stripped(F.left(stripped(x), F.lit(most_chars))))
    texts = F.slice(F.filter(F.array_distinct(F.concat(F.array(own), forms)), lambda x: x != ""), 1, most_sub + 1)
    return questions.filter(own != "").select("question_id", F.posexplode(texts).alias("probe", "text"))


def search(chunks: DataFrame, probes: DataFrame, *, arm: int = ARM, fused: int = FUSED, top: int = TOP) -> DataFrame:
    """(question_id, id, score, best_rank, probes, rank) over chunks (id, text, vector) for probes (question_id, probe, text); texts get trial vectors, equal ones once."""
    asked = probes.withColumn("query_id", F.col("question_id") * STEP + F.col("probe"))
    vectors = embedding.embedded(asked.select("query_id", "text")).select("query_id", "vector")
    dense = retrieval.dense_top_k(chunks, vectors, arm)
    sparse = retrieval.lexical_top_k(chunks, asked.select("query_id", "text"), arm)
    both = retrieval.fuse(dense, sparse, top=fused)
    return retrieval.merge_probes(both.select(F.floor(F.col("query_id") / STEP).alias("question_id"), F.col("query_id").alias("probe"), "id", "rank"), top=top)


def search_twice(chunks: DataFrame, first: DataFrame, rejected: DataFrame, second: DataFrame, **sizes: int) -> DataFrame:
    """search() with `first` probes, and for the rejected questions (question_id) with their `second` ones instead; `attempt` says which. A question's answer depends on its own probes alone, so both passes are one scan."""
    no = rejected.select("question_id").distinct()
    asked = first.join(no, "question_id", "left_anti").unionByName(second.join(no, "question_id", "left_semi"))
    found = search(chunks, asked, **sizes).join(no.withColumn("no", F.lit(2)), "question_id", "left")
    return found.withColumn("attempt", F.coalesce("no", F.lit(1))).drop("no")

"""English full-text search: stemmed terms without stop words, positions, and rank by cover density.

Rank. A cover is a least stretch of a text that satisfies the question. Of its words' positions p..q,
those that hold a term of the question are n; it adds 0.1 / (1 + (q - p) - (n - 1)): one over the
words within it that are no terms, plus one. If any term satisfies the question (as a search box does)
every occurrence is a cover; if all must be there, covers are the stretches that hold each at least once
and no smaller such stretch (Clarke, Cormack and Tudhope, "Relevance ranking for one to three term
queries"). A position counts once, whatever terms it holds.

At scale. The documents' distinct words are stemmed, not their occurrences, and a question's terms become
the words that have them: its forms. Documents then meet blocks of questions as lists of words, in
their own task; no occurrence is a row, and what is shuffled is a text once, to make repeated ids one,
and each task's k best of a question.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.stemming import STOP_WORDS, stems, words_of
from siltstone.operators.retrieval import _by_blocks, count_top_k, top_by

DIGITS = 9


def stemmed(words: DataFrame) -> DataFrame:
    """words (word) with their `stem`.

    Stemming is the work here, not the bytes: rows are spread by number, and explode() keeps the long
    expression from being repeated in filters and keys.
    """
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.repartition(n, "word").select("*", F.explode(stems("array(word)")).alias("stem"))


def questions(asked: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, stem, nth): the distinct stems of each question (query_id, text), numbered from 0 by their first place; `most` takes the first ones."""
    words = asked.select("query_id", F.posexplode(words_of(F.col("text"))).alias("at", "word")).filter(~F.col("word").isin(STOP_WORDS))
    found = stemmed(words).groupBy("query_id", "stem").agg(F.min("at").alias("at"))
    out = found.select("query_id", "stem", (F.row_number().over(Window.partitionBy("query_id").orderBy("at")) - 1).alias("nth"))
    return out if most is None else out.filter(F.col("nth") < most)


def worded(docs: DataFrame) -> DataFrame:
    """(id, terms): the words of each document (id, text), in order. Equal texts of an id are one, others follow each other."""
    one = docs.filter("id IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_set("text")).alias("texts"))
    return one.select("id", F.flatten(F.transform("texts", words_of)).alias("terms"))


def forms(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, stem, word): for each stem of questions() the words of docs (id, text) that have it."""
    vocabulary = docs.filter("id IS NOT NULL").select(F.explode(words_of(F.col("text"))).alias("word")).distinct().filter(~F.col("word").isin(STOP_WORDS))
    known = stemmed(vocabulary).join(asked.select("stem").distinct(), "stem", "left_semi")
    return known.join(asked.select("query_id", "stem"), "stem").select("query_id", "stem", "word")


def stem_counts(docs: DataFrame) -> DataFrame:
    """(stem, forms, occurrences, documents): of each stem of docs (id, text) the words that have it, how often they occur, and in how many documents. Repeated ids are one document, null ones none.

    Occurrences are counted by word before any shuffle, and each word is stemmed once. Documents meet the
    stems as their distinct words, and are dealt by stem and id: no task holds the documents of a stem.
    """
    n, stops = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.array(*map(F.lit, STOP_WORDS))
    known = stemmed(docs.select(F.explode(words_of(F.col("text"))).alias("word")).filter(~F.col("word").isin(STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n")))
    own = Window.partitionBy("stem")
    known = known.select("word", "stem", F.count("*").over(own).alias("forms"), F.sum("n").over(own).alias("occurrences"))
    held = docs.select("id", F.explode(F.array_except(words_of(F.col("text")), stops)).alias("word"))
    pairs = held.join(known, "word").select("stem", "forms", "occurrences", "id").repartition(n, "stem", "id").distinct()
    return pairs.groupBy("stem", "forms", "occurrences").agg(F.count("id").alias("documents"))


def _covers(place: np.ndarray, stem: np.ndarray, terms: np.ndarray) -> tuple[int, float]:
    """How many covers occurrences of a question's terms have, in the order of their places, and their density."""
    at = np.arange(len(place))
    # the last occurrence of each term up to each one; the earliest of these begins the stretch that ends there
    begin = np.min([np.maximum.accumulate(np.where(stem == t, at, -1)) for t in terms], axis=0)
    end = np.flatnonzero(begin > np.concatenate([[-1], np.maximum.accumulate(begin)[:-1]]))
    begin = begin[end]
    return len(end), float((0.1 / (1 + (place[end] - place[begin]) - (end - begin))).sum())


def _whole_matches(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, covers, score) of documents (id, terms) that hold all terms of a question (query_id, terms: its forms as structs of word and stem)."""

    def prepare(block: pa.RecordBatch) -> tuple:
        queries, lists = block.column("query_id").to_numpy(zero_copy_only=False), block.column("terms")
        of = np.repeat(np.arange(len(queries)), np.diff(lists.offsets.to_numpy()))
        word, stem = (pc.struct_field(lists.flatten(), name) for name in ("word", "stem"))
        known, stems = word.unique(), stem.unique()
        number = pc.index_in(stem, stems).to_numpy()
        stem_of = np.zeros(len(known), np.int64)
        stem_of[pc.index_in(word, known).to_numpy()] = number
        wanted = np.zeros((len(stems), len(queries)), np.float32)
        wanted[number, of] = 1
        return queries, known, stem_of, wanted

    def search(rows: pa.RecordBatch, queries: np.ndarray, known: pa.Array, stem_of: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
        ids, own, n = rows.column("id").to_numpy(zero_copy_only=False), rows.column("terms"), rows.num_rows
        found = pc.index_in(own.flatten(), known)
        at = np.flatnonzero(np.asarray(found.is_valid()))
        of = np.repeat(np.arange(n), np.diff(own.offsets.to_numpy()))[at]
        stem = stem_of[found.drop_null().to_numpy()]
        held = np.zeros((n, len(wanted)), np.float32)
        held[of, stem] = 1
        doc, q = np.nonzero(held @ wanted == wanted.sum(axis=0))
        first = np.searchsorted(of, np.arange(n + 1))
        rows_out = []
        for d, j in zip(doc.tolist(), q.tolist()):
            mine = slice(first[d], first[d + 1])
            some = np.flatnonzero(wanted[stem[mine], j])
            rows_out.append(_covers(at[mine][some], stem[mine][some], np.flatnonzero(wanted[:, j])))
        covers, score = np.array([r[0] for r in rows_out], np.int64), np.round(np.array([r[1] for r in rows_out], np.float64), DIGITS)
        return pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(ids[doc]), pa.array(covers), pa.array(score)], ["query_id", "id", "covers", "score"])

    return _by_blocks(docs.filter("size(terms) > 0"), asked, prepare, search, "query_id bigint, id bigint, covers bigint, score double")


def top_k(docs: DataFrame, asked: DataFrame, k: int, *, every: bool = False) -> DataFrame:
    """(query_id, id, covers, score, rank): the k documents of highest rank of each question; ties by id.

    asked: of questions(). every: all of a question's terms must be there. Repeated ids are one document.
    """
    found = forms(docs, asked)
    if not every:
        counted = count_top_k(worded(docs), found.groupBy("query_id").agg(F.collect_set("word").alias("terms")), k)
        return counted.select("query_id", "id", F.col("score").alias("covers"), F.round(F.col("score") * 0.1, DIGITS).alias("score"), "rank")
    # a question of which a term has no form at all has no document
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("all"))
    whole = found.groupBy("query_id").agg(F.collect_set(F.struct("word", "stem")).alias("terms"), F.count_distinct("stem").alias("some"))
    whole = whole.join(sizes, "query_id").filter(F.col("all") == F.col("some")).select("query_id", "terms")
    return top_by(_whole_matches(worded(docs), whole), "query_id", [F.desc("score"), "id"], k)

r"""Citation marks of answers: [S1] names the first source given to the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = r"\[S(\d+)\]"


def _numbers(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(MARK), 1), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def cited(answer: Column, sources: Column) -> Column:
    """The distinct source ids that the answer cites, in the order of their first citation."""
    known = F.filter(_numbers(answer), lambda n: (n >= 1) & (n <= F.size(sources)))
    return F.array_distinct(F.transform(known, lambda n: sources[n - 1]))


def dropped(answer: Column, sources: Column) -> Column:
    """How many marks name no source."""
    return F.size(F.filter(_numbers(answer), lambda n: (n < 1) | (n > F.size(sources))))


def _canonical(answer: Column, sources: Column) -> Column:
    """The answer with every mark that names no source as [S0], others without leading zeros; pieces and marks meet by one zip, so a long answer is gone through once."""
    of = F.arrays_zip(F.split(F.coalesce(answer, F.lit("")), MARK, -1).alias("piece"), _numbers(answer).alias("n"))
    number = lambda n: F.when((n >= 1) & (n <= F.size(sources)), n).otherwise(0).cast("string")
    return F.array_join(F.transform(of, lambda z: F.concat(z["piece"], F.when(z["n"].isNull(), F.lit("")).otherwise(F.concat(F.lit("[S"), number(z["n"]), F.lit("]"))))), "")


def segments(answer: Column, sources: Column) -> Column:
    """array<struct<text, id>>: runs of text (id null) and citation marks; marks without a source are cut out, with the space that they double."""
    body = _canonical(answer, sources)
    # cut at known marks first: what is left when an unknown one goes may look like a mark, and is text
    runs, marks = F.split(body, r"\[S[1-9]\d*\]", -1), F.regexp_extract_all(body, F.lit(r"\[S([1-9]\d*)\]"), 1)
    plain = lambda run: F.replace(F.regexp_replace(run, r" (?:(?:\[S0\])+ )+", " "), F.lit("[S0]"), F.lit(""))
    pairs = F.arrays_zip(F.transform(runs, plain).alias("run"), marks.alias("n"))
    piece = lambda z: F.struct(z["run"].alias("text"), F.lit(None).cast("string").alias("id"))
    mark = lambda z: F.struct(F.concat(F.lit("[S"), z["n"], F.lit("]")).alias("text"), F.get(sources, z["n"].cast("int") - 1).cast("string").alias("id"))
    both = lambda z: F.filter(F.array(F.when(z["run"] != "", piece(z)), F.when(z["n"].isNotNull(), mark(z))), lambda x: x.isNotNull())
    return F.flatten(F.transform(pairs, both))


def envelopes(answers: DataFrame, hits: DataFrame, *, key: str = "id") -> DataFrame:
    """(key, segments, dropped) of answers (key, answer, sources array<string>, scores array<double>), with what hits say of each source.

    hits: (chunk_id string, doc, page, locator, quote), what the reader may see, one row a chunk. A citation
    of a source that isn't among them goes like a mark without a source, and is counted in dropped. Scores
    count if there is one for each source; of a source that is named twice the last one does. Only sources
    that are cited meet hits, and a source's text is carried once an answer, not once a mark. An answer
    without any segment left is one empty run of text.
    """
    asked = answers.select(key, F.explode(cited(F.col("answer"), F.col("sources"))).alias("chunk_id"))
    seen = asked.join(hits.select("chunk_id", "doc", "page", "locator", "quote"), "chunk_id")
    found = seen.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", F.struct("doc", "page", "locator", "quote")))).alias("__hits"))
    none = F.create_map().cast(found.schema["__hits"].dataType)
    met = answers.join(found, key, "left").withColumn("__hits", F.coalesce("__hits", none))
    # an unknown source is null, so that its marks are marks without a source; positions stay
    aligned = F.size("scores") == F.size("sources")
    score = F.map_from_arrays(F.array_distinct("sources"), F.transform(F.array_distinct("sources"), lambda s: F.element_at(F.filter(F.arrays_zip("sources", "scores"), lambda z: z["sources"] == s), -1)["scores"]))
    met = met.withColumn("__score", F.when(F.coalesce(aligned & (F.size("sources") > 0), F.lit(False)), score))
    kept = F.transform("sources", lambda s: F.when(F.map_contains_key("__hits", s), s))
    cut = met.withColumn("__cut", segments(_without(F.col("answer"), kept), F.col("sources")))

    def segment(x: Column) -> Column:
        hit = F.try_element_at("__hits", x["id"])
        text = F.when(x["id"].isNull(), x["text"]).alias("text")
        return F.struct(text, x["id"].isNotNull().alias("is_cite"), hit["doc"].alias("doc"), hit["page"].alias("page"), hit["locator"].alias("locator"), hit["quote"].alias("quote"), x["id"].alias("chunk_id"), F.try_element_at("__score", x["id"]).alias("score"))

    blank = F.array(F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("id")))
    filled = F.when(F.size("__cut") > 0, F.col("__cut")).otherwise(blank)
    lost = F.size(F.filter(_numbers(F.col("answer")), lambda n: F.coalesce((n >= 1) & (n <= F.size("sources")) & ~F.map_contains_key("__hits", F.get("sources", n - 1)), F.lit(False))))
    return cut.select(key, F.transform(filled, segment).alias("segments"), lost.alias("dropped"))


def _without(answer: Column, kept: Column) -> Column:
    """The answer with marks of sources that are null in kept as [S0]."""
    of = F.arrays_zip(F.split(F.coalesce(answer, F.lit("")), MARK, -1).alias("piece"), _numbers(answer).alias("n"))
    known = lambda n: (n >= 1) & F.get(kept, n - 1).isNotNull()
    return F.array_join(F.transform(of, lambda z: F.concat(z["piece"], F.when(z["n"].isNull(), F.lit("")).when(known(z["n"]), F.concat(F.lit("[S"), z["n"].cast("string"), F.lit("]"))).otherwise(F.lit("[S0]")))), "")


def envelope_json(segments: Column, sources: Column) -> Column:
    """The envelope as it is stored: {"segments": [...], "source_ids": [...]}; a citation without a score has no such key, other missing values are null."""
    options = {"ignoreNullFields": "false"}
    own = lambda x: [F.lit(True).alias("isCite"), x["doc"].alias("doc"), x["page"].alias("page"), x["locator"].alias("locator"), x["quote"].alias("quote"), x["chunk_id"].alias("chunkId")]
    cite = lambda x: F.when(x["score"].isNull(), F.to_json(F.struct(*own(x)), options)).otherwise(F.to_json(F.struct(*own(x), x["score"].alias("score")), options))
    each = F.transform(segments, lambda x: F.when(x["is_cite"], cite(x)).otherwise(F.to_json(F.struct(x["text"].alias("text")))))
    return F.concat(F.lit('{"segments":['), F.array_join(each, ","), F.lit('],"source_ids":'), F.to_json(sources), F.lit("}"))


def probe(answer: Column, least: int = 40, most: int = 400) -> Column:
    """The answer without marks as a search text: its first `most` characters, null if under `least`."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), MARK, ""), r"\s+", " "))
    return F.when(F.length(plain) >= least, F.substring(plain, 1, most))

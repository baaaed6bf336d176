"""What models return and what is shown of it: scores, probes, routes, citations as JSON, and small display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The strategy of each class of question, and failure classes by error code with their texts.
STRATEGY = {"simple": "hybrid", "multi_part": "decompose", "vague": "hyde", "conversational": "hybrid"}
BADGES = {"pdf": "PDF", "docx": "DOCX", "csv": "CSV", "md": "MD"}
UNITS = ("B", "KB", "MB", "GB")
BACKOFF_BASE, BACKOFF_MOST, MOST_TRIES = 10.0, 600.0, 5
NO_GROUND = "I can't ground an answer to that from the documents supplied."


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def parse_scores(payload: Column, count: Column, scale: float = 10.0) -> Column:
    """array<struct<id, score>> of {"scores": [{"id", "score"}]}: whole ids in 1..count, the first of each, scores that are numbers, clamped to 0..scale.

    Anything else, from a payload that isn't JSON to true as a number, is left out.
    """
    items = F.try_variant_get(F.try_parse_json(payload), "$.scores", "array<variant>")
    part = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    number = lambda v: _kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$")
    good = F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.coalesce((_kind(part(x, "id")) == "BIGINT") & number(part(x, "score")), F.lit(False)))
    pair = lambda x: F.struct(F.try_variant_get(x, "$.id", "bigint").alias("id"), F.try_variant_get(x, "$.score", "double").alias("score"))
    pairs = F.filter(F.transform(good, pair), lambda x: (x["id"] >= 1) & (x["id"] <= count))
    first = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["id"]), x["id"]) == i + 1)
    return F.transform(first, lambda x: F.struct(x["id"].alias("id"), F.least(F.greatest(x["score"], F.lit(0.0)), F.lit(scale)).alias("score")))


def order_by_scores(count: Column, scores: Column) -> Column:
    """Positions 1..count: scored ones first, by falling score, then by position."""
    of = lambda i: F.filter(scores, lambda s: s["id"] == i)
    row = F.transform(F.sequence(F.lit(1).cast("long"), count), lambda i: F.struct((F.size(of(i)) == 0).alias("unscored"), (-F.coalesce(F.get(of(i), 0)["score"], F.lit(0.0))).alias("falling"), i.alias("position")))
    return F.transform(F.sort_array(row), lambda r: r["position"])


def realigned(previous: Column, surviving: Column, scores: Column) -> Column:
    """The scores of the ids that survive, in their order; empty if lengths differ or an id is unknown."""
    at = lambda x: F.array_position(previous, x).cast("int")
    known = F.forall(surviving, lambda x: at(x) > 0)
    return F.when((F.size(previous) == F.size(scores)) & known, F.transform(surviving, lambda x: F.get(scores, at(x) - 1))).otherwise(F.array().cast("array<double>"))


def cleaned_probes(raw: Column, query: Column, most: int = 3, chars: int = 400) -> Column:
    """The first few distinct probes that say something else than the query, whatever their case and spacing; long ones are cut."""
    key = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    cut = F.transform(F.filter(raw, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), lambda x: F.rtrim(F.substring(F.trim(x), 1, chars)))
    keys = F.transform(cut, key)
    new = F.filter(cut, lambda x, i: (F.array_position(keys, F.get(keys, i)) == i + 1) & (F.get(keys, i) != key(query)))
    return F.slice(new, 1, most)


def offline_route(query: Column) -> Column:
    """struct<query_class, strategy, probes> without a model: several questions, halves around `and`, few words, or simple."""
    filled = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    questions = filled(F.split(F.replace(query, F.lit("?"), F.lit("?\n")), "\n"))
    halves = filled(F.split(query, " and "))
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    say = lambda name, probes: F.struct(F.lit(name).alias("query_class"), F.lit(STRATEGY[name]).alias("strategy"), F.slice(probes, 1, 3).alias("probes"))
    none = F.array().cast("array<string>")
    return F.when(F.size(questions) > 1, say("multi_part", questions)).when(F.contains(F.lower(query), F.lit(" and ")), say("multi_part", halves)).when(words <= 3, say("vague", F.array(F.concat(query, F.lit(" details"))))).otherwise(say("simple", none))


def cited_json(envelope: Column) -> Column:
    """array<struct<chunkId, doc>> of an envelope's citation segments, in order; empty where it can't be read."""
    rows = F.from_json(envelope, "segments array<struct<chunkId:string,doc:string,text:string>>")["segments"]
    return F.transform(F.filter(F.coalesce(rows, F.array().cast("array<struct<chunkId:string,doc:string,text:string>>")), lambda x: F.coalesce(x["chunkId"] != "", F.lit(False))), lambda x: F.struct(x["chunkId"].alias("chunkId"), x["doc"].alias("doc")))


def source_line(cites: Column) -> Column:
    """`grounded in N passages · docs`; null without citations."""
    docs = F.array_distinct(F.transform(cites, lambda x: x["doc"]))
    n = F.size(cites)
    return F.when(n > 0, F.concat(F.lit("grounded in "), n.cast("string"), F.when(n == 1, F.lit(" passage")).otherwise(F.lit(" passages")), F.lit(" · "), F.array_join(docs, " · ")))


def duration(seconds: Column) -> Column:
    """mm:ss; minutes go beyond 59, below zero is zero."""
    total = F.greatest(F.floor(seconds), F.lit(0))
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat(two(F.floor(total / 60)), F.lit(":"), two(total % 60))


def badge(filename: Column) -> Column:
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    return F.coalesce(*[F.when(extension == e, F.lit(name)) for e, name in BADGES.items()], F.lit("DOC"))


def file_size(size: Column) -> Column:
    """Bytes whole, larger units to one place."""
    n = size.cast("double")
    scaled = lambda k: F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {UNITS[k]}"))
    text = F.when(n < 1024, F.concat(F.round(n).cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1)).when(n < 1024**3, scaled(2)).otherwise(scaled(3))
    return F.when(n >= 0, text)


def retry_window(attempt: Column) -> Column:
    """The longest wait before another attempt: doubled each time, capped; the wait itself is drawn between the base and it."""
    return F.least(BACKOFF_BASE * F.pow(F.lit(2.0), attempt - 1), F.lit(BACKOFF_MOST))


def final_attempt(attempt: Column) -> Column:
    return attempt >= MOST_TRIES


def evaluation_key(message_id: Column, content: Column, nonce: Column) -> Column:
    """eval:{id}:{first twelve digits of the content's hash}, and the nonce of a deliberate second run."""
    key = F.concat(F.lit("eval:"), message_id.cast("string"), F.lit(":"), F.substring(F.sha2(content, 256), 1, 12))
    return F.when(F.coalesce(nonce != "", F.lit(False)), F.concat(key, F.lit(":"), nonce)).otherwise(key)


def mentioned(text: Column, documents: Column) -> Column:
    """Ids of the documents (array<struct<id, name>>) that a text names as @name, in the documents' order.

    Longer names are looked for first, and what they claim is blanked for shorter ones.
    """
    # by falling length, and in the given order among equals
    placed = F.transform(documents, lambda d, i: F.struct((-F.length(d["name"])).alias("n"), i.alias("i"), d["id"].alias("id"), F.concat(F.lit("@"), d["name"]).alias("token")))
    start = F.struct(text.alias("rest"), F.array().cast("array<bigint>").alias("found"))

    def step(a: Column, d: Column) -> Column:
        at = F.position(d["token"], a["rest"])
        n = F.length(d["token"])
        blank = F.concat(F.substring(a["rest"], F.lit(1), at - 1), F.repeat(F.lit(" "), n), F.substring(a["rest"], at + n, F.length(a["rest"])))
        return F.when(at > 0, F.struct(blank.alias("rest"), F.concat(a["found"], F.array(d["id"])).alias("found"))).otherwise(a)

    found = F.aggregate(F.sort_array(placed), start, step, lambda a: a["found"])
    return F.filter(F.transform(documents, lambda d: d["id"]), lambda i: F.array_contains(found, i))


def scripted_answer(context: Column, question: Column) -> Column:
    """An answer without a model, for trials: cites the context's three lowest source marks, or says that it can't be grounded."""
    marks = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(context, F.lit(r"\[S(\d+)\]"), 1), lambda x: x.cast("int"))))
    cited = F.array_join(F.transform(F.slice(marks, 1, 3), lambda n: F.concat(F.lit(" Supported by source [S"), n.cast("string"), F.lit("]."))), "")
    answer = F.concat(F.trim(F.concat(F.lit("Grounded answer to: "), F.coalesce(question, F.lit("")))), cited)
    return F.when(F.size(marks) > 0, answer).otherwise(F.lit(NO_GROUND))

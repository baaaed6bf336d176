"""Messages, their telemetry and evaluation: records, histories, reports over what users rated, and pruning of checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.documents import _changed

METRICS = ("relevancy", "faithfulness", "groundedness")
THRESHOLDS = tuple(k / 10 for k in range(1, 11))


# ---- records ------------------------------------------------------------------------------------


def telemetry_rows(turns: DataFrame) -> DataFrame:
    """turns with an outcome: error where only an error code is known, unknown where nothing is."""
    return turns.withColumn("outcome", F.coalesce("outcome", F.when(F.col("error_code").isNotNull(), "error").otherwise("unknown")))


def count_since(rows: DataFrame, since: int, outcome: str | None = None) -> DataFrame:
    hit = (F.col("created_at") >= since) & (F.lit(True) if outcome is None else F.col("outcome") == outcome)
    return rows.agg(F.count_if(hit).alias("n"))


def persisted(turns: DataFrame) -> DataFrame:
    """Turns that become messages: answered and abstained ones, and blocked ones if it was the screen that blocked them."""
    blocked = (F.col("outcome") == "blocked") & (F.col("verdict") == "blocked")
    return turns.filter(F.coalesce(F.col("outcome").isin("answered", "abstained") | blocked, F.lit(False)))


def save_answers(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """messages with answers (id, conversation_id, seq, content, citations, created_at) added, or, where the id is known, put in place of its text and citations.

    A replaced answer has no feedback and no evaluation any more.
    """
    new = answers.select("id", F.struct("content", "citations").alias("__new"))
    met, hit, none = messages.join(new, "id", "left"), F.col("__new").isNotNull(), F.lit(None).cast("string")
    kept = _changed(met, hit, content=F.col("__new.content"), citations=F.col("__new.citations"), feedback=none, evaluation=none).select(messages.columns)
    added = answers.join(messages.select("id"), "id", "left_anti").withColumn("role", F.lit("AI"))
    return kept.unionByName(added, allowMissingColumns=True)


def set_feedback(messages: DataFrame, given: DataFrame) -> DataFrame:
    """messages with feedback (id, feedback) set or, where it is null, taken back."""
    new = given.select("id", F.struct("feedback").alias("__new"))
    return _changed(messages.join(new, "id", "left"), F.col("__new").isNotNull(), feedback=F.col("__new.feedback")).select(messages.columns)


# ---- histories ----------------------------------------------------------------------------------


def prompt_history(messages: DataFrame, turns: int = 4, most: int = 600) -> DataFrame:
    """(conversation_id, seq, role, content): the newest turns of each conversation, as a prompt takes them.

    Blank ones are left out, and of long ones the end is kept. Roles: user and assistant.
    """
    from siltstone.functions.text import history_tail

    role = F.when(F.col("role") == "USER", "user").when(F.col("role") == "AI", "assistant")
    newest = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("seq")))
    tail = messages.withColumn("__n", newest).filter(F.col("__n") <= turns)
    return tail.select("conversation_id", "seq", role.alias("role"), history_tail(F.col("content"), most).alias("content")).filter("role IS NOT NULL AND content IS NOT NULL")


def regenerable(messages: DataFrame) -> DataFrame:
    """(conversation_id, answer_id, question_id, turn_index): each conversation's last message if it is an answer with a question before it; the turn is the number of questions up to there."""
    is_user = F.col("role") == "USER"
    last = messages.groupBy("conversation_id").agg(
        F.max_by(F.struct("id", "role"), F.col("seq")).alias("last"),
        F.max_by(F.when(is_user, F.col("id")), F.when(is_user, F.col("seq"))).alias("question_id"),
        F.count_if(is_user).alias("turn_index"),
    )
    return last.filter("last.role = 'AI' AND question_id IS NOT NULL").select("conversation_id", F.col("last.id").alias("answer_id"), "question_id", "turn_index")


def context_budget(messages: DataFrame, query: Column, window: int = 10_400, reserve: int = 1_500) -> DataFrame:
    """(conversation_id, used, projected, allowed, percent): used tokens, with a further query and the answer's reserve; exactly the window is allowed."""
    tokens = lambda text: F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4.0)
    used = messages.groupBy("conversation_id").agg(F.sum(tokens(F.col("content"))).alias("used"))
    projected = F.col("used") + tokens(query) + reserve
    return used.select("conversation_id", "used", projected.alias("projected"), (projected <= window).alias("allowed"), F.least(F.round(100.0 * F.col("used") / window, 1), F.lit(100.0)).alias("percent"))


def evaluation_skips(messages: DataFrame, chats: DataFrame, known_chunks: DataFrame, cites: Column) -> DataFrame:
    """(id, skip): why a message isn't evaluated, the first rule that applies; null: it is.

    cites: the chunk ids that it cites; known_chunks: (chunk_id) that can still be read.
    """
    ask = Window.partitionBy("conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    question = F.last(F.when(F.col("role") == "USER", F.col("content")), ignorenulls=True).over(ask)
    rows = messages.select("id", "conversation_id", "role", "evaluation", cites.alias("cites"), question.alias("question"))
    chat = chats.select(F.col("id").alias("conversation_id")).distinct().withColumn("__chat", F.lit(True))
    readable = rows.select("id", F.explode("cites").alias("chunk_id")).join(known_chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select("id").distinct().withColumn("__context", F.lit(True))
    met = rows.join(chat, "conversation_id", "left").join(readable, "id", "left")
    rules = [("not_ai_message", F.col("role") != "AI"), ("already_evaluated", F.col("evaluation").isNotNull()), ("no_citations", F.size("cites") == 0), ("not_found", F.col("__chat").isNull()), ("no_question", F.coalesce(F.trim("question") == "", F.lit(True))), ("context_unavailable", F.col("__context").isNull())]
    return met.select("id", F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in rules]).alias("skip"))


# ---- statistics of a conversation ---------------------------------------------------------------


def session_statistics(messages: DataFrame, cites: Column, metrics: tuple[str, ...] = METRICS[:2]) -> DataFrame:
    """Each conversation's metric averages (absent ones left out), overall mean of those present, its band by the rounded value, and the latest model's name."""
    from siltstone.functions.text import score_band

    value = lambda m: F.get_json_object("evaluation", f"$.{m}").cast("double")
    named = F.col("model_name") != ""
    out = messages.groupBy("conversation_id").agg(*[F.avg(value(m)).alias(m) for m in metrics], F.max_by(F.when(named, F.col("model_name")), F.when(named, F.col("seq"))).alias("model_name"))
    present = F.array_compact(F.array(*metrics))
    overall = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    out = out.withColumn("overall", F.round(overall, 2))
    return out.select("conversation_id", *[F.round(m, 2).alias(m) for m in metrics], "overall", F.when(F.col("overall").isNotNull(), score_band(F.col("overall"))).alias("band"), "model_name")


def sources_referenced(messages: DataFrame, cites: Column) -> DataFrame:
    """(conversation_id, doc, passages, place): how often each document is cited, in the order of first citations; cites: array<struct<chunkId, doc>>."""
    rows = messages.select("conversation_id", "seq", F.posexplode(cites).alias("at", "cite"))
    counted = rows.groupBy("conversation_id", F.col("cite.doc").alias("doc")).agg(F.count(F.lit(1)).alias("passages"), F.min(F.struct("seq", "at")).alias("first"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("conversation_id").orderBy("first"))).drop("first")


# ---- what users' ratings say ---------------------------------------------------------------------


def rated_turns(messages: DataFrame, telemetry: DataFrame, since: int, chats: DataFrame | None = None) -> DataFrame:
    """Answers with feedback since a time, with the scores on record; turns without telemetry stay. chats: those of one owner."""
    answers = messages.filter((F.col("role") == "AI") & F.col("feedback").isNotNull() & (F.col("created_at") >= since))
    if chats is not None:
        answers = answers.join(chats.select(F.col("id").alias("conversation_id")).distinct(), "conversation_id", "left_semi")
    number = lambda name: F.get_json_object("evaluation", f"$.{name}").try_cast("double").alias(name)
    count = F.coalesce(F.size(F.from_json("citations", "segments array<string>")["segments"]), F.lit(0))
    rows = answers.select(F.col("id").alias("message_id"), (F.col("feedback") == "UP").alias("liked"), number("relevancy"), number("faithfulness"), count.alias("citation_count"), "model_name")
    return rows.join(telemetry.select("message_id", "outcome", "groundedness"), "message_id", "left")


def by_metric(rated: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, liked, value): the scores that are there."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return rated.select("liked", F.inline(pairs)).filter("value IS NOT NULL")


def separation(rated: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """How far each metric's medians of liked and disliked answers lie apart."""
    liked, value = F.col("liked"), F.col("value")
    out = by_metric(rated, metrics).groupBy("metric").agg(F.count_if(liked).alias("liked_n"), F.count_if(~liked).alias("disliked_n"), F.median(F.when(liked, value)).alias("liked_median"), F.median(F.when(~liked, value)).alias("disliked_median"))
    return out.withColumn("gap", F.round(F.col("liked_median") - F.col("disliked_median"), 6))


def threshold_sweep(rated: DataFrame, metrics: tuple[str, ...] = METRICS, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """For each metric and threshold the answers that withholding below it would have caught, missed, held back wrongly and passed, with precision and recall (null over nothing).

    One pass with conditional counts; no row is multiplied by the thresholds.
    """
    liked, value = F.col("liked"), F.col("value")
    below = [F.struct(F.lit(t).alias("threshold"), F.count_if(~liked & (value < t)).alias("caught"), F.count_if(~liked & (value >= t)).alias("missed"), F.count_if(liked & (value < t)).alias("false_alarms"), F.count_if(liked & (value >= t)).alias("passed")) for t in thresholds]
    rows = by_metric(rated, metrics).groupBy("metric").agg(F.array(*below).alias("rows")).select("metric", F.inline("rows"))
    share = lambda other: F.round(F.try_divide("caught", F.col("caught") + F.col(other)), 6)
    return rows.withColumns({"precision": share("false_alarms"), "recall": share("missed")})


def calibration_report(rated: DataFrame, answers: int, least: int = 20) -> DataFrame:
    """One row: rated, liked and disliked answers, their share of all, medians of citations, and whether there is enough to conclude from."""
    liked = F.col("liked")
    out = rated.agg(F.count(F.lit(1)).alias("rated"), F.count_if(liked).alias("liked"), F.count_if(~liked).alias("disliked"), F.median(F.when(liked, F.col("citation_count"))).alias("liked_citations"), F.median(F.when(~liked, F.col("citation_count"))).alias("disliked_citations"))
    enough = (F.col("rated") >= least) & (F.col("liked") > 0) & (F.col("disliked") > 0)
    return out.select("rated", "liked", "disliked", F.round(F.try_divide(F.col("rated"), F.lit(answers)), 6).alias("coverage"), enough.alias("conclusive"), F.when(enough, F.col("liked_citations")).alias("liked_citations"), F.when(enough, F.col("disliked_citations")).alias("disliked_citations"))


def outcome_mix(rated: DataFrame) -> DataFrame:
    return rated.groupBy("liked", F.coalesce("outcome", F.lit("unrecorded")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# ---- checkpoints --------------------------------------------------------------------------------

THREAD = ("thread_id", "checkpoint_ns")


def prune_checkpoints(checkpoints: DataFrame, keep: int, before: Column) -> DataFrame:
    """Those that stay: the newest `keep` of each thread and namespace, and all that aren't older than `before`."""
    n = F.row_number().over(Window.partitionBy(*THREAD).orderBy(F.desc("checkpoint_id")))
    return checkpoints.withColumn("__n", n).filter((F.col("__n") <= keep) | ~F.coalesce(F.col("ts") < before, F.lit(False))).drop("__n")


def prune_writes(writes: DataFrame, kept: DataFrame) -> DataFrame:
    """Writes whose checkpoint stays."""
    return writes.join(kept.select(*THREAD, "checkpoint_id"), [*THREAD, "checkpoint_id"], "left_semi")


def prune_blobs(blobs: DataFrame, kept: DataFrame) -> DataFrame:
    """Blobs of a (channel, version) that any kept checkpoint of their thread still names."""
    versions = F.from_json(F.get_json_object("checkpoint", "$.channel_versions"), "map<string,string>")
    named = kept.select(*THREAD, F.explode(versions).alias("channel", "version")).distinct()
    return blobs.join(named, [*THREAD, "channel", "version"], "left_semi")

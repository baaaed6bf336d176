"""Queries over the application's messages, telemetry and checkpoints, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import answers as an
from siltstone.functions import groundedness as gr
from siltstone.operators import turns as tn
from siltstone.plans.app import app, app_sql
from siltstone.plans.tables import table

SINCE = 500


def telemetry_outcomes(spark, sf_dir) -> DataFrame:
    rows = tn.telemetry_rows(app(spark, sf_dir, "telemetry").filter("role = 'assistant'"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def telemetry_counts(spark, sf_dir) -> DataFrame:
    rows = tn.telemetry_rows(app(spark, sf_dir, "telemetry"))
    return tn.count_since(rows, SINCE).select(F.lit("all").alias("what"), "n").unionByName(tn.count_since(rows, SINCE, "error").select(F.lit("error").alias("what"), "n"))


def persisted_turns(spark, sf_dir) -> DataFrame:
    rows = app(spark, sf_dir, "telemetry").select("message_id", F.when(F.col("conversation_id") % 4 == 0, "blocked").otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("conversation_id") % 8 == 0, "blocked").otherwise("clean").alias("verdict"))
    return tn.persisted(rows).select("message_id", "outcome")


def saved_answers(spark, sf_dir) -> DataFrame:
    """Every fourth conversation's answers are written anew, every fifth one gets a further answer, and some thumbs are taken back."""
    messages = app(spark, sf_dir, "messages")
    redone = messages.filter("role = 'AI' AND conversation_id % 4 = 0").select("id", "conversation_id", "seq", F.lit("anew").alias("content"), F.lit("{}").alias("citations"), "created_at")
    more = messages.filter("seq = 0 AND conversation_id % 5 = 0").select((F.col("id") + 900).alias("id"), "conversation_id", F.lit(900).cast("long").alias("seq"), F.lit("more").alias("content"), F.lit(None).cast("string").alias("citations"), "created_at")
    saved = tn.save_answers(messages, redone.unionByName(more))
    given = saved.filter("role = 'AI' AND conversation_id % 3 = 0").select("id", F.when(F.col("seq") % 2 == 0, "UP").alias("feedback"))
    return tn.set_feedback(saved, given).select("id", "role", F.sha2("content", 256).alias("content"), "citations", "feedback", "evaluation")


def prompt_history(spark, sf_dir) -> DataFrame:
    return tn.prompt_history(app(spark, sf_dir, "messages"), 4, 60)


def regenerable_answers(spark, sf_dir) -> DataFrame:
    return tn.regenerable(app(spark, sf_dir, "messages"))


def context_budget(spark, sf_dir) -> DataFrame:
    return tn.context_budget(app(spark, sf_dir, "messages"), F.lit("how long may a question be"), 1_700)


def evaluation_skips(spark, sf_dir) -> DataFrame:
    """Messages' reasons; conversations divisible by 7 are gone, and chunks c3 and c4 can't be read."""
    messages, chats = app(spark, sf_dir, "messages"), app(spark, sf_dir, "chats").filter("id % 7 <> 0")
    messages = messages.withColumn("evaluation", F.when(F.col("conversation_id") % 2 == 0, F.col("evaluation")))
    known = spark.createDataFrame([("c0",), ("c1",), ("c2",)], "chunk_id string")
    cites = F.array_distinct(F.transform(an.cited_json(F.col("citations")), lambda x: x["chunkId"]))
    return tn.evaluation_skips(messages, chats, known, cites)


def session_statistics(spark, sf_dir) -> DataFrame:
    rows = app(spark, sf_dir, "messages").filter("role = 'AI'")
    return tn.session_statistics(rows, an.cited_json(F.col("citations")))


def sources_referenced(spark, sf_dir) -> DataFrame:
    return tn.sources_referenced(app(spark, sf_dir, "messages"), an.cited_json(F.col("citations")))


def _rated(spark, sf_dir) -> DataFrame:
    rows = tn.rated_turns(app(spark, sf_dir, "messages"), tn.telemetry_rows(app(spark, sf_dir, "telemetry")).filter("conversation_id % 5 <> 0"), SINCE)
    return rows.withColumns({"relevancy": F.col("relevancy") / 10, "faithfulness": F.col("faithfulness") / 10})


def rating_separation(spark, sf_dir) -> DataFrame:
    return tn.separation(_rated(spark, sf_dir))


def rating_sweep(spark, sf_dir) -> DataFrame:
    return tn.threshold_sweep(_rated(spark, sf_dir))


def rating_report(spark, sf_dir) -> DataFrame:
    """Over all users, and over one with too few ratings to conclude from."""
    messages, chats = app(spark, sf_dir, "messages"), app(spark, sf_dir, "chats")
    telemetry = app(spark, sf_dir, "telemetry")
    answers = messages.filter((F.col("role") == "AI") & (F.col("created_at") >= SINCE)).count()
    every = tn.calibration_report(tn.rated_turns(messages, telemetry, SINCE), answers, 20)
    one = tn.calibration_report(tn.rated_turns(messages, telemetry, SINCE, chats.filter("id = 8")), 0, 20)
    return every.select(F.lit("all").alias("who"), "*").unionByName(one.select(F.lit("one").alias("who"), "*"))


def rating_outcomes(spark, sf_dir) -> DataFrame:
    return tn.outcome_mix(_rated(spark, sf_dir))


def _kept(spark, sf_dir) -> DataFrame:
    points = app(spark, sf_dir, "checkpoints")
    cut = points.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("cut"))  # one row
    return tn.prune_checkpoints(points.join(F.broadcast(cut)), 3, F.col("cut")).drop("cut")


def checkpoint_prune(spark, sf_dir) -> DataFrame:
    """What stays of checkpoints, writes and blobs, by namespace."""
    kept = _kept(spark, sf_dir)
    count = lambda name, rows: rows.groupBy("checkpoint_ns").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "checkpoint_ns", "n")
    # a write's checkpoint is looked for under half of the ids: the others' writes are orphans
    writes = tn.prune_writes(app(spark, sf_dir, "writes").withColumn("checkpoint_id", F.col("checkpoint_id") + F.col("idx") % 2), kept)
    return count("checkpoints", kept).unionByName(count("writes", writes)).unionByName(count("blobs", tn.prune_blobs(app(spark, sf_dir, "blobs"), kept)))


#: Scores made of a text's words by their lengths, and for some conversations answers of the wrong shape.
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+', 0)"
_PAYLOAD = f"""CASE conv_id % 6 WHEN 0 THEN '{{"scores":[' || array_join(transform(slice({_WORDS}, 1, 6), w -> '{{"id":' || CAST(length(w) % 5 AS STRING) || ',"score":' || CAST(length(w) * 2 - 7 AS STRING) || '}}'), ',') || ']}}' WHEN 1 THEN '{{"scores":[{{"id":0,"score":1}},{{"id":3,"score":12}},{{"id":3,"score":2}},{{"id":4,"score":5}}]}}'
WHEN 2 THEN '{{"scores":[{{"id":true,"score":5}},{{"id":1,"score":false}},{{"id":2,"score":-4}},{{"id":"3","score":1}}]}}' WHEN 3 THEN '{{"scores":7}}' WHEN 4 THEN 'no json' ELSE '{{"scores":[{{"id":1,"score":2.5}},{{"id":3}},7,{{"id":2,"score":' || CAST(turn AS STRING) || '}}]}}' END"""


def score_parsing(spark, sf_dir) -> DataFrame:
    """Scoring responses of three passages: what counts of each, and the passages' order by it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", an.parse_scores(F.expr(_PAYLOAD), F.lit(3).cast("long")).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.format_string("%.1f", x["score"]))), ",")
    return rows.select("conv_id", "turn", text.alias("scores"), F.array_join(an.order_by_scores(F.lit(3).cast("long"), F.col("s")).cast("array<string>"), ",").alias("positions"))


def routed_questions(spark, sf_dir) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.trim(F.coalesce("text", F.lit(""))).alias("q"))
    return asked.select("conv_id", "turn", an.offline_route(F.col("q")).alias("r")).select("conv_id", "turn", "r.query_class", "r.strategy", F.size("r.probes").alias("probes"), F.array_join("r.probes", "|").alias("texts"))


def cleaned_probes(spark, sf_dir) -> DataFrame:
    """Probes made of a benchmark item: itself in wider spacing, twice its first words, blanks, a long one and others."""
    text = F.substring("text", 1, 180)
    raw = F.array(F.replace(text, F.lit(" "), F.lit("  ")), F.substring(text, 1, 30), F.concat(F.lit("  "), F.lower(F.substring(text, 1, 30))), F.lit(" "), F.lit(None).cast("string"), F.repeat(F.concat(text, F.lit(" ")), 5), F.lit("another"), F.lit("too many"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.array_join(an.cleaned_probes(raw, text), "|"), 256).alias("probes"), F.size(an.cleaned_probes(raw, text)).alias("n"))


def realigned_scores(spark, sf_dir) -> DataFrame:
    """The first words of an item as ids, scored by their lengths; the longer ones survive, in reverse. Texts of some lengths lack a score or have an unknown survivor."""
    previous = F.slice(F.array_distinct(F.expr(_WORDS)), 1, 8)
    scores = F.transform(previous, lambda w: F.length(w) + F.lit(0.5))
    n = F.length(F.coalesce("text", F.lit("")))
    scores = F.when(n % 4 == 3, F.slice(scores, 2, 8)).otherwise(scores)
    surviving = F.reverse(F.filter(previous, lambda w: F.length(w) > 3))
    surviving = F.when(n % 5 == 0, F.concat(surviving, F.array(F.lit("-")))).otherwise(surviving)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(an.realigned(previous, surviving, scores).cast("array<string>"), ",").alias("scores"))


def display_texts(spark, sf_dir) -> DataFrame:
    """Durations, sizes, badges, waits and keys of documents as they are shown or named."""
    i = F.col("id")
    return app(spark, sf_dir, "docs").select(
        "id",
        an.duration(i * 7 - 20).alias("duration"),
        an.file_size(F.when(i % 10 == 0, -1).otherwise(F.col("size_bytes") * F.pow(F.lit(10), i % 6).cast("long"))).alias("size"),
        an.badge(F.when(i % 5 == 0, F.lit("readme")).otherwise(F.col("filename"))).alias("badge"),
        an.retry_window(i % 9 + 1).alias("wait"),
        an.final_attempt(i % 9).alias("final"),
        an.evaluation_key(i, F.col("checksum"), F.when(i % 2 == 0, F.lit("n1"))).alias("key"),
    )


def source_lines(spark, sf_dir) -> DataFrame:
    return app(spark, sf_dir, "messages").select("id", an.source_line(an.cited_json(F.col("citations"))).alias("line"))


def mentioned_documents(spark, sf_dir) -> DataFrame:
    """Names made of an item's words, some of which contain one another: the longer one claims its text."""
    w = F.expr(_WORDS)
    word = lambda k: F.coalesce(F.get(w, k), F.lit("none"))
    at = lambda *parts: F.concat(F.lit("@"), *parts)
    two = F.concat(word(0), F.lit(" "), word(1))
    text = F.concat(F.lit("see "), F.when(F.length(word(2)) % 2 == 0, at(two)).otherwise(at(word(0))), F.lit(" and "), at(word(3)), F.lit(", "), at(word(F.lit(4) + F.length(word(0)) % 3)), F.lit("s"))
    docs = F.array(*[F.struct(F.lit(k).cast("long").alias("id"), n.alias("name")) for k, n in enumerate((word(0), two, word(4), F.substring(word(3), 1, 3)))])
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(an.mentioned(text, docs).cast("array<string>"), ",").alias("ids"))


def grounded_answers(spark, sf_dir) -> DataFrame:
    """Answers with planted marks: after the second sentence, and before or after a blank line, by conversation; some have none."""
    answers = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.expr(_PLANTED).alias("answer"))
    found = gr.assess(F.replace(F.replace("answer", F.lit("[S1]"), F.lit(gr.MARK)), F.lit("[S2]"), F.lit(gr.MARK)))
    return answers.select("conv_id", "turn", found.alias("g")).select("conv_id", "turn", "g.claims", "g.supported", "g.citations", F.round("g.score", 6).alias("score"), "g.reason")


# sentences without stops inside, so that SQL without look-around can tell them apart
_PLANTED = r"""regexp_replace(coalesce(text, ''), '[^A-Za-z ]+', ' ') || CASE conv_id % 6 WHEN 0 THEN '.' WHEN 1 THEN ' [S1].' WHEN 2 THEN '. One more claim of five words. [S1] And an uncovered claim here too.'
WHEN 3 THEN concat('. A second claim of words here.', chr(10), chr(10), 'Short heading [S1]') WHEN 4 THEN concat('.', chr(10), chr(10), 'A claim in another block stands. [S2]', chr(10), 'Too short.', chr(10), 'A line that is claimed last') ELSE ' ends. Short one. [S1]' END"""
_RATED = f"""rated AS (SELECT m.id, m.feedback = 'UP' AS liked, CAST(json_extract(evaluation, '$.relevancy') AS DOUBLE) / 10 AS relevancy, CAST(json_extract(evaluation, '$.faithfulness') AS DOUBLE) / 10 AS faithfulness, t.groundedness, coalesce(CASE WHEN t.message_id IS NULL THEN NULL ELSE coalesce(t.outcome, CASE WHEN t.error_code IS NOT NULL THEN 'error' ELSE 'unknown' END) END, 'unrecorded') AS outcome
FROM messages m LEFT JOIN telemetry t ON t.message_id = m.id AND t.conversation_id % 5 <> 0 WHERE m.role = 'AI' AND m.feedback IS NOT NULL AND m.created_at >= {SINCE}),
long AS (SELECT * FROM (SELECT liked, 'relevancy' AS metric, relevancy AS value FROM rated UNION ALL SELECT liked, 'faithfulness', faithfulness FROM rated UNION ALL SELECT liked, 'groundedness', groundedness FROM rated) WHERE value IS NOT NULL)"""
_CITES = """cites AS (SELECT m.id, m.conversation_id, m.seq, pos, json_extract_string(citations, '$.segments[' || pos || '].doc') AS doc, json_extract_string(citations, '$.segments[' || pos || '].chunkId') AS chunk FROM messages m, (VALUES (0), (2)) p(pos) WHERE doc IS NOT NULL)"""
_OUTCOME = "coalesce(outcome, CASE WHEN error_code IS NOT NULL THEN 'error' ELSE 'unknown' END)"
_REPORT = f"SELECT '{{}}' AS who, count(*) AS rated, count(*) FILTER (WHERE liked) AS liked, count(*) FILTER (WHERE NOT liked) AS disliked, {{}} AS coverage, {{}} AS conclusive, {{}} AS liked_citations, {{}} AS disliked_citations FROM r {{}}"
_ENOUGH = "count(*) >= 20 AND count(*) FILTER (WHERE liked) > 0 AND count(*) FILTER (WHERE NOT liked) > 0"



def _mentioned_sql() -> str:
    """Names in turn, longest first: where one is found, it is blanked for the next."""
    word = lambda k: f"coalesce(w[{k} + 1], 'none')"
    two = f"{word(0)} || ' ' || {word(1)}"
    text = f"'see @' || CASE WHEN length({word(2)}) % 2 = 0 THEN {two} ELSE {word(0)} END || ' and @' || {word(3)} || ', @' || {word(f'(4 + length({word(0)}) % 3)')} || 's'"
    names = f"[{word(0)}, {two}, {word(4)}, substring({word(3)}, 1, 3)]"
    steps = f"WITH a AS (SELECT item_id, {_WORDS} AS w FROM benchmark), s0 AS (SELECT item_id, {text} AS rest, [] :: BIGINT[] AS found, list_sort(list_transform({names}, lambda x, i: {{'n': -length(x), 'id': i - 1, 'token': '@' || x}})) AS d FROM a)"
    for k in range(1, 5):
        steps += f", s{k} AS (SELECT item_id, d, CASE WHEN p > 0 THEN left(rest, p - 1) || repeat(' ', length(t)) || substring(rest, p + length(t)) ELSE rest END AS rest, CASE WHEN p > 0 THEN list_append(found, d[{k}].id) ELSE found END AS found FROM (SELECT *, d[{k}].token AS t, strpos(rest, d[{k}].token) AS p FROM s{k - 1}))"
    return steps + " SELECT item_id, array_to_string(list_sort(found), ',') AS ids FROM s4"


SQL = {
    "telemetry_outcomes": f"WITH {app_sql('telemetry')} SELECT {_OUTCOME} AS outcome, count(*) AS n FROM telemetry WHERE role = 'assistant' GROUP BY 1",
    "telemetry_counts": f"WITH {app_sql('telemetry')} SELECT 'all' AS what, count(*) AS n FROM telemetry WHERE created_at >= {SINCE} UNION ALL SELECT 'error', count(*) FROM telemetry WHERE created_at >= {SINCE} AND {_OUTCOME} = 'error'",
    "persisted_turns": f"WITH {app_sql('telemetry')}, t AS (SELECT message_id, CASE WHEN conversation_id % 4 = 0 THEN 'blocked' ELSE outcome END AS outcome, conversation_id % 8 = 0 AS screened FROM telemetry) SELECT message_id, outcome FROM t WHERE outcome IN ('answered', 'abstained') OR (outcome = 'blocked' AND screened)",
    "saved_answers": f"""WITH {app_sql('messages')}, s AS (SELECT id, role, conversation_id, seq, CASE WHEN redo THEN 'anew' ELSE content END AS content, CASE WHEN redo THEN '{{}}' ELSE citations END AS citations, CASE WHEN NOT redo THEN feedback END AS feedback, CASE WHEN NOT redo THEN evaluation END AS evaluation FROM (SELECT *, role = 'AI' AND conversation_id % 4 = 0 AS redo FROM messages)
UNION ALL SELECT id + 900, 'AI', conversation_id, 900, 'more', NULL, NULL, NULL FROM messages WHERE seq = 0 AND conversation_id % 5 = 0)
SELECT id, role, sha256(content) AS content, citations, CASE WHEN role = 'AI' AND conversation_id % 3 = 0 THEN CASE WHEN seq % 2 = 0 THEN 'UP' END ELSE feedback END AS feedback, evaluation FROM s""",
    "prompt_history": f"""WITH {app_sql('messages')}, t AS (SELECT *, trim(content) AS body FROM messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 4)
SELECT conversation_id, seq, CASE role WHEN 'USER' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN length(body) > 60 THEN '[…]' || right(body, 60) ELSE body END AS content FROM t WHERE role <> 'SYSTEM' AND body <> ''""",
    "regenerable_answers": f"""WITH {app_sql('messages')}, g AS (SELECT conversation_id, arg_max(id, seq) AS answer_id, arg_max(role, seq) AS role, arg_max(id, seq) FILTER (WHERE role = 'USER') AS question_id, count(*) FILTER (WHERE role = 'USER') AS turn_index FROM messages GROUP BY 1)
SELECT conversation_id, answer_id, question_id, turn_index FROM g WHERE role = 'AI' AND question_id IS NOT NULL""",
    "context_budget": f"WITH {app_sql('messages')}, u AS (SELECT conversation_id, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS used FROM messages GROUP BY 1) SELECT conversation_id, used, used + 7 + 1500 AS projected, used + 1507 <= 1700 AS allowed, least(round(100.0 * used / 1700, 1), 100.0) AS percent FROM u",
    "evaluation_skips": f"""WITH {app_sql('messages')}, {_CITES}, m AS (SELECT id, conversation_id, role, conversation_id % 2 = 0 AND evaluation IS NOT NULL AS done, last_value(CASE WHEN role = 'USER' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM messages)
SELECT id, CASE WHEN role <> 'AI' THEN 'not_ai_message' WHEN done THEN 'already_evaluated' WHEN id NOT IN (SELECT id FROM cites) THEN 'no_citations' WHEN conversation_id % 7 = 0 THEN 'not_found' WHEN coalesce(trim(question), '') = '' THEN 'no_question' WHEN id NOT IN (SELECT id FROM cites WHERE chunk IN ('c0', 'c1', 'c2')) THEN 'context_unavailable' END AS skip FROM m""",
    "session_statistics": f"""WITH {app_sql('messages')}, g AS (SELECT conversation_id, avg(CAST(json_extract(evaluation, '$.relevancy') AS DOUBLE)) AS relevancy, avg(CAST(json_extract(evaluation, '$.faithfulness') AS DOUBLE)) AS faithfulness, arg_max(model_name, seq) FILTER (WHERE model_name <> '') AS model_name FROM messages WHERE role = 'AI' GROUP BY 1),
o AS (SELECT *, round(CASE WHEN relevancy IS NULL THEN faithfulness WHEN faithfulness IS NULL THEN relevancy ELSE (relevancy + faithfulness) / 2 END, 2) AS overall FROM g)
SELECT conversation_id, round(relevancy, 2) AS relevancy, round(faithfulness, 2) AS faithfulness, overall, CASE WHEN overall >= 0.9 THEN 'good' WHEN overall >= 0.8 THEN 'warn' WHEN overall IS NOT NULL THEN 'bad' END AS band, model_name FROM o""",
    "sources_referenced": f"WITH {app_sql('messages')}, {_CITES}, g AS (SELECT conversation_id, doc, count(*) AS passages, min(seq * 10 + pos) AS first FROM cites GROUP BY ALL) SELECT conversation_id, doc, passages, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY first) AS INTEGER) AS place FROM g",
    "rating_separation": f"WITH {app_sql('messages', 'telemetry')}, {_RATED} SELECT metric, count(*) FILTER (WHERE liked) AS liked_n, count(*) FILTER (WHERE NOT liked) AS disliked_n, median(value) FILTER (WHERE liked) AS liked_median, median(value) FILTER (WHERE NOT liked) AS disliked_median, round(liked_median - disliked_median, 6) AS gap FROM long GROUP BY metric",
    "rating_sweep": f"""WITH {app_sql('messages', 'telemetry')}, {_RATED}, s AS (SELECT metric, CAST(k AS DOUBLE) / 10 AS threshold, count(*) FILTER (WHERE NOT liked AND value < CAST(k AS DOUBLE) / 10) AS caught, count(*) FILTER (WHERE NOT liked AND value >= CAST(k AS DOUBLE) / 10) AS missed, count(*) FILTER (WHERE liked AND value < CAST(k AS DOUBLE) / 10) AS false_alarms, count(*) FILTER (WHERE liked AND value >= CAST(k AS DOUBLE) / 10) AS passed FROM long, range(1, 11) r(k) GROUP BY metric, k)
SELECT *, round(CAST(caught AS DOUBLE) / nullif(caught + false_alarms, 0), 6) AS precision, round(CAST(caught AS DOUBLE) / nullif(caught + missed, 0), 6) AS recall FROM s""",
    "rating_report": f"""WITH {app_sql('messages')}, c AS (SELECT id, conversation_id, feedback = 'UP' AS liked, CASE WHEN citations IS NULL THEN 0 ELSE 3 END AS n FROM messages WHERE role = 'AI' AND feedback IS NOT NULL AND created_at >= {SINCE}), r AS (SELECT * FROM c)
{_REPORT.format('all', f"round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM messages WHERE role = 'AI' AND created_at >= {SINCE}), 6)", _ENOUGH, f'CASE WHEN {_ENOUGH} THEN median(n) FILTER (WHERE liked) END', f'CASE WHEN {_ENOUGH} THEN median(n) FILTER (WHERE NOT liked) END', '')}
UNION ALL {_REPORT.format('one', 'NULL', 'false', 'NULL', 'NULL', 'WHERE conversation_id = 8')}""",
    "rating_outcomes": f"WITH {app_sql('messages', 'telemetry')}, {_RATED} SELECT liked, outcome, count(*) AS n FROM rated GROUP BY ALL",
    "checkpoint_prune": f"""WITH {app_sql('checkpoints', 'writes', 'blobs')}, kept AS (SELECT *, row_number() OVER (PARTITION BY thread_id, checkpoint_ns ORDER BY checkpoint_id DESC) AS n FROM checkpoints QUALIFY n <= 3 OR ts >= (SELECT max(ts) - INTERVAL 1 HOUR FROM checkpoints))
SELECT 'checkpoints' AS what, checkpoint_ns, count(*) AS n FROM kept GROUP BY ALL
UNION ALL SELECT 'writes', checkpoint_ns, count(*) FROM writes w WHERE EXISTS (SELECT 1 FROM kept k WHERE k.thread_id = w.thread_id AND k.checkpoint_ns = w.checkpoint_ns AND k.checkpoint_id = w.checkpoint_id + w.idx % 2) GROUP BY ALL
UNION ALL SELECT 'blobs', checkpoint_ns, count(*) FROM blobs b WHERE EXISTS (SELECT 1 FROM kept k WHERE k.thread_id = b.thread_id AND k.checkpoint_ns = b.checkpoint_ns AND json_extract_string(k.checkpoint, '$.channel_versions.' || b.channel) = b.version) GROUP BY ALL""",
    "score_parsing": f"""WITH w AS (SELECT conv_id, turn, unnest({_WORDS}[1:6]) AS word, generate_subscripts({_WORDS}[1:6], 1) AS i FROM conversations WHERE conv_id % 6 = 0),
f AS (SELECT conv_id, turn, id, arg_min(CAST(least(greatest(length(word) * 2 - 7, 0), 10) AS DOUBLE), i) AS score, min(i) AS i FROM (SELECT *, length(word) % 5 AS id FROM w) WHERE id BETWEEN 1 AND 3 GROUP BY conv_id, turn, id),
p AS (SELECT conv_id, turn, string_agg(id || ':' || score, ',' ORDER BY i) FILTER (WHERE score IS NOT NULL) AS scores, string_agg(id, ',' ORDER BY score IS NULL, score DESC, id) AS positions FROM (SELECT a.conv_id, a.turn, n AS id, score, i FROM (SELECT conv_id, turn, unnest([1, 2, 3]) AS n FROM conversations WHERE conv_id % 6 = 0) a LEFT JOIN f ON f.conv_id = a.conv_id AND f.turn = a.turn AND f.id = n) GROUP BY ALL)
SELECT c.conv_id, c.turn, CASE c.conv_id % 6 WHEN 0 THEN coalesce(p.scores, '') WHEN 1 THEN '3:10.0' WHEN 2 THEN '2:0.0' WHEN 3 THEN '' WHEN 4 THEN '' ELSE '1:2.5,2:' || least(c.turn, 10) || '.0' END AS scores,
CASE c.conv_id % 6 WHEN 0 THEN p.positions WHEN 1 THEN '3,1,2' WHEN 2 THEN '2,1,3' WHEN 5 THEN CASE WHEN c.turn > 2 THEN '2,1,3' ELSE '1,2,3' END ELSE '1,2,3' END AS positions FROM conversations c LEFT JOIN p ON p.conv_id = c.conv_id AND p.turn = c.turn""",
    "routed_questions": r"""WITH a AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS q FROM conversations WHERE role = 'user'),
p AS (SELECT *, list_filter(list_transform(string_split(replace(q, '?', '?' || chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts, list_filter(list_transform(string_split(q, ' and '), lambda x: trim(x)), lambda x: x <> '') AS halves, len(list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> '')) AS words FROM a),
r AS (SELECT conv_id, turn, CASE WHEN len(parts) > 1 OR contains(lower(q), ' and ') THEN 'multi_part' WHEN words <= 3 THEN 'vague' ELSE 'simple' END AS query_class, CASE WHEN len(parts) > 1 THEN parts[1:3] WHEN contains(lower(q), ' and ') THEN halves[1:3] WHEN words <= 3 THEN [q || ' details'] ELSE [] END AS probes FROM p)
SELECT conv_id, turn, query_class, CASE query_class WHEN 'multi_part' THEN 'decompose' WHEN 'vague' THEN 'hyde' ELSE 'hybrid' END AS strategy, CAST(len(probes) AS INTEGER) AS probes, array_to_string(probes, '|') AS texts FROM r""",
    "cleaned_probes": r"""WITH b AS (SELECT item_id, trim(substring(text, 1, 30)) AS start, rtrim(substring(trim(repeat(text || ' ', 5)), 1, 400)) AS long, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM (SELECT item_id, substring(text, 1, 180) AS text FROM benchmark)),
l AS (SELECT item_id, list_filter([start, long, 'another', 'too many'], lambda x, i: i = 1 OR (i = 2 AND trim(regexp_replace(lower(long), '\s+', ' ', 'g')) <> trim(regexp_replace(lower(start), '\s+', ' ', 'g'))) OR i > 2) AS p, key FROM b),
m AS (SELECT item_id, list_filter(p, lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g')) <> key)[1:3] AS p FROM l)
SELECT item_id, sha256(array_to_string(p, '|')) AS probes, CAST(len(p) AS INTEGER) AS n FROM m""",
    "realigned_scores": f"""WITH w AS (SELECT item_id, length(coalesce(text, '')) AS n, {_WORDS} AS all_words FROM benchmark), p AS (SELECT *, list_filter(all_words, lambda x, i: list_position(all_words, x) = i)[1:8] AS ids FROM w)
SELECT item_id, CASE WHEN (n % 4 = 3 AND len(ids) > 0) OR n % 5 = 0 THEN '' ELSE array_to_string(list_transform(list_reverse(list_filter(ids, lambda x: length(x) > 3)), lambda x: CAST(length(x) + CAST(0.5 AS DOUBLE) AS STRING)), ',') END AS scores FROM p""",
    "display_texts": f"""WITH {app_sql('docs')}, d AS (SELECT *, greatest(id * 7 - 20, 0) AS s, CASE WHEN id % 10 = 0 THEN -1 ELSE size_bytes * CAST(power(10, id % 6) AS BIGINT) END AS b FROM docs)
SELECT id, CASE WHEN s // 60 < 10 THEN '0' ELSE '' END || (s // 60) || ':' || CASE WHEN s % 60 < 10 THEN '0' ELSE '' END || (s % 60) AS duration,
CASE WHEN b < 0 THEN NULL WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{{:.1f}} KB', floor(CAST(b AS DOUBLE) / 1024 * 10 + 0.5) / 10) WHEN b < 1073741824 THEN format('{{:.1f}} MB', floor(CAST(b AS DOUBLE) / 1048576 * 10 + 0.5) / 10) ELSE format('{{:.1f}} GB', floor(CAST(b AS DOUBLE) / 1073741824 * 10 + 0.5) / 10) END AS size,
CASE WHEN id % 5 = 0 THEN 'DOC' ELSE upper(regexp_extract(filename, '\\.([a-z]+)$', 1)) END AS badge, least(10.0 * power(2.0, id % 9), 600.0) AS wait, id % 9 >= 5 AS final, 'eval:' || id || ':' || substring(sha256(checksum), 1, 12) || CASE WHEN id % 2 = 0 THEN ':n1' ELSE '' END AS key FROM d""",
    "source_lines": f"WITH {app_sql('messages')}, {_CITES}, g AS (SELECT id, count(*) AS n, any_value(doc) FILTER (WHERE pos = 0) AS a, any_value(doc) FILTER (WHERE pos = 2) AS b FROM cites GROUP BY id) SELECT m.id, 'grounded in ' || n || ' passages · ' || a || CASE WHEN a <> b THEN ' · ' || b ELSE '' END AS line FROM messages m LEFT JOIN g USING (id)",
    "mentioned_documents": _mentioned_sql(),
    "grounded_answers": rf"""WITH p AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[^A-Za-z ]+', ' ', 'g'), ' +'), lambda w: w <> '')) AS words FROM conversations WHERE role = 'assistant'),
q AS (SELECT conv_id, turn, conv_id % 6 AS k, CASE WHEN words + CASE WHEN conv_id % 6 = 5 THEN 1 ELSE 0 END >= 4 THEN 1 ELSE 0 END AS c, words + CASE WHEN conv_id % 6 = 5 THEN 1 ELSE 0 END > 0 AS prose FROM p),
r AS (SELECT conv_id, turn, CAST(CASE k WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN c + 2 WHEN 3 THEN c + 1 WHEN 4 THEN c + 2 ELSE c END AS INTEGER) AS claims, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN c WHEN 2 THEN c + 1 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE c END AS INTEGER) AS supported, CASE WHEN k = 0 THEN 0 ELSE 1 END AS citations FROM q)
SELECT *, round(CASE WHEN claims > 0 THEN CAST(supported AS DOUBLE) / claims WHEN citations > 0 THEN 1.0 ELSE 0.0 END, 6) AS score, CASE WHEN citations = 0 THEN 'no_citations' WHEN claims = 0 THEN 'no_claims' WHEN supported < claims THEN 'partial_coverage' END AS reason FROM r""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}

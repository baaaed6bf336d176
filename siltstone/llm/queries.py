"""Queries over the driver's tables for the operators of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, chat_format, lang_conv, lm_bloom, packing, prefix_trie, quality_mil, quality_rules, simhash, suffix_dedup, token_counts, topk, vector_codes
from siltstone.llm._common import documents, held_out

MULTI = "byte_bpe_multi_50k.tiktoken"
PACKED = "byte_bpe_50k.json"

#: Conversation -7: both turns hold strings that look like other templates' marks.
HOSTILE = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(made)))


def quality_model(spark: SparkSession, sf_dir: str) -> quality_mil.AttentionModel | None:
    """Learned from labelled rows that aren't held out: crc32 of the id as text, modulo 3, isn't 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_mil.train(documents(spark, sf_dir), labels.filter(~held_out(F.col("doc_id"), 3, 1)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_mil.score(documents(spark, sf_dir).select("doc_id", "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) - F.octet_length("kept_bytes")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(MULTI), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, pattern), ranks, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits: its start cut, a word put into its middle, a sentence added."""
    ranks, pattern = public_tokenizers.path(MULTI), public_tokenizers.PATTERN
    size = F.length(F.coalesce("text", F.lit("")))
    edit = lambda at, n, new: F.struct(at.cast("int").alias("position"), F.lit(n).alias("length"), F.lit(new).alias("replacement"))
    edits = F.array(edit(F.lit(0), 7, ""), edit(size / 2, 3, " amended"), edit(F.lit(None), 0, " One more sentence."))
    docs = documents(spark, sf_dir).select("doc_id", "text", edits.alias("edits"))
    done = token_counts.apply_edits(token_counts.count_tokens(docs, ranks, pattern), ranks, pattern)
    return done.select(
        "doc_id",
        F.element_at("tree.tokens", 2).cast("long").alias("n_tokens"),
        F.col("edited.n_tokens").alias("n_tokens_after"),
        F.col("edited.reencoded_chars").alias("reencoded_chars"),
        F.sha2("edited.text", 256).alias("text_sha256"),
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    model, table = lm_bloom.fit(docs.filter("NOT held_out"))
    return lm_bloom.score(docs, model, table, keep=("doc_id", "held_out"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    return done.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, at = quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(at[x]).alias(x) for x in names])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path(PACKED), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    conv = F.col("conv_id")
    paths, ids = prefix_trie.rebuilt(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8)
    return prefix_trie.trie(paths, ids)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return lang_conv.identify(docs.select("doc_id", "text", "held_out"), lang_conv.train(docs.filter("NOT held_out"))).drop("text")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=("label",))
    numbers = ",".join(str(x) for book in done.codebooks for entry in book for x in entry)
    codes = done.codes.select("vec_id", F.col("kept")["label"].alias("label"), F.lower(F.hex("code")).alias("code"), "error")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    joined = codes.join(sums, codes["label"].eqNullSafe(sums["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(numbers), 256).alias("codebooks_sha256"))


def queries() -> dict:
    found = (op1_chat_format, op2_quality, op3_suffix_dedup, op4_bpe_round_trip, op5_token_counts, op6_lm_scores, op7_simhash, op8_topk, op9_quality_rules, op10_packing, op11_prefix_trie, op12_language, op13_vector_codes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op8_topk": OP8, "op9_quality_rules": op9_sql(), "op11_prefix_trie": OP11, "op13_vector_codes": op13_sql()}


OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn ') + length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + 2
    + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _js_sql(counts: list[str], total: str, reference: list[float]) -> str:
    """The Jensen-Shannon distance of counts over their total to a reference."""
    terms = []
    for n, q in zip(counts, reference):
        p = f"(CAST({n} AS DOUBLE) / {total})"
        m = f"(({p} + {q!r}) / 2)"
        terms.append(f"CASE WHEN {n} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + {q!r} * log2({q!r} / {m})")
    return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0))"


def op9_sql() -> str:
    r = quality_rules
    space = r.SPACES
    chars = ["n_upper", "n_digit", "n_symbols", "n_punctuation", "n_space", "n_chars - n_upper - n_digit - n_symbols - n_punctuation - n_space"]
    common = {w: f"n{k}" for k, w in enumerate(r.COMMON)}
    tally = ", ".join(f"len(list_filter(w, lambda x: x IN ('{w}', '{w.capitalize()}'))) AS {n}" for w, n in common.items())
    by_lang = [_js_sql([*[common[w] for w in words], f"(n_words - {' - '.join(common[w] for w in words)})"], "n_words", r.word_reference(lang)) + f" / {r.without_common_words(lang)!r}" for lang, words in r.WORD_REFERENCE.items()]
    marks = lambda what: f"length(regexp_replace(t, '[^{what[1:].replace(chr(39), chr(39) * 2)}', '', 'g'))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, length(t) AS n_chars, list_filter(regexp_split_to_array(t, '[{space}]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS lines FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
m AS (SELECT rid, doc_id, n_chars, CAST(len(w) AS BIGINT) AS n_words, {marks('[' + space + ']')} AS n_space, {marks(r.CLASSES['upper'])} AS n_upper, {marks(r.CLASSES['digit'])} AS n_digit,
  {marks(r.CLASSES['symbol'])} AS n_symbols, {marks(r.CLASSES['punctuation'])} AS n_punctuation, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, {tally} FROM w),
j AS (SELECT m.*, CAST(n_chars - n_space AS BIGINT) AS word_chars, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  CASE WHEN n_chars > 0 THEN least({', '.join(_js_sql(chars, 'n_chars', r.char_reference(lang)) for lang in r.CHAR_REFERENCE)}) ELSE 1 END AS char_distance,
  CASE WHEN n_words > 0 THEN least({', '.join(by_lang)}) ELSE 1 END AS word_distance FROM m LEFT JOIN covered USING (rid)),
k AS (SELECT *, n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {r.MIN_CHARS_JUDGED} AND char_distance > {r.MAX_CHAR_DISTANCE}) AND NOT (n_words >= {r.MIN_WORDS_JUDGED} AND word_distance > {r.MAX_WORD_DISTANCE}) AS kept
FROM k
"""


#: The unsigned CRC-32 of a number's decimal digits, bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT)"

OP11 = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format('conv_id')} % 9 AS h, list(turn ORDER BY p) AS own FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[:c.h], []), c.own[c.h + 1:]) AS path FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
m AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM r),
n AS (
  SELECT depth, path[:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '')) AS ends_sha256
  FROM m GROUP BY depth, path[:depth]),
k AS (
  SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.prefix[:n.depth] = n.prefix) AS n_children,
    (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(prefix[depth].text) END AS saved FROM n)
SELECT k.conv_id, k.depth, CASE WHEN k.depth > 0 THEN any_value(u.conv_id) END AS parent_conv_id, k.n_convs, k.n_children,
  CAST(sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(d.saved) AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN k AS d ON d.depth >= k.depth AND d.prefix[:k.depth] = k.prefix
LEFT JOIN k AS u ON u.depth = k.depth - 1 AND u.prefix = k.prefix[:k.depth - 1]
GROUP BY k.conv_id, k.depth, k.n_convs, k.n_children, k.ends_sha256
"""


def op13_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    v = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS rid, vec_id, label, e FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)),
w AS MATERIALIZED (SELECT rid, j, e[j * len(e) // {parts} + 1:(j + 1) * len(e) // {parts}] AS x FROM v, range({parts}) AS r(j) WHERE len(e) = (SELECT len(e) FROM v WHERE rid = 0)),
b0 AS MATERIALIZED (SELECT j, rid AS i, x AS c FROM w WHERE rid < {entries})"""
    for k in range(rounds + 1):
        v += f""",
a{k} AS MATERIALIZED (
  SELECT rid, j, any_value(x) AS x, min({{'d': d, 'i': i}}) AS best FROM (
    SELECT w.rid, w.j, w.x, b.i, CAST(list_sum(list_transform(list_zip(w.x, b.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM w JOIN b{k} AS b ON b.j = w.j) GROUP BY rid, j)"""
        if k < rounds:
            v += f""",
s{k} AS (SELECT j, i, p, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT j, best.i AS i, unnest(x) AS y, generate_subscripts(x, 1) AS p FROM a{k}) GROUP BY j, i, p),
b{k + 1} AS MATERIALIZED (SELECT b.j, b.i, coalesce(any_value(n.c), any_value(b.c)) AS c FROM b{k} AS b LEFT JOIN (SELECT j, i, list(y ORDER BY p) AS c FROM s{k} GROUP BY j, i) AS n ON n.j = b.j AND n.i = b.i GROUP BY b.j, b.i)"""
    return (
        v
        + f""",
f AS (SELECT rid, string_agg(lower(printf('%02x', best.i)), '' ORDER BY j) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
g AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, i)) AS codebooks_sha256 FROM b{rounds})
SELECT v.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, g.codebooks_sha256 FROM f JOIN v USING (rid), g
"""
    )

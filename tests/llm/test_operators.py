"""The ten operators against brute force, and on nulls, empties, long texts, ties, repeats, no rows and clashing names."""

import collections
import hashlib
import json
import math
import random
import re
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import _common, bpe, chat_format, lm_bloom, packing, quality_mil, quality_rules, queries, simhash, simhash_wide, suffix_dedup, token_counts, topk
from siltstone.llm._common import fresh

SF = "/root/testdata/sf0.001"
RANKS, PATTERN, TOKENIZER = public_tokenizers.path(queries.MULTI), public_tokenizers.PATTERN, public_tokenizers.path(queries.PACKED)
LONG = "Long words, again and again; and then some more. " * 4000
ODD = [(1, "plain text here, and some more of it"), (2, ""), (3, None), (None, "no id at all, but a text"), (1, "plain text here, and some more of it"), (5, " \n\t "), (6, LONG), (7, "é ü\x00\x1c 漢字 🙂🙂"), (8, LONG[:3000])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"ids": F.lit("x"), "Score": F.lit(1), "fp": F.lit(None), "rid": F.lit(2.5), "kept": F.lit("k"), "n_words": F.lit(0)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, SF).toPandas(), db.execute(queries.oracle_sql()[name]).df()
    columns = sorted(theirs.columns)
    tidy = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(ours), tidy(theirs), check_dtype=False)


def test_chat_is_reversible(spark, tmp_path):
    turns = [(1, 0, "user", "a < b \\ </turn>\n<turn assistant>\n"), (1, 1, "assistant", "\\<é"), (1, 1, "assistant", None), (2, None, None, ""), (None, 3, "assistant", "x" * 100_000), (1, 0, "a>\\\n", "odd role")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    parts = chat_format.format_conversations(df)
    found = {r.conv_id: r for r in chat_format.read_back(parts).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, t[3] or ""))
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert not chat_format.read_back(chat_format.format_conversations(df.filter("false"))).collect()


def test_chat_ids_beside_a_null_stay_whole(spark):
    big = 1 << 53
    df = spark.createDataFrame([(big, 0, "user", "a"), (big + 1, 0, "user", "b"), (None, 0, "user", "c")], "conv_id long, turn long, role string, text string").coalesce(1)
    rows = chat_format.read_back(chat_format.format_conversations(df)).collect()
    assert sorted(((r.conv_id or 0), r.n_turns) for r in rows) == [(0, 1), (big, 1), (big + 1, 1)]


def test_classifier_learns_from_whole_bags(spark):
    """Bags of any length are learned from: only their last passage tells the labels apart."""
    plain = "plain words of a long report about rivers and towns " * 900
    rows = [(k, plain + ("and so it ends in peace " * 10 if k % 2 else "$$ ## BUY %% NOW && " * 12)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    model = quality_mil.train(docs, labels)
    found = quality_mil.score(docs.filter("doc_id >= 40"), model).toPandas()
    assert ((found.score >= 0.5) == (found.doc_id % 2 == 1)).mean() >= 0.9
    assert quality_mil.train(docs, labels, passages=1) is None  # no bag fits into the sample


def test_a_long_labelled_document_takes_no_others_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = labels.filter(~queries.held_out(F.col("doc_id"), 3, 1))
    first = [learn.filter(f"quality = {y}").orderBy(F.xxhash64("doc_id")).first().doc_id for y in (0, 1)]
    longer = docs.withColumn("text", F.when(F.col("doc_id").isin(first), F.repeat(F.concat("text", F.lit(" ")), 2000)).otherwise(F.col("text")))
    model = quality_mil.train(longer, learn, passages=2000)
    held = labels.filter(queries.held_out(F.col("doc_id"), 3, 1))
    found = quality_mil.score(docs.join(held, "doc_id"), model).toPandas()
    assert ((found.score >= 0.5) == (found.quality == 1)).mean() >= 0.95


def test_one_label_alone_is_not_learned_from(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    with pytest.warns(UserWarning, match="nothing is learned"):
        assert quality_mil.train(docs, labels) is None


def test_classifier_forward_and_slopes_against_plain_loops():
    texts = ["plain words, and more of them " * 30, "BUY NOW!! $$ " * 9, "", "x " * 49 + "y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    x, bag = quality_mil.encode_passages(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert bag.tolist() == [k for k, t in enumerate(texts) for _ in range(max(1, -(-len(t.split()) // 50)))]
    draw, shapes = np.random.default_rng(1), quality_mil._SHAPES
    model = quality_mil.AttentionModel(x[:, :shapes].mean(axis=0), np.ones(shapes))
    model.p = {k: draw.normal(0, 0.4, v.shape) for k, v in model.p.items()}
    p = model.p
    for k in range(len(texts)):
        encoded, gates = [], []
        for row in x[bag == k]:
            words = [int(i) for i in row[shapes:] if i < quality_mil.BUCKETS]
            lexical = sum((p["E"][i] for i in words), np.zeros(quality_mil.HIDDEN)) / max(len(words), 1)
            h = np.tanh(np.clip(row[:shapes] - model.mean, -4, 4) @ p["W"] + lexical + p["b"])
            encoded.append(h)
            gates.append(math.exp(sum(p["w"] * np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))))))
        z = sum(g * h for g, h in zip(gates, encoded)) / sum(gates)
        assert model.scores(x, bag)[k] == pytest.approx(1 / (1 + math.exp(-(z @ p["c"] + p["d"][0]))))
    y, weight = np.array([1.0, 0.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0, 0.5])
    for name, slope in model.gradients(x, bag, y, weight)[1].items():
        flat = p[name].reshape(-1)
        for at in np.argsort(-np.abs(slope.reshape(-1)))[:4]:
            was, losses = flat[at], []
            for step in (1e-6, -1e-6):
                flat[at] = was + step
                losses.append(model.gradients(x, bag, y, weight)[0])
            flat[at] = was
            assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(slope.reshape(-1)[at], abs=1e-5)


def test_slices_of_long_texts_change_nothing(monkeypatch):
    """Features, tokens, sets and fingerprints of a text are the same in slices of any size."""
    import pyarrow as pa

    draw = random.Random(2)
    text = " ".join("".join(draw.choices("abcÉ$1", k=draw.choice([1, 3, 9, 400]))) for _ in range(3000)) + "  \n" + "z" * 5000
    column = pa.array([text, " a b ", None, text[:700]])

    def made():
        return (
            quality_mil.encode_passages(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0],
            *lm_bloom.tokens(column),
            *simhash_wide.shingle_sets(column),
            np.array([simhash.simhash(simhash.shingle_hashes(t.as_py())) for t in column]),
        )

    whole = made()
    for most in (300, 4096):
        for module in (_common, quality_mil):
            monkeypatch.setattr(module, "HASH_BYTES", most)
        cuts = _common.cuts
        monkeypatch.setattr(simhash, "cuts", lambda data: cuts(data, most))
        assert all(np.array_equal(a, b) for a, b in zip(whole, made()))
        monkeypatch.undo()


@pytest.mark.parametrize("word", ["words of a long text ", "oneverylongwordwithoutwhitespace"])
def test_memory_of_a_text_of_50_mb(word):
    """Peak memory above the text's own of the functions that read whole texts."""
    code = f"""
import resource, sys
import numpy as np, pyarrow as pa
from siltstone.llm import lm_bloom, quality_mil, simhash, simhash_wide
text = {word!r} * (50_000_000 // {len(word)})
data = np.frombuffer(text.encode(), np.uint8)
offsets = np.array([0, len(data)])
column = pa.array([text], pa.large_string())
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
lm_bloom.tokens(pa.array(["a b"]))
for work in (lambda: quality_mil.encode_passages(data, offsets)[0].shape, lambda: simhash.simhash(simhash.shingle_hashes(text)), lambda: [simhash_wide.wide_print(s) for s in simhash_wide.shingle_sets(column)], lambda: lm_bloom.tokens(column)):
    before = peak()
    work()
    print(peak() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600)
    grown = [float(x) for x in done.stdout.split()]
    assert len(grown) == 4 and sum(grown) < 450, grown


def test_classifier_learns_and_takes_odd_rows(spark, odd, none):
    rows = queries.op2_quality(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in rows.doc_id]).all()
    out = rows[rows.held_out]
    assert (out.predicted == out.quality).mean() >= 0.95
    labels = spark.createDataFrame([(1, 1), (6, 0), (8, None), (None, 1), (1, 0)], "doc_id long, quality int")
    for model in (quality_mil.train(odd, labels), quality_mil.train(none, labels)):
        scored = quality_mil.score(odd, model, out=fresh(odd, "score")[0]).toPandas()
        assert len(scored) == len(ODD) and scored["score_"].between(0, 1).all()
    assert (quality_mil.score(odd, None, out="s").toPandas().s == 0.5).all()
    assert not quality_mil.score(none, None, out="s").collect()


def brute_repeats(rows, length):
    """rid -> remaining bytes; rows: (doc_id, text), one document each."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            gone[k : k + length] |= window in seen
            seen.add(window)
        out[doc, text] = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return out


@pytest.mark.parametrize("group_bytes", [4_000_000, 600])
def test_suffix_dedup_against_brute_force(spark, group_bytes):
    random.seed(group_bytes)
    common = ["".join(random.choice("ab") for _ in range(random.randint(15, 60))) for _ in range(5)]
    part = lambda: random.choice(common) if random.random() < 0.4 else "".join(random.choice("abcé\0") for _ in range(random.randint(0, 40)))
    rows = [(k, "".join(part() for _ in range(random.randint(0, 6)))) for k in range(120)]
    rows += [(200, "x" * 300), (201, "y" + "x" * 100), (202, "abcdefg" * 50), (203, None), (204, ""), (None, "".join(common)), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("rid", F.lit("clash"))
    found = suffix_dedup.deduplicate(df, length=20, group_bytes=group_bytes).collect()
    want = brute_repeats(rows, 20)
    assert len(found) == len(rows)
    assert all(bytes(r.kept_bytes) == want[r.doc_id, r.text] for r in found)


def test_suffix_dedup_on_odd_rows(odd, none):
    rows = suffix_dedup.deduplicate(odd).collect()
    assert len(rows) == len(ODD) and {r.doc_id: len(r.kept_bytes) for r in rows}[8] == 0
    assert not suffix_dedup.deduplicate(none).collect()


def test_bpe_round_trip(odd, none):
    enc = bpe.encoding(RANKS, PATTERN)
    out = fresh(odd, "ids")[0]
    for r in bpe.decode(bpe.encode(odd, RANKS, PATTERN, out=out), RANKS, PATTERN, ids=out).collect():
        assert r[out] == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert not bpe.encode(none, RANKS, PATTERN, out=out).collect()


def test_counts_follow_edits(spark, odd):
    enc, draw = bpe.encoding(RANKS, PATTERN), random.Random(3)
    for text in [LONG[:5000], "", "a", "x y " * 500, "漢字" * 400]:
        tree, now = token_counts.CountTree(enc, text), text
        for _ in range(60):
            at, n, new = draw.randint(-2, len(now) + 2), draw.choice([0, 1, 5, 700]), draw.choice(["", " ", "word", " a b", "é\n", "12 "])
            tree.edit(at, n, new)
            at = min(max(at, 0), len(now))
            now = now[:at] + new + now[at + n :]
            assert tree.text == now and tree.tokens[1] == len(enc.encode_ordinary(now))
    edits = odd.withColumn("edits", F.expr("array(null, struct(3 as position, cast(null as int) as length, 'new ' as replacement))"))
    for r in token_counts.apply_edits(token_counts.count_tokens(edits, RANKS, PATTERN), RANKS, PATTERN).collect():
        old = r.text or ""
        assert r.edited.text == old[:3] + "new " + old[3:] and r.edited.n_tokens == len(enc.encode_ordinary(r.edited.text))


def test_leaves_split_after_a_long_insertion():
    enc = bpe.encoding(RANKS, PATTERN)
    tree = token_counts.CountTree(enc, "short text, to begin with")
    tree.edit(6, 0, LONG + "f(x)[i]+=a.b;" * 3000)
    now, done = tree.text, tree.reencoded
    assert max(map(len, tree.leaves)) <= token_counts.MOST_CHARS
    tree.edit(len(now) // 2, 3, "new words")
    assert tree.reencoded - done <= 2 * token_counts.MOST_CHARS
    assert tree.tokens[1] == len(enc.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)


def test_names_that_are_taken(spark, odd, none):
    """New columns whose names are taken get underscores; those of the input stay as they are."""
    df = odd.withColumns({"tree": F.lit(1), "edited": F.lit(2), "decoded": F.lit(3), "component_id": F.lit(4), "fingerprint": F.lit(5), "node": F.lit(6), "spans": F.lit(7)})
    coded = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN, ids="ids_")
    assert all(r.ids == "x" and r.decoded == 3 and bytes(r.decoded_) == (r.text or "").encode() for r in coded.collect())
    counted = token_counts.count_tokens(df.withColumn("edits", F.expr("array(struct(0 as position, 1 as length, cast(null as string) as replacement))")), RANKS, PATTERN)
    assert all(r.tree == 1 and r.edited == 2 and r.edited_.text == (r.text or "")[1:] for r in token_counts.apply_edits(counted, RANKS, PATTERN, tree="tree_").collect())
    assert not token_counts.count_tokens(none, RANKS, PATTERN).collect()
    found = simhash.near_duplicates(df)
    assert found.columns[: len(df.columns)] == df.columns and found.columns[len(df.columns) :] == ["fingerprint_", "component_id_", "is_first"]
    assert all((r.component_id, r.fingerprint, r.node) == (4, 5, 6) for r in found.collect())
    assert all((r.Score, r.score_) == (1, 0.5) for r in quality_mil.score(df, None).collect())
    assert all(r.spans == 7 and r.kept == "k" for r in suffix_dedup.deduplicate(df.withColumn("kept_bytes", F.lit(0))).collect())


def test_lm_scores(spark, odd, none):
    rows = odd.withColumn("learn", F.coalesce(F.col("doc_id") != 7, F.lit(True)))
    model, table = lm_bloom.fit(rows.filter("learn"))
    found = lm_bloom.score(rows, model, table, keep=("doc_id", "text")).collect()
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\0"]
    count = collections.Counter(w for d, t in ODD if d != 7 for w in words(t))
    n, v = sum(count.values()), len(count)
    assert len(found) == len(ODD)
    for r in found:
        w = words(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r.score <= 0
    empty, table = lm_bloom.fit(none)
    assert {r.n_known for r in lm_bloom.score(odd, empty, table).collect()} == {0}
    assert not lm_bloom.score(none, model, table).collect()


def brute_scores(learn, texts, least=1):
    """(score by the counts' levels, score by the counts) of each text, of a bigram model with all counts in dicts; pairs of under `least` left out."""
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\0"]
    twos = lambda w: list(zip([None, *w], w))
    one = collections.Counter(w for t in learn for w in words(t))
    two = collections.Counter(p for t in learn for p in twos(words(t)))
    n, room = sum(one.values()), sum(one.values()) + len(one) + 1
    unseen = min(max(sum(c == 1 for c in two.values()) / n, 0.05), 1.0)
    two = {p: c for p, c in two.items() if c >= least}
    one[None] = one[b"\0"]
    rounded = {c: float(lm_bloom.level_count(lm_bloom.levels(np.array([c])))[0]) for c in {0, *one.values(), *two.values()} if c} | {0: 0.0}

    def total(text, of):
        p = ((1 - unseen) * min(of(two.get((v, w), 0)) / max(of(one[v]), 1.0), 1.0) + unseen * (min(of(one[w]), n) + 1) / room for v, w in twos(words(text)))
        return sum(map(math.log10, p))

    return [(total(t, rounded.__getitem__), total(t, float)) for t in texts]


def test_filter_keeps_its_bits_per_key_at_any_size():
    draw = np.random.default_rng(6)
    keys = np.unique(lm_bloom.mix(np.arange(400_000, dtype=np.uint64)) & ~np.uint64(0xFFFF))
    known, unseen = keys[::2], keys[1::2]
    for n in (1_000, len(known)):
        segment = lm_bloom.Segment((np.zeros(0, np.uint64), np.zeros(0, np.int64)), (known[:n], draw.integers(1, 50, n)))
        assert segment.bloom.segment_bits >= lm_bloom.BITS_PER_KEY * n and (segment.bloom.level(unseen) > 0).mean() < 0.015
    assert not hasattr(lm_bloom, "MAX_FILTER_BYTES")


@pytest.mark.parametrize("tokens", [1 << 20, 50])
def test_lm_scores_are_the_same_in_blocks_of_any_size(spark, tokens, monkeypatch):
    """Texts meet the segments' answers again whatever the blocks are: levels as counted, but for false probes."""
    monkeypatch.setattr(lm_bloom, "BLOCK_TOKENS", tokens)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    model, table = lm_bloom.fit(docs)
    found = lm_bloom.score(docs, model, table, keep=("doc_id", "text")).collect()
    want = brute_scores([r.text for r in found], [r.text for r in found], least=getattr(lm_bloom, "MIN_PAIR_COUNT", 1))
    same = [r.score == pytest.approx(x, rel=1e-9) for r, (x, _) in zip(found, want)]
    assert len(found) == docs.count() and np.mean(same) > 0.1
    assert sum(abs(r.score - x) for r, (x, _) in zip(found, want)) <= 0.02 * sum(r.n_tokens for r in found)


def test_lm_scores_against_a_model_of_all_counts(spark):
    """A pair seen once counts as seen: scores differ from exact counts' by the levels' rounding alone."""
    draw = random.Random(8)
    letters = "abcdefgh"
    learn = [" ".join(draw.choice(letters) for _ in range(12)) for _ in range(6)] + ["once upon a time"]
    texts = [*learn, "once upon a time", "time upon once a", "unknown words alone", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model, table = lm_bloom.fit(df.limit(len(learn)))
    found = {r.doc_id: r for r in lm_bloom.score(df, model, table).collect()}
    want = brute_scores(learn, texts)
    same = [found[k].score == pytest.approx(rounded, rel=1e-9) for k, (rounded, _) in enumerate(want)]
    assert np.mean(same) >= 0.75  # the others have a false probe
    assert all(abs(found[k].score - exact) <= math.log10(1.5) * found[k].n_tokens for k, (_, exact) in enumerate(want))
    assert found[len(learn)].score > found[len(learn) + 1].score + 1


def test_bloom_levels_hold_counts():
    keys = lm_bloom.mix(np.arange(5000, dtype=np.uint64))
    counts = np.random.default_rng(1).integers(1, 5000, 5000)
    segments, bits = 4, 1 << 18
    of = lm_bloom.segment_of(keys, segments)
    data = b"".join(lm_bloom.LogFrequencyFilter.segment(keys[of == s], counts[of == s], bits, 5) for s in range(segments))
    got = lm_bloom.LogFrequencyFilter(np.frombuffer(data, np.uint8), segments, bits, 5).level(keys)
    assert (got >= lm_bloom.levels(counts)).all() and (got == lm_bloom.levels(counts)).mean() > 0.95


def test_held_out_rows_score_better_than_base(spark):
    rows = queries.op6_lm_scores(spark, "/root/testdata/sf0.01").toPandas()
    out = rows[rows.held_out]
    assert out.score.sum() > out.base_score.sum()


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, odd, none):
    found = {(r.doc_id, r.text): r for r in simhash.near_duplicates(odd).collect()}
    for (_, text), r in found.items():
        assert r.fingerprint & (1 << 64) - 1 == brute_print(text)
    assert {found[k].component_id for k in ((2, ""), (3, None), (5, " \n\t "))} == {2}
    assert sum(r.is_first for r in simhash.near_duplicates(odd).collect()) == len({r.component_id for r in found.values()})
    assert not simhash.near_duplicates(none).collect()


@pytest.mark.parametrize("small", [512, 4])
def test_simhash_links_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", small // 128)  # with 4: hubs are whatever the share makes them
    monkeypatch.setattr(simhash, "HOT", 8)
    draw = random.Random(small)
    values = {draw.getrandbits(64) for _ in range(300)}
    centre = draw.getrandbits(64)
    for base in [*list(values)[:40], *[centre] * 400]:
        x = base
        for _ in range(draw.randint(1, 5)):
            x ^= 1 << draw.randrange(64)
        values.add(x)
    values = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    label = np.arange(len(values))
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.near_links(df, small=small)).collect()}
    groups = collections.defaultdict(set)
    for x in values.view(np.int64).tolist():
        groups[got.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, l in zip(values.view(np.int64).tolist(), label):
        want[l].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_flips_give_the_links_of_pairs():
    draw = np.random.default_rng(5)
    values = np.unique(draw.integers(0, 1 << 14, 900).astype(np.uint64) | np.uint64(0xABC << 40))
    by_pairs = simhash._forest(len(values), *simhash.pair_links(values, 3))
    assert (simhash._forest(len(values), *simhash.flip_links(values, 3)) == by_pairs).all()


def test_wide_near_copies(spark, odd, none):
    """Edited copies of 0.85 and more go, texts of other words stay, exact copies go however many they are."""
    draw = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    rows, want = [], {}
    for k in range(150):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(150, 400))]
        copy = list(words)
        for _ in range(draw.randint(1, 4)):
            copy[draw.randrange(len(copy))] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want[2 * k + 1] = len(a & b) / len(a | b)
    rows += [(1000 + k, rows[0][1].upper()) for k in range(300)] + [rows[4]] * 3
    kept = collections.Counter(r.doc_id for r in simhash_wide.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(kept.values()) == {1} and all(2 * k in kept for k in range(150)) and not any(d >= 1000 for d in kept)
    close = [d for d, s in want.items() if s >= 0.8]
    assert len(close) > 50 and sum(d in kept for d in close) <= 0.1 * len(close)
    assert all(d in kept for d, s in want.items() if s < 0.8)
    ids = sorted(simhash_wide.first_of_each(odd).select("doc_id", "rid", "Score", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in ids] == [None, 1, 2, 6, 7] and all(r.rid == 2.5 for r in ids)
    assert not simhash_wide.first_of_each(none).collect() and simhash_wide.first_of_each(none).columns == odd.columns


def test_wide_lists_pair_each_node_with_its_smallest_near_ones():
    draw = np.random.default_rng(3)
    carried = draw.integers(0, 1 << 62, 5).astype(np.uint64)[draw.integers(0, 5, 300)]
    for _ in range(6):
        carried ^= np.uint64(1) << draw.integers(0, 62, 300).astype(np.uint64)
    node = draw.permutation(1000)[:300]
    found = collections.defaultdict(set)
    for u, v in zip(*simhash_wide.list_pairs(node, carried, 17)):
        found[v].add(u)
    for k, n in enumerate(node):
        near = sorted(node[(np.bitwise_count(carried ^ carried[k]) <= 17) & (node < n)])[: simhash_wide.PARTNERS]
        assert found.get(n, set()) == set(near)


@pytest.mark.parametrize("cells", [1 << 20, 0])
def test_wide_lists_leave_no_near_pair_out(cells, monkeypatch):
    """A node that is near two others meets both; dense lists end in rounds, for nodes that nothing connects and for connected ones."""
    monkeypatch.setattr(simhash_wide, "LIST_CELLS", cells)
    draw = np.random.default_rng(8)
    carried = draw.integers(0, 1 << 62, 4).astype(np.uint64)[draw.integers(0, 4, 90)]
    for _ in range(7):
        carried ^= np.uint64(1) << draw.integers(0, 62, 90).astype(np.uint64)
    carried = np.concatenate([carried, np.array([0, 0xFFFF, 0x00FF], np.uint64)])  # the last is near both, which aren't near each other
    key, node = np.array([1] * 90 + [2] * 3), draw.permutation(1000)[:93]
    node[90:] = [2001, 2002, 2003]
    near = {(min(node[a], node[b]), max(node[a], node[b])) for a in range(93) for b in range(93) if a != b and key[a] == key[b] and np.bitwise_count(carried[a] ^ carried[b]) <= 12}
    batch = lambda rows, *more: pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(node[rows]), pa.array(carried[rows].view(np.int64)), *more], ["key", "node", "carried", *["root"] * len(more)])
    rows_of = lambda found: {(u, v) for b in found for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    begun = rows_of(simhash_wide._candidates(iter([batch(slice(0, 50)), batch(slice(50, 93))]), 12))
    assert (2002, 2003) in begun or cells == 0
    for root in (node, np.where(node % 3 > 0, node, 0)):
        found, open_, partners = {p for p in begun if p[0] != p[1]}, {u for u, v in begun if u == v}, 2
        assert open_ and found < near
        while open_:
            rows = np.flatnonzero(np.isin(node, list(open_)))
            now = rows_of(simhash_wide._apart(iter([batch(rows, pa.array(root[rows]))]), 12, partners))
            found, open_, partners = found | {p for p in now if p[0] != p[1]}, {u for u, v in now if u == v}, 2 * partners
        of = dict(zip(node, root))
        assert found <= near and {p for p in near if of[p[0]] != of[p[1]]} <= found


def test_wide_pairs_that_cannot_be_alike_are_no_rows():
    """One list of 200 unlike sets that are near by estimate gives none of its 19,900 pairs; no pair that has the similarity is left out."""
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, 260).astype(np.uint64)
    sets = [np.sort(np.concatenate([draw.choice(base, 130, replace=False), draw.integers(0, 1 << 63, 20).astype(np.uint64)])) for _ in range(200)]
    for k in range(0, 40, 2):  # copies that end at, above and below the similarity, by exchange and by length
        sets[k + 1] = np.sort(np.concatenate([sets[k][k // 2 :], draw.integers(0, 1 << 63, k // 4).astype(np.uint64)]))
    sets += [np.zeros(0, np.uint64), np.array([7], np.uint64), np.array([8], np.uint64)]
    node, size, odd = np.arange(len(sets)), np.array([len(s) for s in sets]), np.stack([simhash_wide.odd_parts(s) for s in sets])
    columns = [np.ones(len(sets), np.int64), node, np.zeros(len(sets), np.int64), node, size, *odd.view(np.int64).T]
    batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "node", "carried", "root", "n", *simhash_wide.ODD])
    found = [(u, v) for b in simhash_wide._apart(iter([batch]), 17, 1000) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    alike = {(a, b) for a in range(len(sets)) for b in range(a) for both in [len(np.intersect1d(sets[a], sets[b]))] if both >= 0.8 * (size[a] + size[b] - both)}
    assert len(alike) >= 10 and {(b, a) for a, b in alike} <= set(found) and len(set(found)) < 100


def test_pairs_of_a_dense_group_grow_with_its_size(spark, monkeypatch):
    """One group of 150 and of 600 near copies: some FEW pairs a node and round are compared, and the first alone stays."""
    real, pairs = simhash_wide.set_links, []
    monkeypatch.setattr(simhash_wide, "set_links", lambda rows, nodes, found, *more: (pairs.append(found.count()), real(rows, nodes, found, *more))[1])
    draw = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    for n in (150, 600):
        pairs.clear()
        copies = []
        for k in range(n):
            copy = list(base)
            for _ in range(k > 0 and draw.randint(1, 7)):
                copy[draw.randrange(400)] = f"x{draw.randrange(10**6)}"
            copies.append((k, " ".join(copy)))
        kept = [r.doc_id for r in simhash_wide.first_of_each(spark.createDataFrame(copies, "doc_id long, text string")).collect()]
        assert kept == [0] and sum(pairs) < 2 * simhash_wide.FEW * n


def test_a_pair_is_told_in_its_first_band():
    """Postings of all bands give each near pair once, and all those that they give without the fingerprints."""
    draw = np.random.default_rng(6)
    prints = draw.integers(0, 1 << 62, (3, simhash_wide.LONGS))[draw.integers(0, 3, 60)]
    for _ in range(20):
        prints[np.arange(60), draw.integers(0, simhash_wide.LONGS, 60)] ^= np.int64(1) << draw.integers(0, 62, 60)
    node, size, odd = np.arange(60), np.full(60, 9), np.zeros((60, simhash_wide.LONGS), np.int64)
    names = ["node", *simhash_wide.PRINT, "root", "n", *simhash_wide.ODD]
    batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (node, *prints.T, node, size, *odd.T, *prints.T)], [*names, *(f"p{k}" for k in range(simhash_wide.LONGS))])
    told = pa.Table.from_batches(simhash_wide._postings(iter([batch]))).sort_by("key").combine_chunks().to_batches()[0]
    lists = [told.filter(pa.compute.equal(told["key"], k)) for k in told["key"].unique()]
    once, all_ = ([(u, v) for x in lists for b in simhash_wide._apart(iter([x.select(told.schema.names[:n])]), 17, 100) for u, v in zip(b[0].to_pylist(), b[1].to_pylist())] for n in (told.num_columns, told.num_columns - simhash_wide.LONGS))
    assert len(once) == len(set(once)) and set(once) == set(all_) and len(all_) > 3 * len(once) > 300


def test_nodes_meet_again_on_their_open_lists_alone():
    """Each near pair of a list is told, or both ends come again on this list; no node comes on a list that leaves none of its pairs out."""
    draw = np.random.default_rng(7)
    prints = np.concatenate([draw.integers(0, 1 << 62, (3, simhash_wide.LONGS))[draw.integers(0, 3, 60)], draw.integers(0, 1 << 62, (40, simhash_wide.LONGS))])
    for _ in range(20):
        prints[np.arange(60), draw.integers(0, simhash_wide.LONGS, 60)] ^= np.int64(1) << draw.integers(0, 62, 60)
    names = ["node", *simhash_wide.PRINT]
    rows = lambda node, *more: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (node, *prints[node].T, *more)], [*names, *simhash_wide.OPEN[: len(more)]])
    lists = lambda *batch: pa.Table.from_batches(simhash_wide._postings(iter(batch))).sort_by("key").combine_chunks()
    postings = lists(rows(np.arange(100)))
    found = pa.Table.from_batches(simhash_wide._candidates(iter(postings.to_batches()), 17)).to_pandas()
    pairs, open_ = set(zip(found.u[found.u != found.v], found.v[found.u != found.v])), found[found.u == found.v]
    again = lists(rows(open_.u.to_numpy(), *(open_[c].to_numpy() for c in simhash_wide.OPEN)))
    again, of, needed = set(zip(again["key"].to_pylist(), again["node"].to_pylist())), collections.defaultdict(list), set()
    for key, node, carried in zip(*(postings[c].to_pylist() for c in ("key", "node", "carried"))):
        of[key].append((node, np.uint64(carried & (1 << 64) - 1)))
    for key, own in of.items():
        near = sorted((v, u) for u, a in own for v, b in own if u < v and np.bitwise_count(a ^ b) <= 17)
        assert all((u, v) in pairs or {(key, u), (key, v)} <= again for v, u in near)
        if len(near) > simhash_wide.LIST_PAIRS * len(own):
            needed |= {(key, w) for k, p in enumerate(near) if k and near[k - 1][0] == p[0] for w in p}
    assert again == needed and 200 < len(again) < 0.5 * simhash_wide.BANDS * len(open_)


def test_pairs_left_for_later_are_told_while_they_may_be_alike(spark):
    """Of pairs left for later those of one root and those that can't be alike go, by the same bounds as within lists."""
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 63, 120).astype(np.uint64)
    sets = [np.sort(np.concatenate([base[: 120 - k], draw.integers(0, 1 << 63, k // 2).astype(np.uint64)])) for k in range(0, 60, 3)] + [np.zeros(0, np.uint64)]
    size, odd, n = np.array([len(s) for s in sets]), np.stack([simhash_wide.odd_parts(s) for s in sets]), len(sets)
    known = spark.createDataFrame([(k, k // 2, int(size[k]), *map(int, odd[k].view(np.int64))) for k in range(n)], f"node long, root long, n long, {', '.join(f'{o} long' for o in simhash_wide.ODD)}")
    want = {(u, v) for u in range(n) for v in range(u + 1, n) if u // 2 != v // 2 and simhash_wide.may_be_alike(size[[u]], odd[[u]], size[v], odd[v], 0.8)[0]}
    got = simhash_wide.still_apart(spark.createDataFrame([(u, v) for u in range(n) for v in range(u + 1, n)], "u long, v long"), known, 0.8).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and 10 < len(want) < 150
    told = [(u, 9, *[0] * len(simhash_wide.OPEN)) for u in (3, 1, 2, 1)] + [(9, 9, 5, *[0] * (len(simhash_wide.OPEN) - 1)), (9, 9, 6, *[0] * (len(simhash_wide.OPEN) - 1))]
    kept = simhash_wide.thinned(spark.createDataFrame(told, simhash_wide.PAIRS), 2).select("u", "v", "b0", "left").collect()
    assert sorted(map(tuple, kept)) == [(1, 9, 0, False), (2, 9, 0, False), (3, 9, 0, True), (9, 9, 7, False)]


def test_near_copies_by_exact_similarity(spark):
    """Against all pairs: 0.9 or more of the documents that are 0.8 alike to an earlier one go, and none that isn't."""
    draw = random.Random(12)
    vocabulary, rows = [f"w{k}" for k in range(2000)], []
    for k in range(60):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([12, 80, 300]))]
        rows.append(" ".join(words))
        for edits in [draw.randint(1, 6) for _ in range(8)]:
            copy = list(words)
            for _ in range(edits if len(words) > 50 else 1):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["one two", "one  TWO", "one two three four five", "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash_wide.first_of_each(df).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in ((t or "").lower().split() for t in rows)]
    best = [max((len(a & b) / len(a | b) for b in sets[:k]), default=0) for k, a in enumerate(sets)]
    near = [k for k, s in enumerate(best) if s >= 0.8]
    assert len(near) > 100 and sum(k not in kept for k in near) >= 0.9 * len(near)
    alike = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    assert all(k in kept or alike[k, np.arange(len(sets)) != k].any() for k in range(len(sets)))


@pytest.mark.parametrize("slice_rows", [1 << 16, 60])
def test_top_k_is_exact(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(topk, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4 if slice_rows < 100 else 1 << 12)
    draw = np.random.default_rng(2)
    rows = [(k, draw.normal(size=8).tolist()) for k in range(400)] + [(k, [0.5] * 8) for k in range(400, 460)]
    rows += [(500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [9.0] * 8), (504, [1.0, 2.0]), (505, []), (50, [0.1] * 8), (506, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("slice", F.lit("clash"))
    vectors = topk.quantized(df)
    found = collections.defaultdict(list)
    for r in topk.top_k(vectors, vectors.filter("vec_id % 50 = 0 OR vec_id = 504")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    exact = [(r.vec_id, r.vector) for r in vectors.collect()]
    least = {}
    for i, v in exact:
        least[i] = min(least.get(i, v), v)
    for query, v in least.items():
        if query % 50 == 0 or query == 504:
            want = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in exact if i != query and len(w) == len(v)))[:5]
            assert found.get(query, []) == [(i, -s) for s, i in want]
    assert not topk.top_k(vectors.filter("false"), vectors).collect()


def test_top_k_of_huge_components_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE_ROWS", 50)
    rows = [(1, [1e300, 1.0]), (2, [1e18, -1.0]), (3, [-1e300, 0.5]), (4, [2.0, 3.0])] + [(k, [7.0, 7.0]) for k in range(10, 210)]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = collections.defaultdict(list)
    for r in topk.top_k(vectors, vectors.filter("vec_id IN (1, 3, 4, 10)")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    whole = lambda x: min(max(math.floor(256 * x) if abs(x) < 1e30 else int(math.copysign(1 << 70, x)), -(1 << 63)), (1 << 63) - 1)
    exact = {i: [whole(x) for x in v] for i, v in rows}
    for q in (1, 3, 4, 10):
        scores = {i: sum(a * b for a, b in zip(exact[q], v)) for i, v in exact.items() if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
        assert found[q] == sorted(((i, clip(scores[i])) for i in best), key=lambda p: (-p[1], p[0]))


def test_rules_on_odd_rows(odd, none):
    judged, at = quality_rules.judge(odd)
    rows = judged.collect()
    assert len(rows) == len(ODD) and at["kept"] == "kept_" and at["n_words"] == "n_words_"
    by = {r.doc_id: r for r in rows}
    assert by[2][at["n_words"]] == by[3][at["n_words"]] == by[5][at["n_words"]] == 0 and not by[3][at["kept"]]
    words = LONG.split()
    assert by[6][at["n_words"]] == len(words) and by[6][at["n_repeat_words"]] == len(words) and by[6][at["base_failed"]]
    assert quality_rules.kept_only(odd).columns == odd.columns and not quality_rules.judge(none)[0].collect()


def test_word_histogram_rejects_text_without_common_words(spark):
    draw, common = random.Random(1), quality_rules.WORD_REFERENCE["en"]
    other = lambda: "".join(draw.choice("abcdefghilmnoprstu") for _ in range(draw.randint(3, 8)))
    words = [draw.choices([*common, None], [*common.values(), 1 - sum(common.values())])[0] or other() for _ in range(300)]
    prose = [w.capitalize() + "." if k % 12 == 0 else w for k, w in enumerate(words)]
    odd = " ".join(f"{'S' if k % 12 == 0 else 's'}{other()}uy{'.' if k % 12 == 11 else ''}" for k in range(240))
    rows = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame([(1, " ".join(prose)), (2, odd), (3, odd[:700])], "doc_id long, text string"))[0].collect()}
    assert rows[1].kept and not rows[2].base_failed and rows[2].char_distance < quality_rules.MAX_CHAR_DISTANCE and not rows[2].kept
    assert rows[2].word_distance == pytest.approx(1) and rows[3].n_words < 100 and rows[3].kept


def test_packing_holds_every_id_once(spark, odd, none):
    tok = packing.tokenizer(TOKENIZER)
    pieces = packing.pack(odd.repartition(2), TOKENIZER, PATTERN).toPandas()
    got = collections.Counter()
    for (doc, n), own in pieces.groupby(["doc_id", "doc_tokens"], dropna=False):
        got[None if pd.isna(doc) else int(doc), int(n)] += int(own.length.sum()) // int(n)
    want = collections.Counter((d, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in ODD)
    assert got == want
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist() and own.length.sum() <= 2048
    long = pieces[pieces.doc_id == 6].sort_values("start")
    ids = np.frombuffer(b"".join(long.ids), "<u4")
    assert ids.tolist() == [*tok.encode(LONG, add_special_tokens=False).ids, 1]
    assert not packing.pack(none, TOKENIZER, PATTERN).collect()


def test_packer_leaves_one_short_window_at_most():
    draw = np.random.default_rng(4)
    for most in (2048, 40, 8):
        packer = packing.Packer(64, 0, most)
        docs = [np.arange(n, dtype=np.uint32) for n in draw.integers(1, 150, 500)]
        for k, ids in enumerate(docs):
            packer.add(k, ids)
            assert packer.counts.sum() <= most and [len(x) for x in packer.open] == packer.counts.tolist()
        packer.settle()
        fill = collections.Counter()
        back = collections.defaultdict(dict)
        for doc, start, length, _, window, offset, data in packer.done:
            assert offset == fill[window]
            fill[window] += length
            back[doc][start] = np.frombuffer(data, "<u4")
        assert max(fill.values()) <= 64 and sum(n < 64 for n in fill.values()) <= 1
        assert all(np.concatenate([back[k][s] for s in sorted(back[k])]).tolist() == ids.tolist() for k, ids in enumerate(docs))


def test_rank_form_gives_the_tokenizers_ids():
    enc, tok = packing.as_ranks(TOKENIZER, PATTERN), packing.tokenizer(TOKENIZER)
    assert enc is not None
    for text in [x or "" for _, x in ODD] + ["<|endoftext|> it's  \n\n they'll've", json.dumps({"a": [1, 2.5]}) * 50]:
        assert packing.ids_of(TOKENIZER, enc, text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_ids_are_those_of_the_file_as_it_is(spark):
    plain = Tokenizer.from_file(TOKENIZER)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n\n y", LONG + "<|endoftext|> it" + LONG, "<|endoftext", "no added token"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = packing.pack(df, TOKENIZER, PATTERN).toPandas().sort_values(["doc_id", "start"])
    for k, text in enumerate(texts):
        own = rows[rows.doc_id == k]
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_suffix_dedup_of_one_letter_beyond_a_slice(spark):
    n = suffix_dedup.SLICE + 5_000
    rows = suffix_dedup.deduplicate(spark.createDataFrame([(1, "a" * n), (2, "b" * 99), (3, "a" * 150)], "doc_id long, text string")).select("doc_id", F.octet_length("kept_bytes").alias("n"), F.size("spans").alias("s")).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1), (2, 99, 0), (3, 0, 1)]

"""Operators 11, 12 and 13 against brute force, and on nulls, empties, long inputs, ties, repeats, no rows and clashing names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import lang_conv, prefix_trie, queries, vector_codes

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(paths: dict) -> set:
    """Every node of the paths, from lists of (role, text)."""
    nodes = {tuple(p[:d]) for p in paths.values() for d in range(len(p) + 1)}
    members = {n: sorted(c for c, p in paths.items() if tuple(p[: len(n)]) == n) for n in nodes}
    children = {n: [m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n] for n in nodes}
    leaves = lambda n: sum(map(leaves, children[n])) or 1
    saved = lambda n: (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) + sum(map(saved, children[n]))
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in members[n] if len(paths[c]) == len(n)).encode()).hexdigest()
    return {(members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves(n), saved(n), ends(n)) for n in nodes}


def asked(conv):
    return conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8


def as_paths(turns: list) -> dict:
    import zlib

    own = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    for c in {t[0] for t in turns if t[0] is not None}:
        rows = [(t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c]
        own[c] = [(r, x) for _, r, x in sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, digest(t[1], t[2])))]
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


@pytest.mark.parametrize("block, bits", [(prefix_trie.BLOCK, prefix_trie.BLOCK_BITS), (2, 1)])
def test_trie(spark, block, bits):
    draw = random.Random(4)
    turns = []
    for c in [*range(-7, 60), 1 << 40]:
        for k in range(draw.choice([1, 2, 9, 12, 14])):
            turns.append((c, draw.choice([k, k, None, 3]), draw.choice(["user", "assistant", None]), draw.choice(["a", "é", "", None, "long " * 50])))
    turns += [(c, k, "user", f"the same turn {k}") for c in range(100, 140) for k in range(11)]  # copies, and copies that go on
    turns += [(c, 11, "user", str(c % 3)) for c in range(120, 140)]
    turns += [(None, 0, "user", "nobody's"), (500, 0, "x", "twice"), (500, 0, "x", "twice"), (501, 0, "x", "y" * 200_000)]
    df = spark.createDataFrame(turns, TURNS).withColumns({"sig": F.lit(1), "depth": F.lit("clash"), "__block": F.lit(0)})
    numbered = prefix_trie.turns_of(df, block=block)
    found = prefix_trie.trie(*prefix_trie.rebuilt(numbered, *asked(F.col("conv_id"))), block=block, bits=bits)
    assert tuple(found.columns) == prefix_trie.COLUMNS
    rows = [tuple(r) for r in found.collect()]
    want = brute_trie(as_paths(turns))
    assert len(rows) == len(want) and set(rows) == want


def test_trie_of_little(spark):
    none = spark.createDataFrame([], TURNS)
    build = lambda df: prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df), *asked(F.col("conv_id")))).collect()
    assert build(none) == [] and build(spark.createDataFrame([(None, 1, "user", "x")], TURNS)) == []
    one = [(3, 0, "user", "x")]  # no base, and its only turn is within the first h: turnless
    assert {tuple(r) for r in build(spark.createDataFrame(one, TURNS))} == brute_trie(as_paths(one)) and as_paths(one) == {3: []}


def test_language_by_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_language(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    held = [r for r in rows if r.held_out]
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_uses_whole_texts_and_no_held_out_rows(spark):
    """A language known by its last words alone; rows that aren't given to train leave no trace."""
    same = "12 + 34 = 46; " * 400
    rows = [(k, same + ("oui bien sur " * 300 if k % 2 else "yes of course " * 300), "fr" if k % 2 else "en", "s") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = lang_conv.train(docs.filter("doc_id < 30"))
    assert model.langs == ["en", "fr"]
    found = lang_conv.identify(docs.filter("doc_id >= 30"), model).collect()
    assert all(r.lang == r.lang_pred for r in found)


def test_language_on_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !?", "de"), (4, "the cat and the dog", "en"), (4, "the cat and the dog", "en"), (None, "der Hund und die Katze", "de"), (5, "der Hund und die Katze", None), (6, "der Hund", "de"), (7, "the end " * 300_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "id": F.lit(1), "pieces": F.lit(2), "nth": F.lit(0), "__found": F.lit(3)})
    model = lang_conv.train(docs)
    assert model.langs == ["de", "en"]
    out = lang_conv.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "score_"]
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        unknown = r.doc_id in (1, 2, 3)
        assert (r.lang_pred == "und") == unknown and (r.score_ == 0) == unknown and 0 <= r.score_ <= 1
    assert len({(r.lang_pred, r.score_) for r in found if r.doc_id == 4}) == 1
    assert lang_conv.train(docs.filter("false")) is None and lang_conv.train(docs.filter("doc_id <= 3")) is None
    assert {(r.lang_pred, r.score_) for r in lang_conv.identify(docs, None).collect()} == {("und", 0.0)}
    assert lang_conv.identify(docs.filter("false"), model).collect() == []


def test_network_slopes_and_look_ups():
    model = lang_conv.ByteConv(["a", "b", "c"], seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    windows = [bytes(random.Random(k).choices(range(97, 105), k=n)) for k, n in enumerate((128, 40, 3, 1, 0))]
    lengths, rows = np.array([len(w) for w in windows]), lang_conv.padded(windows)
    y, weight = np.array([0, 1, 2, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0, 1.0])
    loss, grad = model.gradients(rows, lengths, y, weight)
    for name, g in grad.items():
        flat = model.p[name].reshape(-1)
        for at in np.argsort(-np.abs(g.reshape(-1)))[:5]:
            was = flat[at]
            flat[at] = was + 1e-6
            up = model.gradients(rows, lengths, y, weight)[0]
            flat[at] = was - 1e-6
            down = model.gradients(rows, lengths, y, weight)[0]
            flat[at] = was
            assert abs((up - down) / 2e-6 - g.reshape(-1)[at]) < 1e-5
    hidden, _ = model._forward(rows, lengths)
    assert np.allclose(hidden @ model.p["U"] + model.p["c"], model.logits(rows, lengths, model.tables()))
    # a text's logits are those of its windows, weighted by their bytes
    text = bytes(random.Random(9).choices(range(97, 105), k=300))
    own = [text[i : i + 128] for i in range(0, 300, 128)]
    each = model.logits(lang_conv.padded(own), np.array([len(w) for w in own]), model.tables())
    data = np.frombuffer(b"ab" + text, np.uint8)
    assert np.allclose(model.predict(data, np.array([0, 2, 302]), model.tables())[1], (each * np.array([128, 128, 44])[:, None]).sum(axis=0) / 300)


def brute_codes(rows: list, parts: int, entries: int, rounds: int, scale: int):
    """(codes and errors by row, codebooks), plainly, in whole numbers."""
    import math

    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(scale * x) for x in r[1]] for r in kept]
    n = len(whole[0]) // parts
    cut = [[w[j * n : (j + 1) * n] for j in range(parts)] for w in whole]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda j, p: min((away(p, e), i) for i, e in enumerate(books[j]))
    for _ in range(rounds):
        to = [[near(j, c[j])[1] for j in range(parts)] for c in cut]
        for j in range(parts):
            for i in range(len(books[j])):
                if own := [c[j] for c, t in zip(cut, to) if t[j] == i]:
                    books[j][i] = [sum(x) // len(own) for x in zip(*own)]
    best = [[near(j, c[j]) for j in range(parts)] for c in cut]
    return [(r[0], "".join(f"{i:02x}" for _, i in b), sum(d for d, _ in b)) for r, b in zip(kept, best)], books


@pytest.mark.parametrize("spread", [1.0, 0.01, 1e15])
def test_codes(spark, spread):
    draw = random.Random(8)
    rows = [(k, [spread * draw.gauss(0, 1) for _ in range(8)]) for k in range(120)]
    rows += [(k, rows[k][1]) for k in range(40, 60)] + [(None, rows[0][1]), (7, [0.0] * 8)]  # repeats, a null id, a tie of ids
    df = spark.createDataFrame([(i, v, i and i % 3) for i, v in rows], "vec_id long, embedding array<double>, code int")
    done = vector_codes.compress(df, keep=("code",), parts=4, entries=9, rounds=3)
    want, books = brute_codes(rows, 4, 9, 3, 1024)
    assert done.codebooks == books
    most = (1 << 63) - 1
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    found = done.codes.collect()
    assert sorted([(r.vec_id, r.code.hex(), r.error) for r in found], key=key) == sorted([(i, c, min(e, most)) for i, c, e in want], key=key)
    assert all(r.kept["code"] == (r.vec_id and r.vec_id % 3) for r in found)
    back = vector_codes.decompress(done.codes, done.codebooks).collect()
    assert all(r.vector == [x for j in range(4) for x in books[j][r.code[j]]] for r in back) or spread > 1e9


def test_codes_leave_out_bad_rows(spark):
    bad = [(0, None), (1, []), (2, [1.0, None, 1.0, 1.0]), (3, [float("nan")] * 4), (4, [float("inf")] * 4), (5, [1.0] * 3), (7, [1.0] * 8)]
    df = spark.createDataFrame([*bad, (6, [1.0, -0.0001, 2.0, 3.0]), (8, [1.0, 0.0, 2.0, 3.0])], "vec_id long, embedding array<double>").withColumn("vector", F.lit("clash"))
    done = vector_codes.compress(df, keep=("vector",))
    assert sorted((r.vec_id, r.code.hex(), r.error) for r in done.codes.collect()) == [(6, "00000000", 0), (8, "00010000", 0)]
    assert done.codebooks[1] == [[-1], [0]]
    none = vector_codes.compress(df.filter("vec_id < 3"))
    assert none.codes.collect() == [] and none.codebooks == [[], [], [], []]


def test_exponion_search_is_exact():
    draw = np.random.default_rng(2)
    for k in (1, 2, 40, 256):
        book = vector_codes.Codebook(draw.integers(-6, 6, (k, 5)).tolist())
        parts, start = draw.integers(-8, 8, (700, 5)), draw.integers(0, k, 700)
        code, error = book.search(parts, start)
        away = ((parts[:, None, :] - book.whole.astype(np.int64)[None]) ** 2).sum(axis=2)
        assert (code == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()

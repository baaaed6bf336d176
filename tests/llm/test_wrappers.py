"""The registered queries op3, op4, op5, op7 and op10 against brute force over whole documents: every digest and count."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from siltstone.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(docs.doc_id.tolist(), [t or "" for t in docs.text]))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op3(spark, texts):
    found, seen = {r.doc_id: r for r in queries.op3_suffix_dedup(spark, SF).collect()}, set()
    assert set(found) == set(texts)
    for doc in sorted(texts):
        data = texts[doc].encode()
        gone = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(data[at : at + 100])
        runs = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(data) else 0
        rest = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
        r = found[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), int(gone.sum()), runs, sha(rest))


def test_op4(spark, texts):
    enc = bpe.encoding(public_tokenizers.path(queries.MULTI), public_tokenizers.PATTERN)
    for r in queries.op4_bpe_round_trip(spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def test_op5(spark, texts):
    enc = bpe.encoding(public_tokenizers.path(queries.MULTI), public_tokenizers.PATTERN)
    for r in queries.op5_token_counts(spark, SF).collect():
        text = texts[r.doc_id]
        half = int(len(text) / 2)  # positions are of the text as it was
        now = text[7:]
        now = now[:half] + " amended" + now[half + 3 :] + " One more sentence."
        assert (r.n_tokens, r.n_tokens_after, r.text_sha256) == (len(enc.encode_ordinary(text)), len(enc.encode_ordinary(now)), sha(now.encode()))


def test_op7(spark, texts):
    found = {r.doc_id: r for r in queries.op7_simhash(spark, SF).collect()}
    prints = {}
    for doc, text in texts.items():
        words = text.encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert found[doc].fingerprint == f"{prints[doc]:016x}"
    docs = sorted(prints)
    values = np.array([prints[d] for d in docs], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    label = np.arange(len(docs))
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    assert [found[d].component_id for d in docs] == [docs[k] for k in label]


def test_op10(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(queries.PACKED))
    pieces = queries.op10_packing(spark, SF).toPandas()
    for doc, own in pieces.sort_values("start").groupby("doc_id"):
        ids = [*tok.encode(texts[doc], add_special_tokens=False).ids, 1]
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and set(own.doc_tokens) == {len(ids)} and own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert set(pieces.doc_id) == set(texts)
    fill = pieces.sort_values("offset").groupby("sequence_id")
    for _, own in fill:
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    assert fill.length.sum().sum() / (2048 * len(fill)) > 0.95

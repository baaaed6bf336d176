"""The pipeline's stages: each one's decisions against brute force over its own input."""

import collections
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from siltstone.llm._common import materialize
from siltstone.llm.queries import PACKED

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(p.STAGES):
        out = materialize(stage(spark, docs, SF))
        if k + 1 < len(p.STAGES):
            assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, out.collect()
        if name == "suffix_array_dedup":
            seen = set()
            now = {r.doc_id: r for r in after}
            assert set(now) == set(before)
            for doc in sorted(before):
                data = before[doc].text.encode()
                gone = set()
                for at in range(len(data) - 99):
                    if data[at : at + 100] in seen:
                        gone.update(range(at, at + 100))
                    seen.add(data[at : at + 100])
                rest = bytes(b for i, b in enumerate(data) if i not in gone).decode(errors="ignore")
                assert now[doc].text == rest and now[doc].n_chars == len(rest)
        elif name == "packing":
            tok = Tokenizer.from_file(public_tokenizers.path(PACKED))
            size = {d: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in before.items()}
            got = collections.Counter()
            for r in after:
                got[r.doc_id] += r.length
            assert got == size
        elif name == "simhash_near_dedup":
            # by brute force over all pairs of sets of five-word shingles: copies go, and what goes is near one that stays or goes
            sets = {d: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for d, r in before.items() for w in [(r.text or "").lower().split()]}
            alike = lambda a, b: len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1)
            kept = {r.doc_id for r in after}
            assert all(before[r.doc_id] == r for r in after)
            near = [d for d in before if max((alike(d, e) for e in before if e < d), default=0) >= 0.8]
            assert sum(d not in kept for d in near) >= 0.9 * len(near)
            assert all(d in kept or max(alike(d, e) for e in before if e != d) >= 0.8 for d in before)
        elif name == "quality_rules":
            want = set()
            for d, r in before.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
                grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
                again = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
                if len(w) >= 50 and 100 * len(again) <= 50 * len(w):
                    want.add(d)
            kept = {r.doc_id for r in after}
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert kept <= want and {d for d in want if labels.get(d) == 1} <= kept and len(kept) > 0.9 * len(want)
        elif name == "quality_classifier":
            kept = {r.doc_id for r in after}
            labels = [(r.doc_id in kept) == (r.quality == 1) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
            assert np.mean(labels) >= 0.95 and all(before[r.doc_id] == r for r in after)
        else:
            assert 0.7 * len(before) < len(after) <= len(before)
            assert all(before[r.doc_id] == r for r in after)
        docs = out


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 80, "en", "s", 400)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__score", F.lit("clash"))
    for _, stage in p.STAGES:
        docs = materialize(stage(spark, docs, SF))
    docs.collect()

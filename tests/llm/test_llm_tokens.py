"""Problems 7 and 8: encoding against the public library, packing under every capacity."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import encoding, packing

JSON = os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.json")


def test_encode_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    if not os.path.exists(JSON):
        pytest.skip("no vocabulary here")
    lib = tokenizers.Tokenizer.from_file(JSON)
    lib.encode_special_tokens = True
    r = random.Random(5)
    alphabet = "abc ABC'’é\n\t  ।কখগ0123<|>_-²①😀‍\x1c"
    texts = [None, "", " ", "<|endoftext|>", "don't 'S 's", "a" * 3000, "ab" * 2000, *["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {x.doc_id: x.ids for x in encoding.encode(df).collect()}
    assert got == {i: (lib.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(texts)}
    assert {x.doc_id: x.tokens for x in encoding.token_counts(df).collect()} == {i: len(v) for i, v in got.items()}
    assert encoding.encode(df.limit(0)).count() == 0


def test_prefixes_are_encoded_once(spark):
    if not os.path.exists(JSON):
        pytest.skip("no vocabulary here")
    bpe = encoding.Bpe(os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.tiktoken"))
    words = {"retainer", "retainers", "retain", "retained", " retainer"}
    bpe.learn(words)
    assert all(bpe.words[w] == bpe.merge(w.encode()) for w in words)


@pytest.mark.parametrize("documents, attention", [(None, None), (3, None), (None, 2048 * 1024)])
def test_containers(spark, documents, attention):
    r = random.Random(1)
    sizes = [0, 1, 2048, 2049, 5000, 4096, *[r.randint(1, 700) for _ in range(3000)]]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long").withColumn("piece", F.lit("clash"))
    rows = packing.containers(df, most_documents=documents, most_attention=attention, group_containers=60).collect()
    by, own = {}, {}
    for x in rows:
        by.setdefault(x.container, []).append(x.tokens)
        own.setdefault(x.doc_id, []).append((x.start, x.tokens))
    for i, n in enumerate(sizes):  # each token once, split only beyond the capacity
        parts = sorted(own.get(i, []))
        assert sum(t for _, t in parts) == n and [s for s, _ in parts] == list(range(0, n, 2048)) and (n > 2048 or len(parts) <= 1)
    for tokens in by.values():
        assert sum(tokens) <= 2048 and (not documents or len(tokens) <= documents) and (not attention or len(tokens) == 1 or sum(t * t for t in tokens) <= attention)
    if not documents and not attention:
        assert len(by) <= -(-sum(sizes) // 2048) + 6
    assert packing.containers(df.limit(0)).count() == 0


def test_best_fit_fills_the_perfect_place():
    place = packing.best_fit(np.array([1500, 1400, 648, 548, 600]), 2048, 2048, 2048**2)
    assert place[0] == place[3] and place[1] == place[2] and place[4] not in place[:4]


@pytest.mark.parametrize("documents, attention, most", [(None, None, 3), (1, None, 1), (None, 2 * 600**2, 2)])
def test_each_capacity_binds(spark, documents, attention, most):
    df = spark.createDataFrame([(i, 600) for i in range(42)], "doc_id long, tokens long")
    rows = packing.containers(df, most_documents=documents, most_attention=attention).groupBy("container").count().collect()
    assert [r["count"] for r in rows] == [most] * (42 // most)


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "REOPEN_SHARE", 1.0)
    counts = spark.createDataFrame([(None, 700)] * 400 + [(7, 300)] * 400, "doc_id long, tokens int")
    got = packing.containers(counts, group_containers=16).collect()
    fill = {}
    for x in got:
        fill[x.container] = fill.get(x.container, 0) + x.tokens
    assert len(got) == 800 and sum(fill.values()) == 400_000 and max(fill.values()) <= 2048 and len(fill) <= 210
    assert len({x.container.split("-")[1] for x in got if x.doc_id is None and x.container.startswith("0-")}) > 4

"""Containers: nothing lost, nothing split that fits, little room left, related texts together."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquery.llm import packing as P
from terraquery.llm import tokens as K
from terraquery.llm.queries import TOKENIZERS

TOPICS = [["valve", "pressure", "pump", "steam", "leak", "gauge"], ["ledger", "invoice", "budget", "audit", "payment", "tax"], ["kernel", "thread", "cache", "compiler", "socket", "buffer"]]


def docs(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(TOPICS[i % 3]) for _ in range(rng.randint(20, 300)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " ".join(["valve pump"] * 2000)), (n + 3, "x" * 200_000), (n + 4, rows[0][1]), (n + 5, "汉字。" * 50)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, words string")


def test_counts_are_the_tokenizers(spark):
    df = docs(spark)
    tok = K.Tokenizer.at(TOKENIZERS)
    want = {r["doc_id"]: len(tok.encoding.encode_ordinary(r["text"])) if r["text"] else 0 for r in df.collect()}
    assert {r["doc_id"]: r["tokens"] for r in K.token_counts(df, TOKENIZERS).collect()} == want
    assert {r["doc_id"]: r["tokens"] for r in K.token_words(df, TOKENIZERS).collect()} == want


@pytest.mark.parametrize("shard_docs", [2000, 60])
def test_containers(spark, shard_docs):
    words = K.token_words(docs(spark), TOKENIZERS).cache()
    rows = P.pack(words, TOKENIZERS, 512, shard_docs).collect()
    size = {r["doc_id"]: r["tokens"] for r in words.collect()}
    got, box = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], {})[r["part"]] = r["size"]
        box.setdefault(r["container"], []).append(r)
    assert set(got) == {d for d, n in size.items() if n}
    for d, parts in got.items():
        assert sum(parts.values()) == size[d] and sorted(parts) == list(range(len(parts)))
        assert len(parts) == -(-size[d] // 512)
    for items in box.values():
        used = sum(r["size"] for r in items)
        assert used <= 512 and all(abs(r["fill"] - used / 512) < 1e-9 for r in items)
    assert len(box) <= 1.03 * sum(size.values()) / 512 + 3


def test_neighbours_are_related(spark):
    words = K.token_words(docs(spark), TOKENIZERS).cache()
    boxes = {}
    for r in P.pack(words, TOKENIZERS, 1024).collect():
        if r["doc_id"] < 400:
            boxes.setdefault(r["container"], []).append(r["doc_id"] % 3)
    same = [max(np.bincount(b)) / len(b) for b in boxes.values() if len(b) > 1]
    assert np.mean(same) > 0.75


def test_same_containers_however_the_input_is_split(spark):
    words = K.token_words(docs(spark), TOKENIZERS).cache()
    a, b = ({tuple(r) for r in P.pack(w, TOKENIZERS, 512, 60).collect()} for w in (words, words.repartition(7)))
    assert a == b


def test_shards_of_a_common_word(spark):
    items = spark.createDataFrame([(i, 0, 7 if i < 500 else i % 50 + 10 if i < 900 else None) for i in range(950)], "doc_id long, part int, first int")
    sizes = {r["shard"]: (r["n"], r["words"]) for r in P.sharded(items, "first", 100).groupBy("shard").agg(F.count("*").alias("n"), F.collect_set("first").alias("words")).collect()}
    assert sum(n for n, _ in sizes.values()) == 950 and max(n for n, _ in sizes.values()) < 150
    assert sum(7 in w for _, w in sizes.values()) == 5 and all(w == [7] for _, w in sizes.values() if 7 in w)


def test_scores_against_brute_force():
    rng = np.random.default_rng(1)
    n, vocab = 40, 60
    words = [np.unique(rng.integers(0, vocab, 12)) for _ in range(n)]
    counts = [rng.integers(1, 5, len(w)) for w in words]
    lengths = np.array([c.sum() for c in counts], "float64")
    idf = rng.random(vocab)
    idf[:5] = 0
    index = P.ShardIndex(words, counts, lengths, idf, lengths.mean())
    for q in range(n):
        want = np.zeros(n)
        for d in range(n):
            for w, c in zip(words[d], counts[d]):
                if w in words[q]:
                    want[d] += idf[w] * c * (P.K1 + 1) / (c + P.K1 * (1 - P.B + P.B * lengths[d] / lengths.mean()))
        assert np.allclose(index.scores(q), want)


def test_empty(spark):
    words = K.token_words(docs(spark).where(F.lit(False)), TOKENIZERS)
    assert P.pack(words, TOKENIZERS).count() == 0

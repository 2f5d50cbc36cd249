"""Nulls in every column, repeated rows, very long texts and extra columns."""

from terraquery.llm import mixing, packing, tokens, truncation
from terraquery.llm.queries import TOKENIZERS

HEAD = "From: a@b.example\n\n"


def test_all_nulls(spark):
    rows = [(None, HEAD + "All is well.\n", None, "x"), (None, None, None, None), (9007199254740993, HEAD + "All is we", "s", "x"), (9007199254740993, HEAD + "All is we", "s", "x"), (3, HEAD + "word " * 60_000, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    words = tokens.token_words(docs, TOKENIZERS).cache()
    assert words.count() == 5
    packed = packing.pack(words, TOKENIZERS, 2048).collect()
    size = sum(r["tokens"] for r in words.collect())
    assert sum(r["size"] for r in packed) == size
    ends = truncation.endings(docs)
    flagged = truncation.flag_truncated(ends, truncation.cut_lengths(ends)).where("truncated").collect()
    assert sorted(r["doc_id"] for r in flagged) == [3, 9007199254740993, 9007199254740993]
    items = tokens.token_counts(docs.drop("tokens"), TOKENIZERS, keep=("source",))
    targets = spark.createDataFrame([("s", 1.0, 2), (None, None, None), ("t", 0.0, 1), ("u", None, None)], "source string, target_share double, max_repeats int")
    drawn = mixing.mixture(items, targets)
    assert {r["doc_id"] for r in drawn.collect()} <= {3, 9007199254740993}
    assert mixing.shares(items, targets, drawn).count() >= 4

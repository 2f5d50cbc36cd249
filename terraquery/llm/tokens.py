"""Token counts by a public tokenizer, and the lexical terms of a text, in one pass."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """A byte-level BPE tokenizer; one is made per worker process."""

    _made: dict[str, Tokenizer] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # Terms are tokens that begin a word of three or more bytes, or hold part of a
        # letter beyond ASCII; encoded blocks, numbers and punctuation yield none.
        self.is_term = np.zeros(len(ranks) + 1, bool)
        for token, i in ranks.items():
            word = len(token) > 3 and token[:1] == b" " and token[1:].isalpha()
            self.is_term[i] = word or len(token) > 1 and max(token) >= 0x80

    @classmethod
    def at(cls, folder: str) -> Tokenizer:
        path = os.path.join(folder, VOCABULARY)
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def count(self, text: str | None) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0

    def read(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Tokens, the distinct terms in order, and how often each occurs."""
        ids = np.asarray(self.encoding.encode_ordinary(text) if text else [], "int32")
        terms, n = np.unique(ids[self.is_term[ids]], return_counts=True)
        return len(ids), terms, n.astype("int32")


def vocabulary_size(folder: str) -> int:
    return len(Tokenizer.at(folder).is_term)


def token_counts(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``keep`` and ``tokens`` (0 for a null or empty text).

    ``folder`` holds the tokenizer's vocabulary file, on every executor.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").withColumn("tokens", F.lit(0)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizer.at(folder)
        for pdf in batches:
            out = pdf.drop(columns="__text")
            out["tokens"] = [tok.count(t) for t in pdf["__text"]]
            yield out

    return rows.mapInPandas(run, schema)


def token_words(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tokens`` and the distinct terms (``words``) of the whole text with their ``counts``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizer.at(folder)
        for pdf in batches:
            got = [tok.read(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [g[0] for g in got], "words": [g[1] for g in got], "counts": [g[2] for g in got]})

    return rows.mapInPandas(run, f"doc_id {kind}, tokens int, words array<int>, counts array<int>")

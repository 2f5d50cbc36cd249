"""Containers of a fixed number of tokens, filled with lexically related documents.

Documents go to shards of a few thousand by their most telling word, whole words to a
shard where they fit and a common word to several, so that a shard holds related texts
and no word makes a large shard.  Every shard has its own BM25 inverted index; word
statistics are those of the whole corpus.  The largest unused document of the shard is
the seed of a container; the index returns the unused neighbours of the seed, which
greedily fill the container, and the last gap is closed by the neighbour that fits it
best.  What the shards leave over in poorly filled containers is packed once more, in
the shards of the second most telling words.

A seed is looked up in its own shard alone: a search of all shards for every seed would
grow with the square of the corpus, and a document can be used only once, which shards
can't settle between each other.

Only a document of more than the capacity is split: into full containers and a rest,
which is packed like a document.  Shards and containers depend on the documents alone,
so they are the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquery.llm.tokens import vocabulary_size
from terraquery.session import written

CAPACITY = 2048
#: Documents aimed at in a shard; it bounds the memory and the time of a task.
SHARD_DOCS = 2000
#: A container filled less than this is packed again among what other shards left over.
WELL_FILLED = 0.985
K1, B = 1.2, 0.75

_ITEM = "doc_id {0}, part int, size int, tokens int, words array<int>, counts array<int>, first int, second int"
_OUT = "container string, doc_id {0}, part int, size int, fill double, tokens int, words array<int>, counts array<int>, first int, second int"


def word_counts(docs: DataFrame, folder: str) -> np.ndarray:
    """In how many documents each term occurs, over all documents.

    One number for each entry of the tokenizer's vocabulary, whatever the corpus.
    """
    size = vocabulary_size(folder)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size, "int64")
        for pdf in batches:
            if len(pdf):
                df += np.bincount(np.concatenate(pdf["words"].to_list()).astype("int64"), minlength=size)
        hit = np.flatnonzero(df)
        yield pd.DataFrame({"word": hit.astype("int32"), "docs": df[hit]})

    rows = docs.select("words").mapInPandas(count, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    out = np.zeros(size, "int64")
    for word, n in rows:
        out[word] = n
    return out


class ShardIndex:
    """The BM25 inverted index of one shard."""

    def __init__(self, words: list, counts: list, lengths: np.ndarray, idf: np.ndarray, mean_length: float):
        n = np.array([len(w) for w in words], "int64")
        self.words = [np.asarray(w, "int64") for w in words]
        flat = np.concatenate(self.words) if n.sum() else np.zeros(0, "int64")
        tf = np.concatenate([np.asarray(c, "float64") for c in counts]) if n.sum() else np.zeros(0)
        doc = np.repeat(np.arange(len(words)), n)
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1.0))
        weight = idf[flat] * tf * (K1 + 1) / (tf + norm[doc])
        use = weight > 0
        flat, doc, weight = flat[use], doc[use], weight[use]
        order = np.argsort(flat, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.terms, start = np.unique(flat[order], return_index=True)
        self.start = np.append(start, len(flat))
        self.size = len(words)

    def scores(self, d: int) -> np.ndarray:
        """BM25 score of every document of the shard for document d as the query."""
        if not len(self.terms):
            return np.zeros(self.size)
        at = np.minimum(np.searchsorted(self.terms, self.words[d]), len(self.terms) - 1)
        at = at[self.terms[at] == self.words[d]]
        lo, hi = self.start[at], self.start[at + 1]
        n = hi - lo
        if not n.sum():
            return np.zeros(self.size)
        where = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.post_doc[where], weights=self.post_weight[where], minlength=self.size)


def fill_containers(size: np.ndarray, index: ShardIndex, capacity: int) -> list[list[int]]:
    """Greedy containers over one shard; every item is in exactly one."""
    free = np.ones(len(size), bool)
    made = []
    for seed in np.argsort(-size, kind="stable"):
        if not free[seed]:
            continue
        free[seed] = False
        box, room = [int(seed)], capacity - int(size[seed])
        live = np.flatnonzero(free)
        if room > 0 and len(live):
            score = index.scores(int(seed))[live]
            best = np.lexsort((size[live], -score))
            cand, csize = live[best], size[live][best]
            open_ = np.ones(len(cand), bool)
            while room > 0:
                fits = np.flatnonzero(open_ & (csize <= room))
                if not len(fits):
                    break
                # neighbours come by score; once one or two more end the container, the gap decides
                gap = room - csize[fits]
                least = gap.min()
                close = fits[gap <= max(least, 2)]
                small = csize[fits].min()
                pick = fits[0]
                if least <= 2 and room <= capacity // 2 or room - csize[pick] < small:
                    pick = close[0]
                open_[pick] = False
                box.append(int(cand[pick]))
                room -= int(csize[pick])
            free[box] = False
        made.append(box)
    return made


def sharded(items: DataFrame, word: str, shard_docs: int) -> DataFrame:
    """``items`` with a ``shard`` of about ``shard_docs`` each.

    Words in order share a shard until it is full; a word of more documents has shards of
    its own, among which a hash of the id decides.  There is a row for each word of the
    tokenizer's vocabulary at most, so the list of words is small whatever the corpus.
    """
    counts = sorted((-1 if w is None else w, n) for w, n in items.groupBy(word).agg(F.count(F.lit(1)).alias("n")).collect())
    rows, shard, room = [], -1, 0
    for w, n in counts:
        if n > shard_docs:
            k = -(-n // shard_docs)
            rows.append((w, shard + 1, k))
            shard, room = shard + k, 0
        else:
            if n > room:
                shard, room = shard + 1, shard_docs
            rows.append((w, shard, 1))
            room -= n
    of = items.sparkSession.createDataFrame(rows, "__word int, __shard int, __of int")
    found = items.join(F.broadcast(of), F.coalesce(F.col(word), F.lit(-1)) == F.col("__word"))
    place = F.pmod(F.xxhash64("doc_id", "part"), F.col("__of")).cast("int")
    return found.withColumn("shard", F.col("__shard") + place).drop("__word", "__shard", "__of")


def pack(docs: DataFrame, folder: str, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``container, doc_id, part, size, fill`` for ``docs`` of ``token_words``.

    Documents without a token need no room and are in no container.  ``part`` numbers the
    pieces of a split document from 0; ``fill`` is the used share of the container.
    ``folder`` is that of the tokenizer that made the words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    docs = docs.where(F.col("tokens") > 0)
    n, mean = docs.agg(F.count(F.lit(1)), F.avg("tokens")).first()
    df = word_counts(docs, folder)
    n = n or 0
    # common words (in over half of all documents) weigh nothing
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)
    table = spark.sparkContext.broadcast(idf.astype("float32"))
    df_seen = spark.sparkContext.broadcast(np.minimum(df, 2).astype("int8"))

    full = docs.where(F.col("tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("tokens") / capacity).cast("int") - 1)).alias("part"))
    full = full.select(F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"), "doc_id", "part", F.lit(capacity).alias("size"), F.lit(1.0).alias("fill"))

    def telling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The two most telling words of each document: greatest tf-idf among words others have too."""
        weight = np.where(df_seen.value > 1, table.value, 0.0)
        for pdf in batches:
            best = np.full((len(pdf), 2), -1, "int32")
            for i, (w, c) in enumerate(zip(pdf["words"], pdf["counts"])):
                at = np.argsort(-np.sqrt(c) * weight[w], kind="stable")[:2]
                best[i, : len(at)] = w[at]
            pdf["first"], pdf["second"] = best.T
            yield pdf

    items = docs.where(F.col("tokens") % capacity > 0).select(
        "doc_id", F.floor(F.col("tokens") / capacity).cast("int").alias("part"), (F.col("tokens") % capacity).cast("int").alias("size"), "tokens", "words", "counts", F.lit(0).alias("first"), F.lit(0).alias("second"))
    items = written(items.mapInPandas(telling, _ITEM.format(kind)))

    def boxed(round_: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "part"], ignore_index=True)
            size, shard = pdf["size"].to_numpy("int64"), int(pdf["shard"].iloc[0])
            index = ShardIndex(pdf["words"].to_list(), pdf["counts"].to_list(), pdf["tokens"].to_numpy("float64"), table.value, mean)
            names, fills, at = [], [], []
            for k, box in enumerate(fill_containers(size, index, capacity)):
                fill = float(size[box].sum()) / capacity
                names += [f"{round_}{shard}-{k}"] * len(box)
                fills += [fill] * len(box)
                at += box
            out = pdf.iloc[at].assign(container=names, fill=fills)
            done = out["fill"].to_numpy() >= WELL_FILLED if round_ == "a" else np.ones(len(out), bool)
            out["words"] = [None if d else w for d, w in zip(done, out["words"])]
            out["counts"] = [None if d else c for d, c in zip(done, out["counts"])]
            return out[["container", "doc_id", "part", "size", "fill", "tokens", "words", "counts", "first", "second"]]

        return run

    first = written(sharded(items, "first", shard_docs).groupBy("shard").applyInPandas(boxed("a"), _OUT.format(kind)))
    rest = first.where(F.col("words").isNotNull()).drop("container", "fill")
    second = sharded(rest, "second", shard_docs).groupBy("shard").applyInPandas(boxed("b"), _OUT.format(kind))
    cols = ["container", "doc_id", "part", "size", "fill"]
    return full.unionByName(first.where(F.col("words").isNull()).select(*cols)).unionByName(second.select(*cols))

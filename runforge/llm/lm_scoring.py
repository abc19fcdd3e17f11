"""LM scoring: stupid-backoff scores of documents under their corpus's n-gram counts.

S(w | context) is count(context w) / count(context) when the n-gram occurs at least
``min_count`` times in the corpus, and else ``backoff`` times S under a context one
word shorter, down to count(w) / N. A document's score is the sum of ln S over its
words; the context of a word are the up to ``order - 1`` words before it in its
document. Words are runs without ASCII white space, A-Z in lower case.

All counts cover the whole corpus. Each chunk of documents asks the count tables,
partitioned by n-gram hash, for its distinct n-grams (see ``exchange``): the tables
are summed where the n-grams meet, and the counts come back to be summed by
document. A commonest n-gram is one entry a chunk. ``N`` is the count of the n-gram
of no words.

Cases: a text without words has 0 words, score 0 and no mean; repeated rows count as
often as they occur and are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.llm import exchange
from runforge.llm.common import mix, one, prepare, schema_of, whole_text, word_hashes, words_of


class Grams:
    """The words of a chunk's texts, and their n-grams one order at a time."""

    def __init__(self, texts: pa.Array):
        index, self.bounds, distinct = words_of(pc.ascii_lower(texts))
        self.words = word_hashes(distinct)[index]
        self.n = len(self.words)
        sizes = np.diff(self.bounds)
        # words from each place to its document's end, and before it in its document
        self.left = np.repeat(self.bounds[1:], sizes) - np.arange(self.n)
        self.before = np.arange(self.n) - np.repeat(self.bounds[:-1], sizes)

    def orders(self, order: int):
        """(order, places that start an n-gram, distinct keys, the key of each place, counts)."""
        yield 0, np.arange(self.n), np.zeros(1, dtype=np.uint64), np.zeros(self.n, dtype=np.int64), np.array([self.n])
        gram = self.words
        for k in range(1, order + 1):
            if k > 1:
                after = np.concatenate([self.words[k - 1:], np.zeros(min(k - 1, self.n), dtype=np.uint64)])
                gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + after)
            places = np.flatnonzero(self.left >= k)
            keys, which, counts = np.unique(gram[places], return_inverse=True, return_counts=True)
            yield k, places, keys, which, counts


def totals(asked: list[tuple[np.ndarray, bytes]]) -> list[bytes]:
    """The sum of each key's counts over all askers, in each one's order."""
    keys, which = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
    counts = np.concatenate([exchange.unplane(x) for _, x in asked])
    summed = np.zeros(len(keys), dtype=np.int64)
    np.add.at(summed, which, counts)
    cuts = np.cumsum([0] + [len(k) for k, _ in asked])
    return [exchange.planes(summed[which[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]


def log_scores(grams: Grams, at: list[np.ndarray], min_count: int, backoff: float) -> np.ndarray:
    """ln S of each word; ``at[k]`` has the corpus count of the k-gram that starts at each place."""
    done = np.zeros(grams.n, dtype=bool)
    score = np.zeros(grams.n)
    for k in range(len(at) - 1, 0, -1):
        # words that have k - 1 words before them and no longer n-gram found
        words = np.flatnonzero(~done & (grams.before >= k - 1))
        starts = words - (k - 1)
        found = at[k][starts] >= (min_count if k > 1 else 1)
        hit = words[found]
        score[hit] += np.log(at[k][starts[found]]) - np.log(at[k - 1][starts[found]])
        done[hit] = True
        score[words[~found]] += math.log(backoff)
    return score


def score_documents(df: DataFrame, order: int = 3, min_count: int = 2, backoff: float = 0.4,
                    chunk_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_score, mean_log_score) of each row."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    chunks, buckets = exchange.chunked(rows, chunk_bytes)
    schema = schema_of(rows, "id", ("n_words", T.LongType()), ("log_score", T.DoubleType()),
                       ("mean_log_score", T.DoubleType()))

    def request(group: pa.Table) -> list[dict]:
        rows: list[dict] = []
        for k, _, keys, _, counts in Grams(one(group.column("text"))).orders(order):
            rows += exchange.requests(k, keys, lambda a, b: exchange.planes(counts[a:b].astype(np.int64)), buckets)  # noqa: B023
        return rows

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        grams, at = Grams(one(group.column("text"))), []
        for k, places, _, which, _ in grams.orders(order):
            counts = [exchange.unplane(x) for x in exchange.answers_of(answers, k)]
            here = np.zeros(grams.n, dtype=np.int64)
            if grams.n:
                here[places] = np.concatenate(counts)[which] if len(places) else 0
            at.append(here)
        words = np.diff(grams.bounds)
        score = np.zeros(len(words))
        if grams.n:  # each document by itself, so that its sum depends on no other
            score[words > 0] = np.add.reduceat(log_scores(grams, at, min_count, backoff),
                                               grams.bounds[:-1][words > 0])
        return pa.table({"id": group.column("id"), "n_words": pa.array(words), "log_score": pa.array(score),
                         "mean_log_score": pa.array(np.divide(score, words, where=words > 0, out=np.zeros(len(words))),
                                                    mask=words == 0)})

    return exchange.ask(chunks, request, lambda kind, asked: totals(asked), finish, schema) \
        .withColumnRenamed("id", id_col)

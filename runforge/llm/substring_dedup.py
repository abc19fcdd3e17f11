"""Substring dedup: repeated runs of sentences and repeated runs of words are removed.

A text is cut into sentences, after ``.``, ``!`` or ``?`` before white space, and at
line breaks. A span is a shortest run of consecutive sentences with at least
``min_sentences`` sentences and ``min_words`` words, or with ``long_words`` words in
fewer sentences: from each sentence the shortest one that starts there, and the
shortest one that ends there. Spans are compared by a 128-bit hash of their words.
The first occurrence of a span is the one of the smallest (id, sentence); all
sentences that another occurrence covers are removed, with the white space after
them. A repeated passage that holds a span is therefore removed everywhere but in its
first place, whole sentences at a time.

A repeat need not hold whole sentences: it may begin and end within some, lie next to
an edited word or in a text without sentence ends. With ``word_runs`` (as the
registered query has it) runs of ``long_words`` words are compared too, wherever they begin; of every ``DRAWN`` that follow each other the one
of least hash, so that equal passages give equal runs. All words that a run covers
outside its first place are removed, with the white space after them. A passage of
``long_words + DRAWN - 1`` words that stands elsewhere always holds such a run, and
less than ``DRAWN`` words of it stay at each edge. Other shorter repeats stay.

Chunks ask for their distinct spans once (see ``exchange``), so that a passage that
every document holds is one entry a chunk, not one a document. Texts shuffle once.

Cases: null texts are empty and stay empty; rows of the same id count as one document
(the first place of a span is then in each of them); a null id is ordered by a hash
of its text; a text that repeats wholly becomes empty; an empty table gives an empty
result; a text of one sentence is a span if it has ``long_words`` words.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.llm import exchange
from runforge.llm.common import mix, one, prepare, strings, whole_text

#: What ends a sentence, with the white space after it.
END = re.compile(r"[.!?]\s+|\n\s*")
BASE = 0x9E3779B97F4A7C15
WORD = re.compile(r"\S+")
#: Of so many runs of words that follow each other one is compared.
DRAWN = 11
INVERSE = pow(BASE, -1, 1 << 64)
#: What a chunk says of a span beside its low hash: the high hash and its first place here.
PLACE = np.dtype([("high", "<u8"), ("id", "<i8"), ("at", "<i4")])


def cut(text: str) -> list[str]:
    """The sentences, each with the white space after it; joined they are the text."""
    ends = [0, *(m.end() for m in END.finditer(text))]
    if ends[-1] < len(text):
        ends.append(len(text))
    return [text[a:b] for a, b in zip(ends, ends[1:])]


def minimal_runs(words: np.ndarray, min_sentences: int, min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of each span of a text, given its sentences' words."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    # the last sentence of the shortest run that starts at each sentence
    enough = np.maximum(np.searchsorted(total, total[:-1] + min_words) - 1, at + min_sentences - 1)
    last = np.minimum(enough, np.searchsorted(total, total[:-1] + long_words) - 1)
    ahead = last < n
    # the first sentence of the shortest run that ends at each sentence
    enough = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, at - min_sentences + 1)
    first = np.maximum(enough, np.searchsorted(total, total[1:] - long_words, side="right") - 1)
    back = first >= 0
    runs = np.unique(np.concatenate([at[ahead] * n + last[ahead], first[back] * n + at[back]]))
    return runs // max(n, 1), runs % max(n, 1)


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]), dtype=np.uint64)


class Runs:
    """Occurrences of runs in a chunk's texts: document, first and last unit, two 64-bit hashes."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.doc, self.first, self.last, self.low, self.high = ids, doc, first, last, low, high
        # occurrences in order of hash, then place; the first of each hash starts a group
        self.order = np.lexsort((self.first, self.ids[self.doc], self.high, self.low))
        lo, hi = self.low[self.order], self.high[self.order]
        self.starts = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])[:len(lo)])
        self.group = np.cumsum(np.bincount(self.starts, minlength=len(lo))[:len(lo)]) - 1

    def keys(self) -> np.ndarray:
        return self.low[self.order[self.starts]]

    def places(self) -> np.ndarray:
        firsts = self.order[self.starts]
        out = np.zeros(len(firsts), dtype=PLACE)
        out["high"], out["id"], out["at"] = self.high[firsts], self.ids[self.doc[firsts]], self.first[firsts]
        return out


class Spans:
    """A chunk's texts cut into sentences, and their spans and word runs."""

    def __init__(self, group: pa.Table, rule: tuple[int, int, int], word_runs: bool):
        from xxhash import xxh3_128_intdigest, xxh64_intdigest
        texts = one(group.column("text")).to_pylist()
        self.cuts = [cut(x) for x in texts]
        ids = one(group.column("id")).to_pylist()
        self.ids = np.array([np.uint64(xxh64_intdigest(t)).astype(np.int64) if i is None else i
                             for i, t in zip(ids, texts)], dtype=np.int64)
        found, low, high, mask = [], [], [], (1 << 64) - 1
        words: list[str] = []
        self.sizes = []  # words of each sentence
        most = max(map(len, self.cuts), default=0)
        ups, downs = powers(BASE, most), powers(INVERSE, most)
        for d, sentences in enumerate(self.cuts):
            split = [x.split() for x in sentences]
            self.sizes.append(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
            words += chain.from_iterable(split) if word_runs else ()
            a, b = minimal_runs(self.sizes[-1], *rule)
            if not len(a):
                continue
            whole = [xxh3_128_intdigest(" ".join(x)) for x in split]
            up, down = ups[:len(split)], downs
            for half, out in (([x & mask for x in whole], low), ([x >> 64 for x in whole], high)):
                # a run's hash: its sentences' hashes times powers from its own first sentence on
                sums = np.concatenate([[np.uint64(0)], np.cumsum(np.array(half, dtype=np.uint64) * up, dtype=np.uint64)])
                out.append(mix((sums[b + 1] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
            found.append(np.stack([np.full(len(a), d), a, b]))
        none = np.zeros((3, 0), dtype=np.int64)
        doc, first, last = np.concatenate(found, axis=1) if found else none
        self.sentences = Runs(self.ids, doc, first, last, np.concatenate(low) if low else none[0].astype(np.uint64),
                              np.concatenate(high) if high else none[0].astype(np.uint64))
        self.words = self.word_runs(words, rule[2])

    def word_runs(self, words: list[str], length: int) -> Runs:
        """Of every ``DRAWN`` runs of ``length`` words that follow each other, the one of least hash."""
        from xxhash import xxh3_128_digest
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        halves = np.frombuffer(b"".join(map(xxh3_128_digest, strings(coded.dictionary))), dtype=">u8").reshape(-1, 2)
        index, n = np.asarray(coded.indices), max(len(words) - length + 1, 0)
        up, down = powers(BASE, len(words)), powers(INVERSE, len(words))
        hashes = []
        for half in (halves[:, 1], halves[:, 0]):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(half.astype(np.uint64)[index] * up[:-1], dtype=np.uint64)])
            hashes.append(mix((sums[length:] - sums[:-length])[:n] * down[:n]) if n else np.zeros(0, dtype=np.uint64))
        bounds = np.cumsum([0] + [int(x.sum()) * bool(words) for x in self.sizes])
        doc = np.repeat(np.arange(len(self.sizes)), np.diff(bounds))
        windows = np.flatnonzero(bounds[doc + 1][:n] - np.arange(n) >= length + DRAWN - 1)
        at = np.zeros(0, dtype=np.int64)
        if len(windows):
            least = np.lib.stride_tricks.sliding_window_view(hashes[0], DRAWN)
            at = np.unique(np.concatenate([some + least[some].argmin(axis=1) for some in
                                           (windows[k:k + 65536] for k in range(0, len(windows), 65536))]))
        first = at - bounds[doc[at]]
        return Runs(self.ids, doc[at], first, first + length - 1, hashes[0][at], hashes[1][at])


def elsewhere(asked: list[tuple[np.ndarray, bytes]]) -> list[bytes]:
    """For each asked span whether its first place is another chunk's, as bits, then the ids of those places."""
    keys = np.concatenate([k for k, _ in asked])
    places = np.concatenate([np.frombuffer(exchange.expand(x), dtype=PLACE) for _, x in asked])
    order = np.lexsort((places["at"], places["id"], places["high"], keys))
    k, p = keys[order], places[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (p["high"][1:] != p["high"][:-1])])
    first = p[np.flatnonzero(new)][np.cumsum(new) - 1]
    other, ids = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    other[order] = (first["id"] != p["id"]) | (first["at"] != p["at"])
    ids[order] = first["id"]
    cuts = np.cumsum([0] + [len(x) for x, _ in asked])
    return [np.packbits(other[a:b]).tobytes() + ids[a:b][other[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def covered(runs: Runs, sizes: list[int], other: np.ndarray, first_ids: np.ndarray):
    """For each document of so many units, which of them go and the ids where their runs come first."""
    firsts = runs.order[runs.starts][runs.group]
    # another place in this chunk; rows of one id have one first place
    gone = other[runs.group] | (runs.ids[runs.doc[runs.order]] != runs.ids[runs.doc[firsts]]) | (runs.first[runs.order] != runs.first[firsts])
    home = np.where(other, first_ids, runs.ids[runs.doc[runs.order[runs.starts]]] if len(runs.starts) else 0)
    rows = runs.order[gone]
    sources = home[runs.group[gone]]
    by = np.argsort(runs.doc[rows], kind="stable")
    rows, sources = rows[by], sources[by]
    bounds = np.searchsorted(runs.doc[rows], np.arange(len(sizes) + 1))
    for d, n in enumerate(sizes):
        a, b = bounds[d], bounds[d + 1]
        if a == b:
            yield np.zeros(n, dtype=bool), []
            continue
        depth = np.zeros(n + 1, dtype=np.int64)
        np.add.at(depth, runs.first[rows[a:b]], 1)
        np.add.at(depth, runs.last[rows[a:b]] + 1, -1)
        yield np.cumsum(depth[:-1]) > 0, np.unique(sources[a:b]).tolist()


def without(sentence: str, gone: np.ndarray) -> str:
    """A sentence less the words that go, each with the white space after it."""
    starts = [m.start() for m in WORD.finditer(sentence)]
    ends = [*starts[1:], len(sentence)]
    return sentence[:starts[0]] + "".join(sentence[a:b] for a, b, g in zip(starts, ends, gone.tolist()) if not g)


def kept(sentences: list[str], sizes: np.ndarray, gone: np.ndarray, words: np.ndarray) -> tuple[str, int]:
    """What remains of a text, and the sentences that are removed or shortened."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hit = np.diff(np.concatenate([[0], np.cumsum(words)])[bounds]) > 0
    parts = [without(x, words[a:b]) if h else x for x, g, h, a, b in
             zip(sentences, gone.tolist(), hit.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()) if not g]
    return "".join(parts), int((gone | hit).sum())


def remove_repeats(df: DataFrame, min_sentences: int = 3, min_words: int = 20, long_words: int = 40,
                   word_runs: bool = False, chunk_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with what remains of the text and a struct ``_spans``.

    With ``word_runs`` also without repeated passages inside sentences. The id is an integer. ``_spans`` (replaced if ``df`` has it): n_sentences, n_removed (in whole or part), removed_chars, first_ids (the ids of the
    documents where the removed spans come first, ascending, each once).
    """
    prepare(df.sparkSession)
    rule = (min_sentences, min_words, long_words)
    columns = [c for c in df.columns if c != "_spans"]
    others = [F.col(c) for c in columns if c != text_col]
    rows = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"),
                     F.struct(*others).alias("row"))
    chunks, buckets = exchange.chunked(rows, chunk_bytes)
    report = T.StructType([T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("removed_chars", T.LongType()),
                           T.StructField("first_ids", T.ArrayType(T.LongType()))])
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("spans", report)])
    arrow_report = pa.struct([("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed_chars", pa.int64()),
                              ("first_ids", pa.list_(pa.int64()))])

    def request(group: pa.Table) -> list[dict]:
        spans = Spans(group, rule, word_runs)
        made = []
        for kind, runs in enumerate((spans.sentences, spans.words)):
            places = runs.places()
            made += exchange.requests(kind, runs.keys(), lambda a, b: exchange.squeeze(places[a:b].tobytes()), buckets)  # noqa: B023
        return made

    def told(runs: Runs, answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        bounds = exchange.bucket_bounds(runs.keys(), buckets)
        n = len(runs.starts)
        other, ids = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        at = 0
        for size, data in zip([x for x in np.diff(bounds).tolist() if x], exchange.answers_of(answers, kind)):
            bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=(size + 7) // 8))[:size].astype(bool)
            other[at:at + size] = bits
            ids[at:at + size][bits] = np.frombuffer(data, dtype=np.int64, offset=(size + 7) // 8)
            at += size
        return other, ids

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        spans = Spans(group, rule, word_runs)
        texts, reports = [], []
        by_sentence = covered(spans.sentences, [len(x) for x in spans.cuts], *told(spans.sentences, answers, 0))
        by_word = covered(spans.words, [int(x.sum()) for x in spans.sizes], *told(spans.words, answers, 1))
        for sentences, sizes, (gone, firsts), (words, more) in zip(spans.cuts, spans.sizes, by_sentence, by_word):
            text, removed = kept(sentences, sizes, gone, words) if firsts or more else ("".join(sentences), 0)
            texts.append(text)
            reports.append({"n_sentences": len(sentences), "n_removed": removed,
                            "removed_chars": sum(map(len, sentences)) - len(text), "first_ids": sorted({*firsts, *more})})
        return pa.table({"row": group.column("row"), "text": pa.array(texts, pa.string()),
                         "spans": pa.array(reports, arrow_report)})

    done = exchange.ask(chunks, request, lambda kind, asked: elsewhere(asked), finish, schema)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns],
                       F.col("spans").alias("_spans"))

"""Packing: documents' tokens into sequences of equal capacity and balanced cost.

Attention over a piece of L tokens costs ``linear * L + quadratic * L * L``. Within
a window of about ``window_tokens`` tokens the documents are assigned in descending
length, each to the sequence of lowest cost so far that has room for it. A document
longer than a sequence gives whole sequences first; one that fits nowhere any more
is cut over the lowest-cost sequences with room. The sequences of a window hold its
tokens exactly: as many full ones as there are, and powers of two for the rest, so
that nothing is padded.

A task packs the rows of its own partition window by window, so nothing shuffles and
a task holds one window of ids. Sequence numbers are the partition's number times
2^32, plus a count; the pieces of a task that runs again are the same.

Cases: a null or empty text is one token, the end; a document longer than a window is
a window by itself; rows of equal id are separate documents; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runforge.llm.common import blocks, id_and_text, one, prepare, ragged, resource, schema_of, strings, words_of

#: Words whose ids a worker remembers, in two generations: about 100 MB.
REMEMBERED = 400_000
#: ASCII marks that are a pre-token of their own behind letters (an apostrophe may begin another one).
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class WordEncoder:
    """A tokenizer that drops white space, applied to distinct white-space words.

    For tokenizers of the kind of ``word_bpe_49k.json``: no token spans white space
    and none depends on it, so a text's ids are its words' ids in order. ``marker``
    starts every special token of the vocabulary; texts that hold it are encoded whole.
    """

    def __init__(self, path: str, marker: str = "<|", separator: str = "<|endoftext|>"):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.marker, self.separator = marker, separator
        self.between = self.tokenizer.token_to_id(separator)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # byte-level vocabularies write a byte that is no printable character as 256 and on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: 256 + k for k, b in enumerate(hidden)}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Adds unknown words, in ASCII lower case.

        Latin letters are normal text and one pre-token, which goes to the vocabulary's merges
        at once, and the marks behind them are another; so a word of both is its letters' ids
        and its marks' ids. Other words are encoded many in one call, a special token between.
        """
        known, merge = self.known, self.tokenizer.model.tokenize
        mixed, marked = [], []
        for word in words:
            letters = word.rstrip(MARKS)
            if not letters.isalpha():
                mixed.append(word)
                continue
            if (ids := known.get(letters)) is None:
                shown = letters
                if not letters.isascii():
                    shown = letters.lower()
                    if max(shown) >= "\u0250":
                        mixed.append(word)
                        continue
                    shown = shown.encode().decode("latin-1").translate(self.bytes)
                ids = known[letters] = array("I", [x.id for x in merge(shown)]).tobytes()
            if len(letters) < len(word):
                marks = word[len(letters):]
                if (more := known.get(marks)) is not None:
                    known[word] = ids + more
                else:
                    marked.append((word, ids, marks))
                    mixed.append(marks)
        mixed = list(dict.fromkeys(mixed))
        for k in range(0, len(mixed), 4096):
            ids = self.whole(self.separator.join(mixed[k:k + 4096]))
            cuts = np.concatenate([[-1], np.flatnonzero(ids == self.between), [len(ids)]])
            for word, a, b in zip(mixed[k:k + 4096], cuts[:-1] + 1, cuts[1:]):
                self.known[word] = ids[a:b].tobytes()
        for word, ids, marks in marked:
            self.known[word] = ids + self.known[marks]

    def words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED // 2:  # words that go on occurring come back from the older half
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, words))
        if missing := [i for i, x in enumerate(found) if x is None]:
            new = []
            for i in missing:
                if (ids := self.older.get(words[i])) is None:
                    new.append(words[i])
                else:
                    self.known[words[i]] = ids
            self._learn(new)
            for i in missing:
                found[i] = self.known[words[i]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of many texts, and the position of each text's first, with the total at the end."""
        special = np.asarray(pc.match_substring(texts, self.marker).fill_null(False))
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        index, bounds, distinct = words_of(pc.ascii_lower(plain))
        coded = self.words(strings(distinct))
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), dtype=np.uint32)
        ids = flat[ragged((np.cumsum(sizes) - sizes)[index], sizes[index])]
        ends = np.concatenate([[0], np.cumsum(sizes[index])])[bounds]
        if not special.any():
            return ids, ends
        parts = [self.whole(texts[i].as_py()) if special[i] else ids[ends[i]:ends[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def capacities(total: int, capacity: int) -> np.ndarray:
    """Full sequences, then powers of two, that hold ``total`` tokens exactly."""
    full, rest = divmod(total, capacity)
    return np.array([capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1],
                    dtype=np.int64)


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that place every token once."""
    room = capacities(int(lengths.sum()), capacity)
    size, cost = room.copy(), np.zeros(len(room))
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, length: int, k: int) -> None:
        pieces.append((doc, start, length, k, int(size[k] - room[k])))
        room[k] -= length
        cost[k] += linear * length + quadratic * length * length

    whole = 0
    rest: list[tuple[int, int, int]] = []
    for doc in np.argsort(-lengths, kind="stable").tolist():
        length, start = int(lengths[doc]), 0
        while length - start >= capacity:
            put(doc, start, capacity, whole)
            start, whole = start + capacity, whole + 1
        if length > start:
            rest.append((length - start, doc, start))
    for length, doc, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        k = int(np.where(room >= length, cost, np.inf).argmin())
        while room[k] < length:
            k = int(np.where(room > 0, cost, np.inf).argmin())
            if (part := int(room[k])) < length:
                put(doc, start, part, k)
                start, length = start + part, length - part
                k = int(np.where(room >= length, cost, np.inf).argmin())
        put(doc, start, length, k)
    return np.array(pieces, dtype=np.int64).reshape(-1, 5)


def pack(df: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = 4096,
         linear: float = 1.0, quadratic: float = 1 / 4096, window_tokens: int = 2_000_000,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    The piece is ``length`` ids of the document from ``start`` on, and lies at
    ``offset`` of its sequence, which holds ``sequence_tokens`` in all.
    """
    prepare(df.sparkSession)
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")
    schema = schema_of(df, id_col, *((n, T.LongType()) for n in names))

    def packed(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray, first: int) -> pa.RecordBatch:
        lengths = np.diff(bounds)
        doc, start, length, k, offset = assign(lengths, capacity, linear, quadratic).T
        crc = [zlib.crc32(ids[a:a + n]) for a, n in zip((bounds[doc] + start).tolist(), length.tolist())]
        held = np.bincount(k, weights=length).astype(np.int64)
        columns = (start, length, np.array(crc, dtype=np.int64), lengths[doc], first + k, offset, held[k])
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), *map(pa.array, columns)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first = encoder(resource(vocabulary)), TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def window() -> pa.RecordBatch:
            nonlocal first, held
            lengths = np.concatenate([np.diff(b) for _, _, b in held])
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            out = packed(pa.concat_arrays([x for x, _, _ in held]), np.concatenate([x for _, x, _ in held]), bounds, first)
            first, held = first + len(capacities(int(bounds[-1]), capacity)), []
            return out

        for block in blocks(batches, 6 << 20):
            ids, bounds = code.encode(one(block.column(1)))
            lengths = np.diff(bounds)
            closed = np.full(len(ids) + len(lengths), end_id, dtype=np.uint32)  # the end stays where no id goes
            ends = bounds + np.arange(len(bounds))
            closed[ragged(ends[:-1], lengths)] = ids
            held.append((one(block.column(0)), closed, ends))
            if sum(len(x) for _, x, _ in held) >= window_tokens:
                yield window()
        if held:
            yield window()

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)

r"""SentencePiece encoding and decoding by batched Viterbi.

A text is written as SentencePiece writes it: one space in front, spaces as ``▁``. It
is encoded with the pieces of highest total score, of equal ones the path whose last
piece is longest, and so on backwards. No piece of the vocabulary has ``▁`` after
another character (checked when it is loaded), so no piece reaches over such a place,
and the text is the sequence of its words: runs of ``▁`` with what follows them.

The distinct words of a block of texts are encoded together, all words of a length at
once: a matrix of code points gives prefix hashes; the hashes of all substrings that
end at a position probe the sorted hashes of the pieces; and a maximum over them
stores each word's best score and backpointer there. Characters that no piece holds
become the byte pieces of their UTF-8 form, at a score below all pieces.

Decoding joins the pieces' bytes and drops the space in front. It returns the text
unless the text holds ``▁`` itself, which is read as a space, as the library does.

Cases: null and empty texts have no pieces, and none decode to the empty text;
repeated rows are encoded row by row; an empty table gives an empty result. A word takes
some 45 bytes a character while it is encoded (a text without U+0020 is one word), and
one of more than ``LONG`` characters is not remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.llm.common import blocks, id_and_text, one, prepare, ragged, resource, schema_of, strings

SPACE = "▁"
BASE = np.uint64(0x100000001B3)
ODD, MAYBE_BITS = np.uint64(0x9E3779B97F4A7C15), 18
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Cells of a length's matrices at once, and words that a worker remembers.
CELLS = 1 << 19
REMEMBERED = 300_000
LONG = 1000


def rolling(points: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row of code points; column k covers the first k."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), dtype=np.uint64)
    for k in range(points.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + points[:, k] + np.uint64(1)
    return out


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


class Pieces:
    """The pieces of a vocabulary file with their scores."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        kinds = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(names))]
        normal = [i for i, other in enumerate(kinds) if not other]
        if any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in normal):
            raise ValueError("a piece reaches over a word's start")
        self.bytes = {int(names[i][1:-1], 16): i for i in range(len(names)) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        lengths = np.array([len(names[i]) for i in normal])
        hashes = np.zeros(len(normal), dtype=np.uint64)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            hashes[at] = rolling(code_points([names[normal[k]] for k in at]))[:, -1] + np.uint64(n) * BASE
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(normal)[order]
        self.maybe = np.zeros(1 << MAYBE_BITS, dtype=bool)
        self.maybe[hashes * ODD >> np.uint64(64 - MAYBE_BITS)] = True
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.scores = np.array([sp.get_score(int(i)) for i in self.ids])
        self.longest = int(lengths.max())
        self.missing = float(self.scores.min()) - 10.0
        spelled = [bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else b"" if kinds[i] and i != self.unknown
                   else b" \xe2\x81\x87 " if i == self.unknown else names[i].replace(SPACE, " ").encode() for i in range(len(names))]
        self.sizes = np.array([len(x) for x in spelled])
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.known: dict[str, bytes] = {}

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the piece with each hash, and whether there is one; a bitmap spares most others the search."""
        at, found = np.zeros(hashes.shape, dtype=np.int64), self.maybe[hashes * ODD >> np.uint64(64 - MAYBE_BITS)]
        some = hashes[found]
        place = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        at[found], found[found] = place, self.hashes[place] == some
        return at, found

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, as bytes."""
        points = code_points(words)
        n, length = points.shape
        prefix = rolling(points)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]), dtype=np.uint64)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, length + 1), dtype=np.int32)
        piece = np.zeros((n, length + 1), dtype=np.int32)
        rows = np.arange(n)
        for end in range(1, length + 1):
            starts = np.arange(max(end - self.longest, 0), end)  # longest piece first: it wins among equals
            sizes = end - starts
            at, found = self.probe(prefix[:, end, None] - prefix[:, starts] * power[sizes] + sizes.astype(np.uint64) * BASE)
            score = np.where(found, best[:, starts] + self.scores[at], -np.inf)
            alone = ~found[:, -1]
            score[alone, -1] = best[alone, end - 1] + self.missing
            choice = score.argmax(axis=1)
            best[:, end], back[:, end] = score[rows, choice], starts[choice]
            piece[:, end] = np.where(found[rows, choice], self.ids[at[rows, choice]], -1)
        # all words step back together; a step's pieces and ends are a column
        taken, ends = np.full((n, length), -1, dtype=np.int32), np.zeros((n, length), dtype=np.int32)
        here, count = np.full(n, length), np.zeros(n, dtype=np.int64)
        live = rows
        while live.size:
            at = here[live]
            taken[live, count[live]], ends[live, count[live]] = piece[live, at], at
            count[live] += 1
            here[live] = back[live, at]
            live = live[here[live] > 0]
        steps = ragged(np.zeros(n, dtype=np.int64), count)
        row = np.repeat(rows, count)
        flat = taken[row, np.repeat(count - 1, count) - steps]
        data, bounds = flat.tobytes(), np.concatenate([[0], np.cumsum(count)]) * 4
        out = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in np.unique(row[flat < 0]).tolist():  # words with a character that no piece holds
            ids: list[int] = []
            for k in range(int(count[i]) - 1, -1, -1):
                if taken[i, k] >= 0:
                    ids.append(int(taken[i, k]))
                else:
                    spelled = words[i][ends[i, k] - 1].encode()
                    ids += [self.bytes.get(b, self.unknown) for b in spelled] if self.bytes else [self.unknown]
            out[i] = np.array(ids, dtype=np.int32).tobytes()
        return out

    def learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for length, same in by_length.items():
            step = max(CELLS // (length + self.longest), 1)
            for k in range(0, len(same), step):
                self.known.update(zip(same[k:k + step], self.viterbi(same[k:k + step])))

    def forget(self, words: list[str]) -> None:
        for word in words:
            self.known.pop(word, None)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of many texts, and the position of each text's first, with the total at the end."""
        # between single spaces a word is a space and a part; other texts are cut by the pattern
        odd = np.asarray(pc.match_substring_regex(texts, f"^ |  | $|{SPACE}").fill_null(False))
        parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        bounds = np.asarray(parts.offsets)[: len(parts) + 1].astype(np.int64)
        bounds = bounds - bounds[0]
        coded = parts.flatten().dictionary_encode()
        words = [SPACE + x if x else "" for x in strings(coded.dictionary)]
        cut = {i: WORD.findall(SPACE + texts[i].as_py().replace(" ", SPACE)) for i in np.flatnonzero(odd).tolist()}
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        self.known[""] = b""
        long = [w for x in ([words], cut.values()) for y in x for w in y if len(w) > LONG]
        self.learn(list({w for w in words if w not in self.known} | {w for x in cut.values() for w in x if w not in self.known}))
        ids_of = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, ids_of), dtype=np.int64, count=len(ids_of)) // 4
        flat = np.frombuffer(b"".join(ids_of), dtype=np.int32)
        index = np.asarray(coded.indices)
        ids = flat[ragged((np.cumsum(sizes) - sizes)[index], sizes[index])]
        ends = np.concatenate([[0], np.cumsum(sizes[index])])[bounds]
        if not cut:
            self.forget(long)
            return ids, ends
        own = {i: np.frombuffer(b"".join(map(self.known.__getitem__, x)), dtype=np.int32) for i, x in cut.items()}
        self.forget(long)
        every = [own[i] if i in own else ids[ends[i]:ends[i + 1]] for i in range(len(texts))]
        return np.concatenate(every), np.concatenate([[0], np.cumsum([len(x) for x in every])])

    def decode(self, ids: np.ndarray) -> str:
        known = (ids >= 0) & (ids < len(self.sizes))
        ids = np.where(known, ids, self.unknown)
        sizes = self.sizes[ids]
        text = self.spelled[ragged((np.cumsum(self.sizes) - self.sizes)[ids], sizes)].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(df: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of each row; no shuffle."""
    prepare(df.sparkSession)
    schema = schema_of(df, id_col, ("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(resource(vocabulary))
        for block in blocks(batches, 4 << 20):
            texts = one(block.column(1))
            ids, bounds = pieces.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            made = pa.RecordBatch.from_arrays([one(block.column(0)), lists], names=schema.names)
            for k in range(0, made.num_rows, 500):
                yield made.slice(k, 500)

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) of each row of piece ids; null ids are no pieces."""
    prepare(df.sparkSession)
    schema = schema_of(df, id_col, (ids_col, T.ArrayType(T.IntegerType())), ("text", T.StringType()))
    none = F.array().cast("array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(resource(vocabulary))
        for batch in batches:
            texts = [pieces.decode(np.asarray(x.values, dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=schema.names)

    given = F.transform(F.coalesce(F.col(ids_col), none), lambda x: F.coalesce(x.cast("int"), F.lit(-1)))
    return df.select(F.col(id_col), given.alias(ids_col)).mapInArrow(run, schema)

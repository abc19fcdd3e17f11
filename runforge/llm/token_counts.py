"""Token counts: the counts a SentencePiece BPE model gives to whole texts.

Texts up to ``chunk_chars`` are encoded as they are. A longer text is encoded in
overlapping chunks, each token with its character span. Two neighbouring chunks
are spliced after a token that both have with the same span.

Why the splice is exact. BPE merges the best adjacent pair first (score, then
leftmost), and a merge changes nothing outside its two symbols. Take the first
merge that would join symbols over a boundary between two tokens of a spliced
sequence: up to then all merges lay within tokens, so the same merges happen when
these two tokens' text is encoded alone, and so would the joining one. Hence a
token sequence is the encoding of its text if every adjacent pair of it is
adjacent in the encoding of some text. All pairs left of the common token come
from the left chunk, it and its follower from the right one. When no token of the
overlap is common, the overlap is doubled, up to one encoding of both chunks.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from runforge.llm.common import id_and_text, in_blocks, prepare, resource, schema_of

_MODELS: dict = {}


def model(path: str):
    """(processor, characters of each id) of a model file, once per worker."""
    if path not in _MODELS:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = np.zeros(sp.get_piece_size(), dtype=np.int64)
        for i in range(len(size)):
            if sp.is_byte(i):  # a character is counted at its first byte
                size[i] = not 0x80 <= int(sp.id_to_piece(i)[1:-1], 16) < 0xC0
            elif not sp.is_control(i):
                size[i] = len(sp.id_to_piece(i))
        _MODELS[path] = sp, size
    return _MODELS[path]


def spans(sp, size: np.ndarray, text: str, start: int, stop: int):
    """(first, last) character of each token of ``text[start:stop]``; None if the model changes characters."""
    ends = np.cumsum(size[np.asarray(sp.encode(text[start:stop], num_threads=1), dtype=np.int64)]) + start - 1
    if len(ends) and ends[-1] != stop:  # the model puts one space in front
        return None
    return np.concatenate([[start - 1], ends])[:len(ends)], ends


def common_token(left, right) -> tuple[int, int] | None:
    """Places, in both, of the middle one of the tokens that they share with the same span.

    Tokens that span nothing are the later bytes of a character: no splice there. The
    first token of the right chunk holds the space that the model puts in front.
    """
    li, ri = np.flatnonzero(left[1] > left[0]), 1 + np.flatnonzero(right[1][1:] > right[0][1:])
    _, i, j = np.intersect1d((left[0][li] << 32) | (left[1][li] - left[0][li]),
                             (right[0][ri] << 32) | (right[1][ri] - right[0][ri]),
                             assume_unique=True, return_indices=True)
    # the next token must start a character too, in either encoding
    fit = [(a, b) for a, b in zip(li[i], ri[j]) if starts_character(left, a) and starts_character(right, b)]
    return tuple(map(int, fit[len(fit) // 2])) if fit else None


def starts_character(tokens, k: int) -> bool:
    """Whether the token after the k-th starts a character."""
    return k + 1 >= len(tokens[0]) or tokens[1][k + 1] > tokens[0][k + 1]


def count_long(sp, size: np.ndarray, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text, encoded chunk by chunk.

    Up to ``stop`` the text is ``done`` tokens and then those of ``left``.
    """
    stop, done = min(chunk, len(text)), 0
    left = spans(sp, size, text, 0, stop)
    while left is not None and stop < len(text):
        to, wide, right = min(stop + chunk, len(text)), overlap, None
        while right is None:
            start = max(stop - wide, 0)
            encoded = spans(sp, size, text, start, to)
            if encoded is None:
                return len(sp.encode(text, num_threads=1))
            at = common_token(left, encoded)
            if start == 0:  # widened to the whole text so far, so nothing is spliced
                done, right = 0, encoded
            elif at:
                done, right = done + at[0] + 1, (encoded[0][at[1] + 1:], encoded[1][at[1] + 1:])
            wide = wide * 3 // 2 + 1  # odd steps, so that texts of one repeated piece line up too
        left, stop = right, to
    return len(sp.encode(text, num_threads=1)) if left is None else done + len(left[0])


def count_tokens(df: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096,
                 chunk_chars: int = 32768, overlap_chars: int = 256,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, with no shuffle.

    ``vocabulary`` is a file name of the installed vocabularies or a path that all
    executors have. ``over_limit``: more than ``limit`` tokens.
    """
    prepare(df.sparkSession)
    schema = schema_of(df, id_col, ("n_bytes", T.LongType()), ("n_tokens", T.LongType()),
                       ("over_limit", T.BooleanType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, size = model(resource(vocabulary))
        for batch in batches:
            texts = batch.column(1)
            counts = np.zeros(len(texts), dtype=np.int64)
            for a, b in in_blocks(texts, 1 << 20):
                part = texts.slice(a, b - a).to_pylist()
                short = [i for i, x in enumerate(part) if len(x) <= chunk_chars]
                for i, ids in zip(short, sp.encode([part[i] for i in short], num_threads=1)):
                    counts[a + i] = len(ids)
                for i, x in enumerate(part):
                    if len(x) > chunk_chars:
                        counts[a + i] = count_long(sp, size, x, chunk_chars, overlap_chars)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)],
                names=schema.names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)

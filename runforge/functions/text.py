"""Text helpers shared by the corpus operators: word splitting and special ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# One explicit whitespace class, valid in both Java regex and RE2,
# so the Spark job and the SQL oracle agree outside ASCII (Python isspace set).
WS_CLASS = (r"[\t-\r\x1C-\x20\x85\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
            r"\x{202F}\x{205F}\x{3000}]")

# Special token ids of the corpus vocabulary; words start at FIRST_WORD_ID.
PAD_ID, CLS_ID, SEP_ID, EOS_ID, MASK_ID, UNK_ID = 0, 1, 2, 3, 4, 5
FIRST_WORD_ID = 6


def word_tokens(text: str | Column) -> Column:
    """Whitespace-separated words of ``text`` (empty pieces removed)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, WS_CLASS + "+"), lambda x: x != F.lit(""))


def non_ws_chars(text: str | Column) -> Column:
    """Number of non-whitespace characters (code points) in ``text``."""
    t = F.col(text) if isinstance(text, str) else text
    return F.length(F.regexp_replace(t, WS_CLASS, ""))


# The characters of WS_CLASS as UTF-8: single bytes, and the longer ones by length.
_WS_CHARS = [chr(c) for a, b in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                                 (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(a, b + 1)]
_WS_BYTE = np.isin(np.arange(256), [ord(c) for c in _WS_CHARS if ord(c) < 0x80])
_WS_LONG = {n: np.array([int.from_bytes(c.encode(), "big") for c in _WS_CHARS if len(c.encode()) == n]) for n in (2, 3)}


def arrow_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of an Arrow batch of texts, split as :func:`word_tokens` does, in one array, and
    how many of them lie before each text and at the end (a null text has none)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, places, content = texts.buffers()
    at = np.frombuffer(places, np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(content, np.uint8)[at[0]:at[-1]] if content is not None else np.zeros(0, np.uint8)
    at = at.astype(np.int64) - at[0]
    inside = ~_WS_BYTE[data]
    for n, chars in _WS_LONG.items():
        lead = np.flatnonzero(np.isin(data[:len(data) - n + 1], np.unique(chars >> 8 * (n - 1)).astype(np.uint8)))
        whole = sum(data[lead + i].astype(np.int64) << 8 * (n - 1 - i) for i in range(n))
        for i in range(n):
            inside[lead[np.isin(whole, chars)] + i] = False
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    begins[heads] = inside[heads]
    content = data[inside]
    ends = np.append(np.flatnonzero(begins[inside]), len(content)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(content))
    return words, np.searchsorted(np.flatnonzero(begins), at)


def human_size(n: Column) -> Column:
    """Readable parameter count: strict '>' thresholds; > 1e9 -> '%.2fB',
    > 1e6 -> '%.1fM', > 1e3 -> '%.1fK', else '<n>B'."""
    x = n.cast("double")
    return (F.when(n > 1_000_000_000, F.format_string("%.2fB", x / 1e9))
            .when(n > 1_000_000, F.format_string("%.1fM", x / 1e6))
            .when(n > 1_000, F.format_string("%.1fK", x / 1e3))
            .otherwise(F.concat(n.cast("string"), F.lit("B"))))

"""Corpus projections, filters and per-record measures.

Corpus rows carry ``dataset``, ``row_idx``, ``doc_id``, ``mime_type``, ``text``
and, once tokenized, ``tokens`` (array<int>). Everything but the vocabulary lookup
is a DataFrame expression; the only shuffles are the vocabulary count and that lookup.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.functions.indexing import sorted_positions
from runforge.functions.text import (CLS_ID, FIRST_WORD_ID, MASK_ID, PAD_ID, SEP_ID, UNK_ID,
                                     arrow_words, non_ws_chars)
from runforge.session import materialize

DEFAULT_MIME = ("text/markdown", "text/plain")


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------- C1, C2
def filter_mime(df: DataFrame, types=DEFAULT_MIME, col: str = "mime_type") -> DataFrame:
    """Keep rows whose MIME type is listed (an ``IN`` filter Parquet can push down)."""
    return df.where(F.col(col).isin(list(types)))


def density_ratio(text: str | Column, tokens: str | Column) -> Column:
    """Non-whitespace characters per token; null for an empty token list."""
    tk = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.try_divide(non_ws_chars(text).cast("double"), F.size(tk).cast("double"))


def density_ratio_counted(n_non_ws: str | Column, tokens: str | Column) -> Column:
    """:func:`density_ratio` from a precomputed non-whitespace character count."""
    n = F.col(n_non_ws) if isinstance(n_non_ws, str) else n_non_ws
    tk = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.try_divide(n.cast("double"), F.size(tk).cast("double"))


def density_gate(df: DataFrame, text: str = "text", tokens: str = "tokens",
                 min_ratio: float = 2.5, n_non_ws: str | None = None) -> DataFrame:
    """Keep records with ≥ ``min_ratio`` non-whitespace characters per token.
    Empty token lists give a null ratio and are dropped (the reference skips them).
    ``n_non_ws`` names a column with the characters counted before, instead of the text."""
    ratio = density_ratio(text, tokens) if n_non_ws is None else density_ratio_counted(n_non_ws, tokens)
    return df.where(ratio >= F.lit(min_ratio))


# ---------------------------------------------------------------- C3
def build_vocab(df: DataFrame, text: str = "text", size: int | None = None) -> DataFrame:
    """Word vocabulary ranked by (count desc, token asc): (token, count, id).

    ids start after the special ids; all words are kept unless ``size`` asks for the
    top entries. The words of an Arrow batch of texts are counted where they lie, and
    these counts are summed by a partial+final aggregation; the ranking is a sort over
    all tasks that is stored once, so the long tail of rare words is spread evenly.
    """
    def count(batches):
        for batch in batches:
            own = pc.value_counts(arrow_words(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([own.field("values"), own.field("counts")], names=["token", "count"])

    toks = df.select(F.col(text).cast("string")).mapInArrow(count, "token string, count bigint")
    counts = toks.groupBy("token").agg(F.sum("count").alias("count"))
    ranked = sorted_positions(counts, [], [F.desc("count"), "token"], out="_rf_rank")
    if size is not None:
        ranked = ranked.where(F.col("_rf_rank") < size)
    return ranked.select("token", "count", (F.col("_rf_rank") + FIRST_WORD_ID).cast("int").alias("id"))


#: Bytes of words in one block of documents that asks for its words together.
BLOCK_BYTES = 4 << 20
#: Words of the lowest ids that every task is told, and the bytes that such a word may have.
TOLD_WORDS, TOLD_BYTES = 1 << 17, 64


def tokenize(df: DataFrame, vocab: DataFrame, key, text: str = "text", out: str = "tokens",
             keep_text: bool = True, block_bytes: int = BLOCK_BYTES, chars: str | None = None) -> DataFrame:
    """Replace ``text`` words by vocabulary ids (unknown -> UNK) as ``out``.

    Every task is told the words of the lowest ids (at most ``TOLD_WORDS``, the most
    frequent ones of :func:`build_vocab`), which are most of any text. A first pass, stored
    when this is called, turns them into ids where the documents lie; what is left of a
    block (a run of rows with about ``block_bytes`` of words) is a list of its distinct
    other words, whose places in the tokens hold negative numbers. Only these words
    meet the vocabulary, and their ids come back to the block as one small table. What
    shuffles is each document's tokens once and a row a block and distinct rare
    word; neither words nor, with ``keep_text=False``, texts do. Documents without words get
    an empty array; a null text has none. Rows may share a key or have none. ``chars``
    names a column to add with the number of characters of a text's words
    (:func:`non_ws_chars`, null for a null text).
    """
    rows = (df if keep_text else df.drop(text)).columns
    kept = [c for c in rows if c not in (out, chars)]
    added = [] if chars is None else [T.StructField(chars, T.IntegerType())]
    known = vocab.select("token", F.col("id").cast("int").alias("id"))
    told = known.where((F.col("id") < FIRST_WORD_ID + TOLD_WORDS) & (F.octet_length("token") <= TOLD_BYTES)).limit(TOLD_WORDS).toArrow()
    told_words, told_ids = told.column("token").combine_chunks(), told.column("id").to_numpy().astype(np.int32)

    def first(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("_rf_text")
            flat, ends = arrow_words(texts)
            size = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False))])
            own = size[ends[:-1]] // block_bytes
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            at = pc.index_in(flat, value_set=told_words)
            rare = pc.is_null(at).to_numpy(zero_copy_only=False)
            ids = np.append(told_ids, np.int32(0))[pc.fill_null(at, -1).to_numpy(zero_copy_only=False)]
            asked = [None] * batch.num_rows
            for i, j in zip(starts, [*starts[1:], batch.num_rows]):
                here = slice(ends[i], ends[j])
                left = flat.slice(ends[i], ends[j] - ends[i]).filter(pa.array(rare[here])).dictionary_encode()
                ids[here][rare[here]] = -1 - left.indices.to_numpy(zero_copy_only=False)
                asked[i] = left.dictionary
            none = pa.array([x is None for x in asked])
            lengths = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in asked])])
            lists_of = [x.cast(pa.string()) for x in asked if x is not None]
            counted = []
            if chars is not None:
                n = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False))])[ends]
                counted = [pa.array(np.diff(n), pa.int32(), mask=pc.is_null(texts).to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *counted, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                 pa.array(block + np.cumsum(np.isin(np.arange(batch.num_rows), starts)) - 1, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.concat_arrays(lists_of), mask=none)],
                names=[*kept, *[f.name for f in added], out, "_rf_block", "_rf_asked"])
            block += len(starts)

    ids_type = T.StructField(out, T.ArrayType(T.IntegerType()))
    held = [*[df.schema[c] for c in kept], *added]
    stage = T.StructType([*held, ids_type, T.StructField("_rf_block", T.LongType()),
                          T.StructField("_rf_asked", T.ArrayType(T.StringType()))])
    stored = materialize(df.select(*kept, F.col(text).cast("string").alias("_rf_text")).mapInArrow(first, stage), "asking")
    asked = stored.where(F.col("_rf_asked").isNotNull()).select(F.col("_rf_block").alias("_rf_by"), F.posexplode("_rf_asked").alias("k", "token"))
    answers = asked.join(known, "token").select("_rf_by", "k", "id")
    schema = T.StructType([*held, ids_type])

    def look_up(own: pa.Table, found: pa.Table) -> pa.Table:
        lists = own.column(out).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ids = lists.flatten().to_numpy(zero_copy_only=False).copy()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        open_ = np.flatnonzero(ids < 0)
        if len(open_):
            answer = np.full(-int(ids[open_].min()), UNK_ID, np.int32)
            answer[found.column("k").to_numpy()] = found.column("id").to_numpy()
            ids[open_] = answer[-1 - ids[open_]]
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        return own.select([f.name for f in held]).append_column(out, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())))

    return stored.drop("_rf_asked").groupBy("_rf_block").cogroup(answers.groupBy("_rf_by")).applyInArrow(look_up, schema)


# ---------------------------------------------------------------- C4
def token_entropy(df: DataFrame, key, tokens: str = "tokens") -> DataFrame:
    """C4: Shannon entropy in bits of each record's token distribution (0 for none).

    H = log2(n) - (1/n) Σ c·log2(c) over token counts c, n = Σ c.
    """
    keys = _cols(key)
    ex = df.select(*keys, F.explode(tokens).alias("_rf_tok"))
    c = ex.groupBy(*keys, "_rf_tok").agg(F.count(F.lit(1)).alias("_rf_c"))
    h = c.groupBy(*keys).agg(F.sum("_rf_c").alias("_rf_n"),
                             F.sum(F.col("_rf_c") * F.log2(F.col("_rf_c"))).alias("_rf_s"))
    ent = h.select(*keys, (F.log2("_rf_n") - F.col("_rf_s") / F.col("_rf_n")).alias("entropy"))
    return (df.select(*keys).join(ent, keys, "left")
            .select(*keys, F.coalesce(F.col("entropy"), F.lit(0.0)).alias("entropy")))


# ---------------------------------------------------------------- C5, C6, C7
def chunk_tokens(df: DataFrame, size: int, tokens: str = "tokens") -> DataFrame:
    """Fixed-stride chunks of ``size`` tokens (last one short). An empty
    token list yields no chunk. Adds ``chunk_idx`` and ``chunk``."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda i: F.slice(F.col(tokens), i + 1, F.lit(size)))
    return df.select("*", F.posexplode(chunks).alias("chunk_idx", "chunk")).drop(tokens)


def pad_chunks(df: DataFrame, max_position: int, chunk: str = "chunk", cls: int = CLS_ID,
               sep: int = SEP_ID, pad: int = PAD_ID) -> DataFrame:
    """``[CLS] + chunk + [SEP] + PAD*`` to ``max_position``; attention mask is
    1 on CLS, tokens and SEP, 0 on padding."""
    real = F.size(chunk) + 2
    npad = F.greatest(F.lit(max_position) - real, F.lit(0))
    ids = F.concat(F.array(F.lit(cls)), F.col(chunk), F.array(F.lit(sep)), F.array_repeat(F.lit(pad), npad))
    mask = F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), npad))
    return df.withColumn("input_ids", ids).withColumn("attention_mask", mask)


def record_length_hist(df: DataFrame, record_size: int, ids: str = "input_ids") -> DataFrame:
    """Count of records per length; the job fails if any exceeds ``record_size``.
    An empty input gives an empty histogram."""
    h = df.groupBy(F.size(ids).alias("length")).agg(F.count(F.lit(1)).alias("count"))
    return h.select("length", F.when(F.col("length") > record_size,
                                     F.raise_error(F.concat(F.lit("a packed record has more ids than fit: "),
                                                            F.col("length").cast("string"))))
                    .otherwise(F.col("count")).cast("bigint").alias("count"))


# ---------------------------------------------------------------- C8
def mask_tokens(df: DataFrame, key, seed, p: float = 0.15, vocab_size: int = 65536,
                ids: str = "input_ids", special=(PAD_ID, CLS_ID, SEP_ID, 3, MASK_ID, UNK_ID)) -> DataFrame:
    """Masked-language-model corruption with deterministic md5 draws.

    Each non-special position is selected with probability ``p``; a selected
    token becomes MASK (80 %), a random word id (10 %) or stays (10 %);
    ``labels`` hold the original id where selected and -100 elsewhere.
    One md5 digest of (seed, key, position, 'mask') per token gives the three
    draws as disjoint 32-bit slices (hex 1-8 select, 9-16 action, 17-24 word);
    the digest is built once per element. Draws are compared as the hex digits they
    are, so only the words of replaced tokens become numbers.
    """
    keys = _cols(key)
    kc = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    spec = F.array(*[F.lit(s) for s in special])

    def below(h, start, share):
        """The draw (8 hex digits from ``start``) is below ``share`` of 2^32."""
        bound = math.ceil(share * 2 ** 32)
        if not 0 < bound < 2 ** 32:
            return F.lit(bound > 0)
        return F.substring(h, start, 8) < F.lit(f"{bound:08x}")

    def word(h):
        u = F.conv(F.substring(h, 17, 8), 16, 10).cast("bigint") / F.lit(float(2 ** 32))
        return (F.lit(FIRST_WORD_ID) + F.floor(u * F.lit(vocab_size))).cast("int")

    # the key's part of the digested string is a lambda's variable, so that it is built once a row
    head = F.array(F.concat(F.concat_ws("|", F.lit(str(seed)), kc), F.lit("|")))
    hashed = F.transform(head, lambda own: F.transform(ids, lambda x, i: F.struct(
        x.alias("x"), F.md5(F.concat(own, i.cast("string"), F.lit("|mask"))).alias("h"))))[0]
    drawn = F.transform(hashed, lambda s: F.struct(
        s["x"].alias("x"), s["h"].alias("h"), (below(s["h"], 1, p) & ~F.array_contains(spec, s["x"])).alias("chosen")))

    def corrupt(s):
        return (F.when(~s["chosen"], s["x"]).when(below(s["h"], 9, 0.8), F.lit(MASK_ID))
                .when(below(s["h"], 9, 0.9), word(s["h"])).otherwise(s["x"]))

    return (df.withColumn("_rf_h", drawn)
            .withColumn("labels", F.transform("_rf_h", lambda s: F.when(s["chosen"], s["x"]).otherwise(F.lit(-100))))
            .withColumn(ids, F.transform("_rf_h", corrupt))
            .drop("_rf_h"))

"""Quality classifier: a support vector machine on Naive Bayes features.

A text's features are the n-grams it holds, each once: its words (A-Z in lower case)
and the one- to three-grams of its words' shapes (``Word,`` is ``Aa,``; a word like the
one before it is ``=``), hashed to 2^20. A feature is scaled by its log-count ratio: the
log of its share in texts of label 1 over that in texts of label 0. The scaled vector
has length 1. A linear hinge-loss model is fitted by dual coordinate descent, both
classes weighing the same, and its margins become probabilities by a logistic curve
fitted on a fifth of the examples, which the model does not see.

Fitting takes a bounded sample: at most ``sample`` labelled rows, the ones of low id
hash, so that every labelled row is as likely. One task fits on their feature ids. The
model (at most 2^20 weights) goes to the tasks that score every whole text; scoring
shuffles nothing.

Cases: a null text is empty; an empty text has no features and gets the score of the
intercept; labels that are null, or whose id is null or in no document, are not used;
of rows with one id the least text is the example; without labels of both classes every
score is the smoothed share of label 1 (0.5 without labels); a null id is not held out;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.llm.common import blocks, hash_sample, id_and_text, mix, one, prepare, schema_of, word_hashes, words_of

BITS = 20


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features, and the position of each text's first, with the total at the end."""
    index, bounds, distinct = words_of(texts)
    n = len(index)
    shapes = distinct
    for pattern, to in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0")):
        shapes = pc.replace_substring_regex(shapes, pattern, to)
    coded = shapes.dictionary_encode()
    shape = word_hashes(coded.dictionary)[np.asarray(coded.indices)][index]
    lower = pc.ascii_lower(distinct).dictionary_encode()
    word = np.asarray(lower.indices)[index]
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    first = np.zeros(n, dtype=bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    same = np.concatenate([[False], word[1:] == word[:-1]])[:n] & ~first
    shape = np.where(same, np.uint64(1), shape)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.int64) << BITS
    keep = np.uint64(64 - BITS)
    parts = [doc | (mix(word_hashes(lower.dictionary)) >> keep).astype(np.int64)[word]]
    gram = np.zeros(n, dtype=np.uint64)
    for k in (1, 2, 3):
        next_shape = np.concatenate([shape[k - 1:], np.zeros(min(k - 1, n), dtype=np.uint64)])[:n]
        gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + next_shape + np.uint64(k))
        parts.append((doc | (gram >> keep).astype(np.int64))[left >= k])
    found = np.unique(np.concatenate(parts))
    cuts = np.searchsorted(found, np.arange(len(bounds), dtype=np.int64) << BITS)
    return found & ((1 << BITS) - 1), cuts


def log_count_ratios(ids: np.ndarray, bounds: np.ndarray, label: np.ndarray, alpha: float) -> np.ndarray:
    """Of each feature: log of its smoothed share in label 1 over that in label 0; 0 for unseen ones."""
    of = np.repeat(label, np.diff(bounds))
    good, bad = (np.bincount(ids[of == k], minlength=1 << BITS) for k in (1, 0))
    ratio = np.log((good + alpha) / (good + alpha).sum()) - np.log((bad + alpha) / (bad + alpha).sum())
    return np.where(good + bad > 0, ratio, 0.0)


def unit_rows(ids: np.ndarray, bounds: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Scaled indicators, each text's of length 1."""
    x = ratio[ids]
    squares = np.concatenate([[0.0], np.cumsum(x * x)])
    norm = np.sqrt(np.maximum(squares[bounds[1:]] - squares[bounds[:-1]], 1e-12))
    return x / np.repeat(norm, np.diff(bounds))


def descend(ids: np.ndarray, bounds: np.ndarray, x: np.ndarray, label: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L2-regularised hinge-loss model, by dual coordinate descent."""
    n = len(label)
    y = np.where(label == 1, 1.0, -1.0)
    share = np.bincount(label, minlength=2) / n
    upper = cost / (2 * np.maximum(share[label], 1e-9))
    w, intercept, dual = np.zeros(1 << BITS), 0.0, np.zeros(n)
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n).tolist():
            at, xi = ids[bounds[i]:bounds[i + 1]], x[bounds[i]:bounds[i + 1]]
            slope = y[i] * (w[at] @ xi + intercept) - 1.0
            new = min(max(dual[i] - slope / (1.0 + float(xi @ xi)), 0.0), upper[i])
            if (step := (new - dual[i]) * y[i]) != 0.0:
                w[at] += step * xi
                intercept += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w, intercept


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to label 1, with smoothed targets."""
    share = np.bincount(label, minlength=2).astype(float)
    target = np.where(label == 1, (share[1] + 1) / (share[1] + 2), 1 / (share[0] + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (slope - 1), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        slope, offset = slope - float(np.clip(move[0], -2, 2)), offset - float(np.clip(move[1], -2, 2))
        if np.abs(move).max() < 1e-8:
            break
    return max(slope, 1e-3), offset


def fit(ids: np.ndarray, bounds: np.ndarray, label: np.ndarray, alpha: float, cost: float, rounds: int):
    """(weights by feature before scaling to length, intercept, slope, offset); see :func:`margins`."""
    n = len(label)
    if n == 0 or label.min() == label.max():
        share = (label.sum() + 1) / (n + 2)
        return np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share)))
    aside = np.arange(n) % 5 == 4
    if len(set(label[aside].tolist())) < 2 or len(set(label[~aside].tolist())) < 2:
        aside = np.zeros(n, dtype=bool)
    rows = np.flatnonzero(~aside)
    size = np.diff(bounds)
    part = ids[np.repeat(~aside, size)]
    cuts = np.concatenate([[0], np.cumsum(size[rows])])
    ratio = log_count_ratios(part, cuts, label[rows], alpha)
    w, intercept = descend(part, cuts, unit_rows(part, cuts, ratio), label[rows], cost, rounds)
    check = aside if aside.any() else ~aside
    slope, offset = calibrate(margins(ids, bounds, ratio, w, intercept)[check], label[check])
    return ratio, w, intercept, slope, offset


def margins(ids: np.ndarray, bounds: np.ndarray, ratio: np.ndarray, w: np.ndarray, intercept: float) -> np.ndarray:
    """Each text's margin."""
    scaled = ratio[ids]
    full = np.diff(bounds) > 0
    out, starts = np.zeros(len(full)), bounds[:-1][full]
    if len(starts):
        norm = np.sqrt(np.maximum(np.add.reduceat(scaled * scaled, starts), 1e-12))
        out[full] = np.add.reduceat(scaled * w[ids], starts) / norm
    return out + intercept


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, label_col: str, sample: int, alpha: float, cost: float, rounds: int,
          id_col: str, text_col: str):
    """The model, fitted on labelled rows that are not held out."""
    usable = (labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")))
    chosen = hash_sample(usable, ["id"], sample)
    texts = id_and_text(df, id_col, text_col).toDF("id", "text")
    # at most ``sample`` rows of 12 bytes
    examples = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))],
                names=["id", "label", "features"])

    def fitted(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("label", "ascending")])
        lists = one(group.column("features"))
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)
        mixed = np.random.default_rng(5).permutation(group.num_rows)  # the fold set aside is a mixture
        lists = lists.take(pa.array(mixed))
        bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[mixed])])
        label = np.asarray(one(group.column("label"))).astype(np.int64)[mixed]
        ratio, w, intercept, slope, offset = fit(np.asarray(lists.flatten()).astype(np.int64), bounds, label, alpha, cost, rounds)
        used = np.flatnonzero(ratio)
        return pa.table({"used": [used.astype(np.int32).tobytes()], "ratio": [ratio[used].tobytes()], "w": [w[used].tobytes()],
                         "curve": [np.array([intercept, slope, offset]).tobytes()]})

    lists = examples.mapInArrow(extract, "id {}, label int, features array<int>".format(texts.schema["id"].dataType.simpleString()))
    made = lists.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fitted, "used binary, ratio binary, w binary, curve binary").first()
    if made is None:
        return fit(np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), alpha, cost, rounds)
    ratio, w = np.zeros(1 << BITS), np.zeros(1 << BITS)
    used = np.frombuffer(made["used"], dtype=np.int32)
    ratio[used], w[used] = np.frombuffer(made["ratio"]), np.frombuffer(made["w"])
    return ratio, w, *np.frombuffer(made["curve"]).tolist()


def score_quality(df: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 12_000, alpha: float = 0.5,
                  cost: float = 1.0, rounds: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    spark = df.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(train(df, labels, label_col, sample, alpha, cost, rounds, id_col, text_col))
    schema = schema_of(df, id_col, ("score", T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, w, intercept, slope, offset = model.value
        for block in blocks(batches, 8 << 20):
            ids, bounds = features(one(block.column(1)))
            margin = slope * margins(ids, bounds, ratio, w, intercept) + offset
            score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays([one(block.column(0)), pa.array(score)], names=schema.names)

    scored = id_and_text(df, id_col, text_col).mapInArrow(run, schema)
    return scored.select(F.col(id_col), held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``df`` that score ``threshold`` at least, with the columns of ``df``.

    The rows are scored where they are: nothing shuffles but the examples.
    """
    spark = df.sparkSession
    prepare(spark)
    settings = {"label_col": "quality", "sample": 12_000, "alpha": 0.5, "cost": 1.0, "rounds": 20} | more
    model = spark.sparkContext.broadcast(train(df, labels, id_col=id_col, text_col=text_col, **settings))
    text = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, w, intercept, slope, offset = model.value
        for batch in batches:
            found, bounds = features(batch.column(text).fill_null(""))
            margin = slope * margins(found, bounds, ratio, w, intercept) + offset
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))) >= threshold))

    return df.mapInArrow(run, df.schema)

"""Embedding measurements over stored vectors.

Vectors are ``array<float>`` columns keyed by an id. Pooling is a vector mean,
summed within each task before the shuffle; similarities are array expressions (``zip_with`` + ``aggregate``) evaluated
inside whole-stage codegen, no Python.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# torch's default norm floor for cosine similarity, and the
# contrastive margins and weights of the training objective.
COS_EPS = 1e-8
MARGIN_POS, MARGIN_MID, MARGIN_NEG = 1.0, 0.0, -1.0
W_SAME, W_SIMILAR, W_DIFF = 1.0, 0.5, 0.33


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------- E1
def masked_mean_pool(df: DataFrame, key, mask: str, vec: str, out: str = "pooled") -> DataFrame:
    """Mean over *all* positions of mask × vector (padding counts in the
    denominator, as in the reference; cosine is unaffected by that scale).

    ``df`` has one row per (key, position) with the position's ``mask`` and
    hidden ``vec``. Output: one row per key with the pooled vector.
    """
    keys = _cols(key)
    masked = array_to_vector(F.transform(vec, lambda x: F.coalesce(F.col(mask).cast("double") * x.cast("double"), F.lit(0.0))))
    return (df.groupBy(*keys).agg(Summarizer.mean(masked).alias("_rf_mean"))
            .select(*keys, vector_to_array("_rf_mean").alias(out)))


# ---------------------------------------------------------------- E2
def cosine(a: Column, b: Column, eps: float = COS_EPS) -> Column:
    """Cosine similarity of two equal-length arrays, each norm floored at ``eps``."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return dot / (F.greatest(na, F.lit(eps)) * F.greatest(nb, F.lit(eps)))


QUAD_SLOTS = ("i1a", "i1b", "i2", "j")
PAIRS = {"sim_same": ("i1a", "i1b"), "sim_similar_a": ("i1a", "i2"), "sim_similar_b": ("i1b", "i2"),
         "sim_diff_a": ("i1a", "j"), "sim_diff_b": ("i1b", "j"), "sim_diff_c": ("i2", "j")}


def _with_slots(quads: DataFrame, vectors: DataFrame, slot_keys: dict, vec_key, vec: str, more=()) -> DataFrame:
    """The quads with each slot's vector as ``_rf_v_<slot>``: one equi-join a slot on its key columns."""
    q = quads
    for slot in QUAD_SLOTS:
        names = [f"_rf_k{i}" for i in range(len(_cols(vec_key)))]
        v = vectors.select(*[F.col(c).alias(n) for c, n in zip(_cols(vec_key), names)],
                           *[F.col(c).alias(f"_rf_m_{c}") for c in more], F.col(vec).alias(f"_rf_v_{slot}"))
        on = [q[c] == v[n] for c, n in zip(_cols(slot_keys[slot]), names)] + [q[c] == v[f"_rf_m_{c}"] for c in more]
        q = q.join(v, on, "inner").drop(*names, *[f"_rf_m_{c}" for c in more])
    return q


def cosine_pairs(quads: DataFrame, vectors: DataFrame, slot_keys: dict, vec_key="vec_id", vec: str = "vec") -> DataFrame:
    """The six cosine similarities of each quad.

    ``slot_keys`` maps each quad slot (i1a, i1b, i2, j) to the quad columns that hold
    its vector's key, in the order of ``vec_key`` (a column or several, such as
    document and chunk); each slot is an equi-join on the vector table.
    """
    q = _with_slots(quads, vectors, slot_keys, vec_key, vec)
    sims = [cosine(F.col(f"_rf_v_{a}"), F.col(f"_rf_v_{b}")).alias(n) for n, (a, b) in PAIRS.items()]
    return q.select(*[c for c in quads.columns], *sims)


# ---------------------------------------------------------------- E3, E4
def contrastive_loss(df: DataFrame) -> DataFrame:
    """Logsumexp of the six margin terms (max-shifted for stability)."""
    terms = [F.lit(W_SAME) * (F.lit(MARGIN_POS) - F.col("sim_same")),
             F.lit(W_SIMILAR) * (F.lit(MARGIN_MID) - F.col("sim_similar_a")),
             F.lit(W_SIMILAR) * (F.lit(MARGIN_MID) - F.col("sim_similar_b")),
             F.lit(W_DIFF) * (F.col("sim_diff_a") - F.lit(MARGIN_NEG)),
             F.lit(W_DIFF) * (F.col("sim_diff_b") - F.lit(MARGIN_NEG)),
             F.lit(W_DIFF) * (F.col("sim_diff_c") - F.lit(MARGIN_NEG))]
    m = F.greatest(*terms)
    lse = m + F.log(sum((F.exp(t - m) for t in terms), F.lit(0.0)))
    return df.withColumn("loss", lse)


def contrastive_report(df: DataFrame, by=None) -> DataFrame:
    """Mean loss and mean same / similar / different similarity (1, 2 and 3
    values per quad) per ``by`` group."""
    by = _cols(by)
    return df.groupBy(*by).agg(
        F.avg("loss").alias("mean_loss"),
        F.avg("sim_same").alias("mean_sim_same"),
        ((F.sum("sim_similar_a") + F.sum("sim_similar_b")) / (2 * F.count(F.lit(1)))).alias("mean_sim_similar"),
        ((F.sum("sim_diff_a") + F.sum("sim_diff_b") + F.sum("sim_diff_c")) / (3 * F.count(F.lit(1))))
        .alias("mean_sim_diff"),
        F.count(F.lit(1)).alias("num_quads"))


# ---------------------------------------------------------------- E5, E6
def truncate_dims(df: DataFrame, k, vec: str = "vec", binarize: bool = False, hidden: int | None = None,
                  out: str | None = None) -> DataFrame:
    """E5: zero every dimension ≥ k. ``binarize`` also applies sign (sign(0) =
    0, no range check); otherwise 0 < k < hidden is required when ``hidden``
    is given (the job fails on a bad k)."""
    kc = F.col(k) if isinstance(k, str) else F.lit(k)
    t = F.transform(vec, lambda x, i: F.when(i < kc, x).otherwise(F.lit(0.0).cast("float")))
    if binarize:
        t = F.transform(t, lambda x: F.signum(x).cast("float"))
    elif hidden is not None:
        t = F.when((kc > 0) & (kc < hidden), t).otherwise(
            F.raise_error(F.concat(F.lit("reduced dim out of range: "), kc.cast("string"))))
    return df.withColumn(out or vec, t)


def separation_by_dim(vectors: DataFrame, quads: DataFrame, slot_keys: dict, ks,
                      vec_key="vec_id", vec: str = "vec", binarize: bool = False) -> DataFrame:
    """Contrastive separation at each prefix size k (E5 -> E2 -> E3 -> E4).

    The k list is a small constant array exploded onto the vectors (each
    vector replicated len(ks) times), and quads join vectors on (key, k).
    """
    vk = vectors.select(*_cols(vec_key), vec, F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    vk = truncate_dims(vk, "k", vec, binarize=binarize)
    q = quads.select("*", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    q = _with_slots(q, vk, slot_keys, vec_key, vec, more=("k",))
    sims = [cosine(F.col(f"_rf_v_{a}"), F.col(f"_rf_v_{b}")).alias(n) for n, (a, b) in PAIRS.items()]
    scored = contrastive_loss(q.select("k", *sims))
    return contrastive_report(scored, "k")

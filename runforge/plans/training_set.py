"""End-to-end corpus job (P6): catalog -> corpora -> tokenize -> interleave ->
gate -> pack -> shuffle, and the eval-set sample.

Stage boundaries: the vocabulary count (shuffle by word), the regroup of word
ids by document, the per-dataset sizes (tiny), the per-batch length fold
(batch_rows values per batch), the regroup of placed ids by record, and the
sliced shuffle order. No step gathers more than one record's or one batch's
lengths in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runforge.operators import corpus as C
from runforge.operators import packing as P
from runforge.session import materialize
from runforge.sources import corpus_io as CIO
from runforge.sources import fixtures as X


def build_training_set(spark: SparkSession, sf_dir: str, prefix: str = "src", record_size: int = 128,
                       vocab_size: int | None = None, seed=42, batch_rows: int = 1000,
                       min_ratio: float = 2.5, mime_types=C.DEFAULT_MIME) -> DataFrame:
    """Packed, shuffled training records: (batch, record_idx, input_ids, n_ids, shuffle_pos).

    ``n_ids`` is stored beside the ids, so that who reads only lengths shuffles no ids."""
    recs = pack_training_set(spark, sf_dir, prefix, record_size, vocab_size, batch_rows, min_ratio, mime_types)
    return P.shuffle(recs, seed, ["batch", "record_idx"])


def pack_training_set(spark: SparkSession, sf_dir: str, prefix: str = "src", record_size: int = 128,
                      vocab_size: int | None = None, batch_rows: int = 1000, min_ratio: float = 2.5,
                      mime_types=C.DEFAULT_MIME) -> DataFrame:
    """Packed training records before their shuffle, stored: (batch, record_idx, input_ids, n_ids)."""
    # stored, so that its size is known before the join: a short list is sent, no text is dealt
    selected = materialize(CIO.select_corpora(X.catalog(spark, sf_dir), prefix), "selected")
    corp = X.corpus(spark, sf_dir).join(selected.withColumnRenamed("dataset_id", "dataset"), "dataset", "left_semi")
    vocab = C.build_vocab(corp, "text", vocab_size)
    # stage boundary: the tokenized corpus is the reusable artifact; write it once. The density gate
    # needs only the text's non-whitespace count, so the text travels through no regroup
    tok = materialize(C.tokenize(corp, vocab, "doc_id", keep_text=False, chars="n_non_ws"), "tokenized")
    stream = P.interleave(tok)
    keep = (F.col("mime_type").isin(list(mime_types)) & (F.size("tokens") > 0)
            & (C.density_ratio_counted("n_non_ws", "tokens") >= F.lit(min_ratio)))
    recs = P.pack_records(stream.withColumn("keep", keep), record_size, order="position", batch_rows=batch_rows, keep="keep")
    return materialize(recs.withColumn("n_ids", F.size("input_ids")), "packed")


#: A sample of so many records' keys at most is sent to every task.
SENT_KEYS = 1 << 16


def build_eval_set(records: DataFrame, k: int = 1000, seed=42) -> DataFrame:
    """Shuffle the packed records and keep ``k``: a distributed top-k of their keys, which
    then fetch their records, so only the kept records' ids move."""
    keys = ["batch", "record_idx"]
    kept = P.sample_k(P.shuffle(records.select(*keys), seed, keys), k, seed, keys)
    return records.join(F.broadcast(kept) if k <= SENT_KEYS else kept, keys).orderBy("shuffle_pos")


def summarize(records: DataFrame, record_size: int) -> DataFrame:
    """Per batch: records, full-length (R) and short (R-1) records, total ids."""
    n = F.col("n_ids") if "n_ids" in records.columns else F.size("input_ids")
    return records.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count(F.when(n == record_size, 1)).alias("n_full"),
        F.count(F.when(n == record_size - 1, 1)).alias("n_short"),
        F.sum(n).cast("bigint").alias("n_ids"))

"""Checked queries for corpus operators and packing (C1-C8, IO4, IO5, P1-P6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runforge.functions.indexing import position_within
from runforge.functions.text import WS_CLASS
from runforge.operators import corpus as C
from runforge.operators import packing as P
from runforge.plans import training_set as TS
from runforge.plans.oracle_views import with_views
from runforge.plans.registry import register, rounded
from runforge.plans.suite_runlog import rsel
from runforge.sources import corpus_io as CIO
from runforge.sources import fixtures as X

MASK_VOCAB = 65536         # vocabulary of the shipped model config: random replacements are drawn from it
RECORD_SIZE = 128          # context length of the shipped model config
SEED = 42


def tokenized(spark, sf):
    """Corpus with word-id tokens from the vocabulary of all its words.

    The tokenized corpus is the reusable artifact of every corpus query: it is
    written once (reliable checkpoint) so later stages scan it, not the raw
    documents again through each reuse of the plan. The density gate needs only the
    text's non-whitespace count, which is taken here, so no text is dealt or written again.
    """
    def build():
        corp = X.corpus(spark, sf)
        vocab = C.build_vocab(corp, "text")
        return C.tokenize(corp, vocab, "doc_id", keep_text=False, chars="n_non_ws")

    return X.stored(spark, sf, "tokenized", build)


# ------------------------------------------------------------------ SQL building blocks
_WS = WS_CLASS
TOK_CTES = f""", words AS (
SELECT dataset, row_idx, doc_id, mime_type, text,
       list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w
FROM corpus),
vcounts AS (SELECT token, count(*) AS count FROM (SELECT unnest(w) AS token FROM words) GROUP BY token),
vocab AS (SELECT token, count, CAST(row_number() OVER (ORDER BY count DESC, token) - 1 + 6 AS INTEGER) AS id
          FROM vcounts),
wpos AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS k FROM words),
ids AS (SELECT wpos.doc_id, list(coalesce(vocab.id, 5) ORDER BY wpos.k) AS tokens
        FROM wpos LEFT JOIN vocab ON wpos.token = vocab.token GROUP BY wpos.doc_id),
tok AS (SELECT words.dataset, words.row_idx, words.doc_id, words.mime_type, words.text,
               coalesce(ids.tokens, CAST([] AS INTEGER[])) AS tokens
        FROM words LEFT JOIN ids ON words.doc_id = ids.doc_id)
"""


def _keep_sql(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return (f"({a}mime_type IN ('text/markdown', 'text/plain') AND len({a}tokens) > 0 AND "
            f"length(regexp_replace({a}text, '{_WS}', '', 'g')) / len({a}tokens) >= 2.5)")


def _pack_sql(src: str, batch_rows: int, record_size: int) -> str:
    """CTEs packing ``src`` (pos, tokens, keep) with a recursive offset fold; defines ``packed``."""
    B = record_size - 2
    return f""", kept AS (
SELECT pos, CAST(floor(pos / {batch_rows}) AS BIGINT) AS batch, tokens FROM {src} WHERE keep),
d AS (SELECT batch, pos, CAST(len(tokens) AS BIGINT) AS l, row_number() OVER (PARTITION BY batch ORDER BY pos) AS k,
             tokens FROM kept),
o(batch, k, off) AS (
  SELECT DISTINCT batch, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM d
  UNION ALL
  SELECT o.batch, o.k + 1, o.off + d.l + CASE WHEN (o.off + d.l) % {B} <> 0 THEN 1 ELSE 0 END
  FROM o JOIN d ON d.batch = o.batch AND d.k = o.k),
placed AS (SELECT d.batch, d.pos, d.l, d.tokens, o.off FROM d JOIN o ON d.batch = o.batch AND d.k = o.k),
items AS (
  SELECT batch, off + i - 1 AS p, tokens[i] AS id FROM (SELECT *, generate_subscripts(tokens, 1) AS i FROM placed)
  UNION ALL
  SELECT batch, off + l AS p, 3 AS id FROM placed WHERE (off + l) % {B} <> 0),
recs AS (SELECT batch, p // {B} AS record_idx, list(id ORDER BY p) AS body FROM items GROUP BY batch, p // {B}),
facts AS (SELECT batch, max(off + l - 1) AS tmax FROM placed GROUP BY batch),
r2 AS (SELECT DISTINCT batch, (off + l) // {B} - 1 AS record_idx FROM placed WHERE (off + l) % {B} = 0),
packed AS (
  SELECT recs.batch, CAST(recs.record_idx AS BIGINT) AS record_idx,
         CASE WHEN r2.batch IS NOT NULL THEN list_concat([1], body) ELSE list_concat([1], body, [2]) END AS input_ids
  FROM recs JOIN facts USING (batch)
       LEFT JOIN r2 ON recs.batch = r2.batch AND recs.record_idx = r2.record_idx
  WHERE r2.batch IS NOT NULL OR facts.tmax >= (recs.record_idx + 1) * {B})
"""


def _draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


# ------------------------------------------------------------------ C1-C8
@register("C1_filter_mime", with_views("corpus") + rsel("""
SELECT dataset, doc_id, mime_type FROM corpus WHERE mime_type IN ('text/markdown', 'text/plain')"""))
def c1(spark, sf):
    return C.filter_mime(X.corpus(spark, sf)).select("dataset", "doc_id", "mime_type")


@register("C2_density_gate", with_views("corpus") + TOK_CTES + rsel(f"""
SELECT doc_id, length(regexp_replace(text, '{_WS}', '', 'g')) / len(tokens) AS ratio
FROM tok WHERE len(tokens) > 0 AND length(regexp_replace(text, '{_WS}', '', 'g')) / len(tokens) >= 2.5""",
                                                                       "ratio"))
def c2(spark, sf):
    g = C.density_gate(tokenized(spark, sf), n_non_ws="n_non_ws")
    return rounded(g.select("doc_id", C.density_ratio_counted("n_non_ws", "tokens").alias("ratio")))


@register("C3_build_vocab", with_views("corpus") + TOK_CTES + rsel("""
SELECT token, count, id FROM vocab"""))
def c3(spark, sf):
    return C.build_vocab(X.corpus(spark, sf), "text")


@register("C3b_tokenize", with_views("corpus") + TOK_CTES + rsel("""
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS ids FROM tok"""))
def c3b(spark, sf):
    t = tokenized(spark, sf)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("ids"))


@register("C4_token_entropy", with_views("corpus") + TOK_CTES + rsel("""
SELECT doc_id, coalesce(log2(n) - s / n, 0.0) AS entropy
FROM tok LEFT JOIN (SELECT doc_id, sum(c) AS n, sum(c * log2(c)) AS s
                    FROM (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(tokens) AS t FROM tok)
                          GROUP BY doc_id, t) GROUP BY doc_id) AS e USING (doc_id)""", "entropy"))
def c4(spark, sf):
    return rounded(C.token_entropy(tokenized(spark, sf), "doc_id"))


_CHUNK = RECORD_SIZE - 2
_CHUNKS_SQL = f""", ch AS (
SELECT doc_id, CAST(s // {_CHUNK} AS INTEGER) AS chunk_idx, tokens[s + 1: s + {_CHUNK}] AS chunk
FROM (SELECT doc_id, tokens, unnest(range(0, len(tokens), {_CHUNK})) AS s FROM tok))
"""


@register("C5_chunk_tokens", with_views("corpus") + TOK_CTES + _CHUNKS_SQL + rsel("""
SELECT doc_id, chunk_idx, CAST(len(chunk) AS INTEGER) AS length, array_to_string(chunk, ' ') AS ids FROM ch"""))
def c5(spark, sf):
    ch = C.chunk_tokens(tokenized(spark, sf), _CHUNK)
    return ch.select("doc_id", "chunk_idx", F.size("chunk").alias("length"), F.array_join("chunk", " ").alias("ids"))


@register("C6_pad_chunks", with_views("corpus") + TOK_CTES + _CHUNKS_SQL + rsel(f"""
SELECT doc_id, chunk_idx,
       array_to_string(list_concat([1], chunk, [2], list_resize(CAST([] AS INTEGER[]), {RECORD_SIZE} - len(chunk) - 2, 0)),
                       ' ') AS input_ids,
       CAST(len(chunk) + 2 AS INTEGER) AS mask_sum, {RECORD_SIZE} AS padded_len
FROM ch"""))
def c6(spark, sf):
    ch = C.pad_chunks(C.chunk_tokens(tokenized(spark, sf), _CHUNK), RECORD_SIZE)
    return ch.select("doc_id", "chunk_idx", F.array_join("input_ids", " ").alias("input_ids"),
                     F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                     F.size("input_ids").alias("padded_len"))


def _stream_by_doc(spark, sf):
    """Tokenized corpus in doc_id order with the packing gate as ``keep``."""
    t = tokenized(spark, sf)
    keep = (F.col("mime_type").isin(list(C.DEFAULT_MIME)) & (F.size("tokens") > 0)
            & (C.density_ratio_counted("n_non_ws", "tokens") >= F.lit(2.5)))
    return position_within(t.withColumn("keep", keep), [], ["doc_id"], out="pos", slice_width=X.ID_SLICE)


_DOCPOS = ", sp AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, tokens, " + _keep_sql() + " AS keep FROM tok)\n"


@register("C7_record_length_hist", with_views("corpus", recursive=True) + TOK_CTES + _DOCPOS
          + _pack_sql("sp", 100, RECORD_SIZE) + rsel("""
SELECT CAST(len(input_ids) AS INTEGER) AS length, count(*) AS count FROM packed GROUP BY len(input_ids)"""))
def c7(spark, sf):
    recs = P.pack_records(_stream_by_doc(spark, sf), RECORD_SIZE, order="pos", batch_rows=100, keep="keep")
    return C.record_length_hist(recs, RECORD_SIZE)


@register("C8_mask_tokens", with_views("corpus") + TOK_CTES + f""", ex AS (
SELECT doc_id, i - 1 AS k, tokens[i] AS x FROM (SELECT doc_id, tokens, generate_subscripts(tokens, 1) AS i FROM tok)),
hx AS (SELECT doc_id, k, x, md5(concat_ws('|', '7', CAST(doc_id AS VARCHAR), CAST(k AS VARCHAR), 'mask')) AS h FROM ex),
dr AS (SELECT doc_id, k, x,
              (('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0 < 0.15 AND x NOT IN (0, 1, 2, 3, 4, 5)) AS sel,
              ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0 AS u,
              CAST(6 + floor(('0x' || substr(h, 17, 8))::BIGINT / 4294967296.0 * {MASK_VOCAB}) AS INTEGER) AS rnd
       FROM hx),
m AS (SELECT doc_id, k, sel, CASE WHEN NOT sel THEN x WHEN u < 0.8 THEN 4 WHEN u < 0.9 THEN rnd ELSE x END AS y,
             CASE WHEN sel THEN x ELSE -100 END AS label FROM dr)
""" + rsel("""
SELECT tok.doc_id, coalesce(n_selected, 0) AS n_selected, coalesce(n_mask, 0) AS n_mask,
       coalesce(ids_checksum, 0) AS ids_checksum, coalesce(labels_checksum, 0) AS labels_checksum
FROM tok LEFT JOIN (SELECT doc_id, CAST(count(*) FILTER (WHERE sel) AS BIGINT) AS n_selected,
                           CAST(count(*) FILTER (WHERE y = 4) AS BIGINT) AS n_mask,
                           CAST(sum(CAST(y AS BIGINT) * (k + 1)) AS BIGINT) AS ids_checksum,
                           CAST(sum(CAST(label AS BIGINT) * (k + 1)) AS BIGINT) AS labels_checksum
                    FROM m GROUP BY doc_id) AS a ON tok.doc_id = a.doc_id"""))
def c8(spark, sf):
    t = tokenized(spark, sf).select("doc_id", F.col("tokens").alias("input_ids"))
    m = C.mask_tokens(t, "doc_id", 7, 0.15, vocab_size=MASK_VOCAB)

    def checksum(col):
        return F.aggregate(F.transform(col, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"),
                           lambda a, x: a + x)

    return m.select("doc_id",
                    F.size(F.filter("labels", lambda x: x != -100)).cast("bigint").alias("n_selected"),
                    F.size(F.filter("input_ids", lambda x: x == 4)).cast("bigint").alias("n_mask"),
                    checksum(F.col("input_ids")).alias("ids_checksum"),
                    checksum(F.col("labels")).alias("labels_checksum"))


# ------------------------------------------------------------------ IO4, IO5
@register("IO4_select_corpora", with_views("catalog") + rsel("""
SELECT dataset_id FROM catalog WHERE starts_with(dataset_id, 'src1') AND NOT contains(dataset_id, '-eval-')"""))
def io4(spark, sf):
    return CIO.select_corpora(X.catalog(spark, sf), "src1")


@register("IO5_read_corpus", rsel("""
SELECT source AS dataset, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source"""))
def io5(spark, sf):
    docs = CIO.read_corpus(spark, [f"{sf}/documents.parquet"])
    return docs.groupBy(F.col("source").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").cast("bigint").alias("n_chars"))


# ------------------------------------------------------------------ P1-P6
@register("P1_pack_records", with_views("corpus", recursive=True) + TOK_CTES + _DOCPOS
          + _pack_sql("sp", 100, RECORD_SIZE) + rsel("""
SELECT batch, record_idx, CAST(len(input_ids) AS INTEGER) AS length, array_to_string(input_ids, ' ') AS ids
FROM packed"""))
def p1(spark, sf):
    recs = P.pack_records(_stream_by_doc(spark, sf), RECORD_SIZE, order="pos", batch_rows=100, keep="keep")
    return recs.select("batch", "record_idx", F.size("input_ids").alias("length"),
                       F.array_join("input_ids", " ").alias("ids"))


_INTERLEAVE_SQL = """, sizes AS (SELECT dataset, count(*) AS len FROM corpus GROUP BY dataset),
meta AS (SELECT dataset, len, row_number() OVER (ORDER BY dataset) - 1 AS ord,
                max(len) OVER () AS big_l, count(*) OVER () AS n FROM sizes),
il AS (SELECT dataset, row_idx, doc_id, CAST(lr * n + ord AS BIGINT) AS position, CAST(lr AS BIGINT) AS round
       FROM (SELECT c.dataset, c.row_idx, c.doc_id, m.n, m.ord, unnest(range(c.row_idx, m.big_l, m.len)) AS lr
             FROM corpus AS c JOIN meta AS m USING (dataset)))
"""


@register("P2_interleave", with_views("corpus") + _INTERLEAVE_SQL + rsel("""
SELECT dataset, row_idx, doc_id, position, round FROM il"""))
def p2(spark, sf):
    return P.interleave(X.corpus(spark, sf)).select("dataset", "row_idx", "doc_id", "position", "round")


@register("P3_concat_corpora", with_views("corpus") + rsel("""
SELECT dataset, doc_id, mime_type, CAST(NULL AS INTEGER) AS quality FROM corpus
UNION ALL
SELECT NULL AS dataset, doc_id, NULL AS mime_type, quality FROM labels"""))
def p3(spark, sf):
    a = X.corpus(spark, sf).select("dataset", "doc_id", "mime_type")
    b = X.table(spark, sf, "labels").select("doc_id", "quality")
    return P.concat_corpora(a, b)


@register("P4_shuffle", with_views("corpus") + rsel(f"""
SELECT doc_id, row_number() OVER (ORDER BY {_draw_sql("'42'", "CAST(doc_id AS VARCHAR)", "'shuffle'")}, doc_id) - 1
       AS shuffle_pos
FROM corpus"""))
def p4(spark, sf):
    return P.shuffle(X.corpus(spark, sf).select("doc_id"), SEED, "doc_id")


@register("P5_sample_k", with_views("corpus") + rsel(f"""
SELECT doc_id, dataset FROM corpus
ORDER BY {_draw_sql("'42'", "CAST(doc_id AS VARCHAR)", "'shuffle'")}, doc_id LIMIT 100"""))
def p5(spark, sf):
    return P.sample_k(X.corpus(spark, sf).select("doc_id", "dataset"), 100, SEED, "doc_id")


_P6_SQL = (with_views("corpus", "catalog", recursive=True) + TOK_CTES + _INTERLEAVE_SQL + """, sel AS (
SELECT dataset_id FROM catalog WHERE starts_with(dataset_id, 'src') AND NOT contains(dataset_id, '-eval-')),
sp AS (SELECT il.position AS pos, tok.tokens, """ + _keep_sql("tok") + """ AS keep
       FROM il JOIN tok ON il.doc_id = tok.doc_id WHERE il.dataset IN (SELECT dataset_id FROM sel))
""" + _pack_sql("sp", 1000, RECORD_SIZE))


@register("P6_training_set", _P6_SQL + rsel(f"""
SELECT batch, record_idx, CAST(len(input_ids) AS INTEGER) AS length, array_to_string(input_ids, ' ') AS ids,
       row_number() OVER (ORDER BY {_draw_sql("'42'", "CAST(batch AS VARCHAR)", "CAST(record_idx AS VARCHAR)",
                                              "'shuffle'")}, batch, record_idx) - 1 AS shuffle_pos
FROM packed"""))
def p6(spark, sf):
    recs = TS.build_training_set(spark, sf, prefix="src", record_size=RECORD_SIZE, seed=SEED)
    return recs.select("batch", "record_idx", F.size("input_ids").alias("length"),
                       F.array_join("input_ids", " ").alias("ids"), "shuffle_pos")


@register("P6_training_set_summary", _P6_SQL + rsel("""
SELECT batch, count(*) AS n_records, count(*) FILTER (WHERE len(input_ids) = 128) AS n_full,
       count(*) FILTER (WHERE len(input_ids) = 127) AS n_short, CAST(sum(len(input_ids)) AS BIGINT) AS n_ids
FROM packed GROUP BY batch"""))
def p6s(spark, sf):
    recs = TS.build_training_set(spark, sf, prefix="src", record_size=RECORD_SIZE, seed=SEED)
    return TS.summarize(recs, RECORD_SIZE)


@register("P6b_eval_set", _P6_SQL + rsel(f"""
SELECT batch, record_idx, array_to_string(input_ids, ' ') AS ids FROM packed
ORDER BY {_draw_sql("'42'", "CAST(batch AS VARCHAR)", "CAST(record_idx AS VARCHAR)", "'shuffle'")}, batch, record_idx
LIMIT 1000"""))
def p6b(spark, sf):
    """Eval set: shuffle the packed records and keep k = 1000 (the reference's eval build)."""
    recs = TS.pack_training_set(spark, sf, prefix="src", record_size=RECORD_SIZE)
    return TS.build_eval_set(recs, 1000, SEED).select(
        "batch", "record_idx", F.array_join("input_ids", " ").alias("ids"))


@register("IO5b_read_selected_partitions", with_views("corpus", "catalog") + rsel("""
SELECT dataset, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM corpus
WHERE dataset IN (SELECT dataset_id FROM catalog WHERE starts_with(dataset_id, 'src1')
                  AND NOT contains(dataset_id, '-eval-'))
GROUP BY dataset"""))
def io5b(spark, sf):
    """Corpus stored partitioned by dataset; the selected datasets are read with
    dynamic partition pruning from a semi join with the catalog selection."""
    from runforge.sources.logs import scratch_dir
    path = scratch_dir(spark, "corpus-by-dataset")
    CIO.write_corpus(X.corpus(spark, sf).select("dataset", "doc_id", "text"), path)
    sel = CIO.read_selected(spark, path, CIO.select_corpora(X.catalog(spark, sf), "src1"))
    return sel.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_docs"),
                                      F.sum(F.length("text")).cast("bigint").alias("n_chars"))

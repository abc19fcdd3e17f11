"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runforge.llm import (chat, conversation_repair, exact_dedup, filter_audit, html_text, lm_scoring, packing, pieces, quality, simhash, substring_dedup,
                          token_counts, topk)
from runforge.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return add


@query("op1_lm_scoring", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     p AS (SELECT doc_id, unnest(w) AS w3, unnest(generate_series(1, len(w))) AS i FROM d),
     g AS (SELECT *, lag(w3) OVER o AS w2, lag(w3, 2) OVER o AS w1 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     c1 AS (SELECT w3, count(*) AS n FROM g GROUP BY ALL),
     c2 AS (SELECT w2, w3, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
     c3 AS (SELECT w1, w2, w3, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
     s AS (SELECT g.doc_id, CASE
             WHEN t.n >= 2 THEN ln(t.n) - ln(h.n)
             WHEN b.n >= 2 THEN ln(b.n) - ln(u.n) + CASE WHEN g.w1 IS NULL THEN 0 ELSE ln(0.4) END
             ELSE ln(a.n) - ln((SELECT count(*) FROM g)) + CASE WHEN g.w2 IS NULL THEN 0 WHEN g.w1 IS NULL THEN ln(0.4)
                  ELSE 2 * ln(0.4) END END AS x
           FROM g JOIN c1 a ON a.w3 = g.w3
           LEFT JOIN c1 u ON u.w3 = g.w2 LEFT JOIN c2 b ON b.w2 = g.w2 AND b.w3 = g.w3
           LEFT JOIN c2 h ON h.w2 = g.w1 AND h.w3 = g.w2 LEFT JOIN c3 t ON t.w1 = g.w1 AND t.w2 = g.w2 AND t.w3 = g.w3)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(sum(s.x), 0), 6) AS log_score,
       round(sum(s.x) / len(d.w), 6) AS mean_log_score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, len(d.w)""")
def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), order=3, min_count=2, backoff=0.4) \
        .withColumn("log_score", F.round("log_score", 6)).withColumn("mean_log_score", F.round("mean_log_score", 6))


@query("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    back = pieces.decode(pieces.encode(docs, "piece_bpe_32k.model"), "piece_bpe_32k.model")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids",
                       F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


MARKED = r"\### Assistant: </turn> ok"


@query("op4_chat_formatting", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
     o AS (SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\1\\/turn>', 'g'), '#(\\*)## ', '#\1\\## ', 'g')) AS n,
                  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + 8 + CASE WHEN opens THEN length(role) + 5 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id""")
def op4_chat_formatting(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], own.schema)
    return chat.digests(chat.format_conversations(own.unionByName(more)))


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), word_runs=True)
    return done.select("doc_id", "_spans.n_sentences", "_spans.n_removed", "_spans.removed_chars", "_spans.first_ids", "text")


@query("op6_topk", """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op6_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2, capacity=4096)


@query("op8_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
     g AS (SELECT t, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)""")
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


@query("op9_simhash")
def op9_simhash(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


@query("op11_filter_audit", r"""
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
           FROM labels GROUP BY doc_id),
     w AS (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     m AS (SELECT coalesce(source, '') AS part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                  CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
                  + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
                  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
                  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                  + CASE WHEN min(w.doc_id) OVER (PARTITION BY t) < w.doc_id THEN 16 ELSE 0 END AS fails
           FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
     c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
     f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
     o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
           FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x)
           JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
     s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before
           FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
     r AS (SELECT part, filter_order, step, bit,
                  sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                  sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
                  sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                  sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
           FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r""")
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(filter_audit.postings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    own = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(own, conversation_repair.damage(own))


@query("op13_html_extraction")
def op13_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

"""The fixture views of :mod:`runforge.sources.fixtures`, spelled as DuckDB CTEs.

DuckDB has only the base tables registered, so each oracle query inlines the
views it needs: ``with_views("steps", "evals")`` returns a ``WITH`` prefix
holding those views and their dependencies, in dependency order.
"""

from __future__ import annotations


def exclusive_cut_sql(c: int, xs: str, n: str) -> str:
    """Cut point ``c`` of ``statistics.quantiles(n=100)`` over sorted list ``xs`` (1-based)."""
    i = c + 1
    j = f"least(greatest(({i} * ({n} + 1)) // 100, 1), {n} - 1)"
    d = f"({i} * ({n} + 1) - 100 * {j})"
    return f"(({xs})[{j}] * (100 - {d}) + ({xs})[{j} + 1] * {d}) / 100.0"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "steps": ((), """
SELECT user_id % 4 AS run_id,
       row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS step,
       event_type AS task, concat('ds', CAST(user_id % 7 AS VARCHAR)) AS dataset,
       value AS loss, value / 100 AS grad_norm,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS num_tokens,
       value / 1000 AS sample_time, value / 500 AS forward_time, value / 250 AS backward_time,
       CASE WHEN event_id % 4 = 3 THEN value / 2000 END AS optimizer_time, value / 100 AS step_time,
       CAST(user_id % 9 + 1 AS DOUBLE) AS lr, ts AS time
FROM events"""),
    "gapped": (("steps",), """
SELECT run_id, step, num_tokens, CASE WHEN step = 300 THEN CAST('inf' AS DOUBLE) WHEN step % 41 = 5 THEN CAST('nan' AS DOUBLE)
       WHEN step = 1500 THEN 1e9 ELSE loss END AS loss,
       CAST((step % 700 + 1) AS DOUBLE) * 0.25::DOUBLE AS total_time
FROM steps WHERE step % 3 <> 2 AND step % 256 NOT IN (0, 255) AND step % 700 <> 699"""),
    "eval_losses": (("steps",), """
SELECT run_id, CAST(floor(step / 100) AS BIGINT) * 100 AS step, loss AS sample_loss
FROM steps"""),
    "eval_sorted": (("eval_losses",), """
SELECT run_id, step, avg(sample_loss) AS mean, median(sample_loss) AS median,
       coalesce(stddev_samp(sample_loss), 0.0) AS std, min(sample_loss) AS min,
       max(sample_loss) AS max, count(sample_loss) AS num_samples,
       list_sort(list(sample_loss)) AS xs
FROM eval_losses GROUP BY run_id, step"""),
    "evals": (("eval_sorted",), f"""
SELECT run_id, step, mean, median, std, min,
       {exclusive_cut_sql(5, 'xs', 'num_samples')} AS p5,
       {exclusive_cut_sql(95, 'xs', 'num_samples')} AS p95,
       max, num_samples, max / mean AS svd_mean_ratio_1, max / median AS svd_median_ratio_1,
       step AS line_no
FROM eval_sorted"""),
    "corpus": ((), """
SELECT source AS dataset, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_idx, doc_id,
       CASE doc_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/markdown' ELSE 'text/plain' END AS mime_type,
       text
FROM documents"""),
    "matrices": ((), """
SELECT concat('layer.', CAST(label AS VARCHAR), '.intermediate.dense.weight') AS matrix_id,
       vec_id AS row_id, embedding AS vec
FROM embeddings"""),
    "model_matrices": (("matrices",), """
SELECT 'a' AS model, matrix_id, row_id, vec FROM matrices
UNION ALL
SELECT 'b' AS model, matrix_id, row_id, list_transform(vec, lambda x: x * CAST(2.0 AS FLOAT)) AS vec FROM matrices
UNION ALL
SELECT 'c' AS model, matrix_id, row_id, vec FROM matrices
WHERE matrix_id <> 'layer.9.intermediate.dense.weight'
  AND NOT (matrix_id = 'layer.8.intermediate.dense.weight' AND row_id % 10 = 0)"""),
    "manifests": (("model_matrices",), """
SELECT model, matrix_id AS name, [CAST(count(*) AS INTEGER), CAST(max(len(vec)) AS INTEGER)] AS shape,
       CASE WHEN model = 'c' AND matrix_id = 'layer.3.intermediate.dense.weight' THEN 'float16'
            ELSE 'float32' END AS dtype,
       CAST(count(*) * max(len(vec)) AS BIGINT) AS numel, true AS trainable
FROM model_matrices GROUP BY model, matrix_id
UNION ALL
SELECT model, regexp_replace(matrix_id, 'weight$', 'bias') AS name, [CAST(max(len(vec)) AS INTEGER)] AS shape,
       'float32' AS dtype, CAST(max(len(vec)) AS BIGINT) AS numel, model <> 'b' AS trainable
FROM model_matrices GROUP BY model, matrix_id"""),
    "results": ((), """
SELECT p_brand AS model_name, p_type AS task_name, round(avg(p_size) / 50, 6) AS score
FROM part GROUP BY p_brand, p_type"""),
    "catalog": ((), """
SELECT DISTINCT source AS dataset_id FROM documents
UNION ALL
SELECT DISTINCT concat(source, '-eval-holdout') AS dataset_id FROM documents WHERE length(source) = 4"""),
    "batches": ((), """
SELECT conv_id AS batch_id, turn,
       [concat('conv', CAST(conv_id AS VARCHAR), '-', CAST(floor(turn / 2) AS BIGINT))] AS identifier,
       CASE WHEN turn % 5 = 4 THEN [role, 'mixed'] ELSE [role] END AS dataset_id,
       length(text) - length(replace(text, ' ', '')) + 1 AS n_words
FROM conversations"""),
}


def with_views(*names: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order) + "\n"

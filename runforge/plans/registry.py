"""Registry of the checked queries: one Spark callable and one DuckDB SQL per operator.

Each registered callable takes ``(spark, sf_dir)`` and returns a DataFrame over
the driver tables (or views Spark derives from them). Doubles are rounded to 6
places on both sides so that summation order does not decide the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every float/double column (and double arrays) to ``places``."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            cols.append(F.transform(f.name, lambda x: F.round(x.cast("double"), places)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r6(expr: str) -> str:
    """SQL side of :func:`rounded` for one expression."""
    return f"round(CAST({expr} AS DOUBLE), 6)"


def load_all() -> None:
    """Import every suite module so their ``register`` calls run."""
    from runforge.plans import (suite_corpus, suite_io, suite_matrices,  # noqa: F401
                                suite_runlog, suite_sampling, suite_streaming, suite_vectors,
                                suite_windows)

"""Deterministic, portable pseudo-random draws.

A draw is the first 32 bits of ``md5(seed|key|purpose)``. The same number is
reproduced by DuckDB as ``('0x' || substr(md5(..), 1, 8))::BIGINT``, so every
sampled operator can be checked against SQL. ``xxhash64`` would be faster but
is not portable across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2 ** 32)


def _parts(*parts) -> list[Column]:
    out = []
    for p in parts:
        if isinstance(p, Column):
            out.append(p.cast("string"))
        else:
            out.append(F.lit(str(p)))
    return out


def draw_int(*parts) -> Column:
    """Unsigned 32-bit integer drawn from md5 of the '|'-joined parts."""
    h = F.md5(F.concat_ws("|", *_parts(*parts)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def draw_uniform(*parts) -> Column:
    """Uniform double in [0, 1) from the same hash."""
    return draw_int(*parts) / F.lit(TWO_32)


def draw_index(n: Column, *parts) -> Column:
    """Uniform integer in [0, n) (n > 0)."""
    return F.floor(draw_uniform(*parts) * n).cast("bigint")


def sql_draw_int(expr_sql: str) -> str:
    """DuckDB spelling of :func:`draw_int` for an already '|'-joined string."""
    return f"('0x' || substr(md5({expr_sql}), 1, 8))::BIGINT"

"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import re

import pytest

import __spark_entry__ as E
from check_oracle import compare, duck_con

from conftest import SF01

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_con(SF01)


def test_every_query_has_oracle_or_is_declared():
    rows_only = {"K2_spectral_stats", "K3_aggregate_spectral", "K4_spectral_wide"}
    # the training-data queries (opN_, pipeline) have tests of their own, beside their subpackage
    own = {n for n in QUERIES if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own - set(ORACLE) == rows_only
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    msg = compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert msg is None, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["batch", "n_records", "n_full", "n_short", "n_ids"]

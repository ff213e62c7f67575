"""Every registered query with an oracle must equal its DuckDB SQL (sf0.001);
queries without one must at least run and keep a stable schema."""
import pytest

import __spark_entry__ as E
from tessera.plans import catalog
from tessera.plans.oracle import compare, duck_connection, type_mismatches

SF = "/root/testdata/sf0.001"
catalog.load()  # the corpus operators have tests of their own
SLOW = {"model_folds_mlp", "model_folds_svm_rff", "model_folds_forest", "model_arms_non_heuristic"}


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    ok, msg = compare(df, con, catalog.ORACLE[name])
    assert ok, msg
    assert type_mismatches(df, con, catalog.ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE) - SLOW))
def test_runs_without_oracle(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() >= 0 and len(df.columns) > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "score" in df.columns

"""Plan guards: no cartesian products or nested-loop joins anywhere, Python
only where documented (distinct-token stemming), and pruned scans."""
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load()  # the corpus operators have tests of their own
# These fit models or run streams before there is a plan to look at.
NOT_PLANNED_HERE = {"model_folds_mlp", "model_folds_svm_rff", "model_folds_forest", "model_folds_logistic",
                    "model_arms_non_heuristic", "model_batch_scores", "stream_upsert_events", "stream_credit_events",
                    "glossary_folds_logistic", "glossary_folds_forest", "glossary_folds_mlp", "glossary_folds_svm_rff",
                    "glossary_arms_non_heuristic", "glossary_model_metrics", "stream_credit_ordered"}
PYTHON_OK = {"credit_fold_events"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - NOT_PLANNED_HERE))
def test_no_quadratic_joins(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_OK:
        assert "EvalPython" not in plan and "PythonUDF" not in plan and "MapInPandas" not in plan


def test_documents_scan_is_pruned(spark):
    plan = plan_of(catalog.QUERIES["text_clean_phrase"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(catalog.QUERIES["relations_all"](spark, SF))
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,LARGE)]" in plan

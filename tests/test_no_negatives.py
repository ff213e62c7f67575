"""A vocabulary whose pairs are all golden leaves no negative pair: the labelled set is the golden pairs alone."""
from itertools import combinations

import pytest

from tessera.plans import q_models, q_pairs


@pytest.fixture(scope="module")
def all_paired(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("paired"))
    names = [f"{a} {b}" for a in ("red", "old") for b in ("bolt", "gear", "ring")]
    rows = [(2 * i + k, name, f"Brand#{i}", "PROMO") for i, pair in enumerate(combinations(names, 2)) for k, name in enumerate(pair)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(0, "see also old bolt")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_no_negative_is_left(spark, all_paired):
    assert q_pairs.negative_pairs(spark, all_paired).count() == 0
    assert [tuple(r) for r in q_models.label_codec(spark, all_paired).collect()] == [("yes", 0)]


def test_models_train_on_one_class(spark, all_paired):
    rows = q_models._folds_query("logistic")(spark, all_paired).collect()
    assert sorted(r["fold"] for r in rows) == list(range(10)) and sum(r["tp"] for r in rows) == 10
    assert q_models.model_batch_scores(spark, all_paired).filter("p_yes = 1.0 and pred_yes").count() == 12

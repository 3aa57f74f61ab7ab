"""The model queries fit the usual models on the whole feature matrix."""

import pytest

from barloom.operators import features
from barloom.operators.scaling import feature_columns
from barloom.plans import training as tr
from barloom.workload import training as queries
from barloom.workload.fixtures import QUERIES

TREES = {"random_forest": ("getNumTrees", 100), "gradient_boosting": ("getMaxIter", 100), "xgboost": ("getMaxIter", 200)}
RUNS = {f"train_{k}": k for k in tr.MODELS} | {q: "random_forest" for q in ("train_pipeline", "score_batch", "model_store", "signal_from_model")}


class Reached(Exception):
    pass


@pytest.mark.parametrize("name", RUNS)
def test_full_models_on_the_whole_matrix(spark, monkeypatch, name):
    def train(matrix, config=tr.TrainingConfig()):
        raise Reached(config, feature_columns(matrix))

    monkeypatch.setattr(tr, "train", train)
    for module in (queries, tr, features):
        monkeypatch.setattr(module, "materialize", lambda df: df, raising=False)
    with pytest.raises(Reached) as got:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    config, columns = got.value.args
    getter, trees = TREES[RUNS[name]]
    assert config.model == RUNS[name] and getattr(tr.classifier(config.model, config.trees), getter)() == trees
    assert len(columns) > 50

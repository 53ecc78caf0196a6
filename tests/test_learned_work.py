"""The learned queries are registered with the full work: vocabulary, trees, rounds, folds, trials, epochs."""

import inspect

import pytest

from veriscope.learning import boosting, network, text_forests
from veriscope.plans import learned


class Called(Exception):
    pass


@pytest.fixture
def seen(monkeypatch):
    """What the queries ask for, bound to the functions' parameters; nothing is fitted."""
    found = {}

    def stand_in(name, function):
        def call(*args, **options):
            bound = inspect.signature(function).bind(*args, **options)
            bound.apply_defaults()
            found[name] = bound.arguments
            raise Called

        monkeypatch.setattr(learned, name, call)

    for name in ("forest_predictions", "boosted_predictions", "forest_importances", "boosted_importances", "forest_curve",
                 "forest_search", "fit_network", "difficulty_importances"):
        stand_in(name, getattr(learned, name))
    return found


def run(query, spark, sf_dir):
    with pytest.raises(Called):
        learned.QUERIES[query](spark, sf_dir)


def test_trees(spark, sf_dir, seen):
    for query, name in (("rf_predictions", "forest_predictions"), ("feature_importance", "forest_importances")):
        run(query, spark, sf_dir)
        assert (seen[name]["trees"], seen[name]["vocabulary"], seen[name]["how"]) == (705, 5000, {})
        spec = text_forests.forest_spec(5001, **seen[name]["how"])
        assert (spec.depth, spec.min_split, spec.min_leaf, spec.subset, spec.bootstrap) == (38, 6, 1, 12, True)
    for query, name in (("gbt_predictions", "boosted_predictions"), ("boosted_importance", "boosted_importances")):
        run(query, spark, sf_dir)
        how = seen[name]["how"]
        assert how == boosting.Boosting() and (how.rounds, how.depth, how.least) == (100, 10, 6) and seen[name]["vocabulary"] == 5000
        assert (round(how.ridge, 4), round(how.lasso, 4), round(how.price, 4)) == (0.1408, 0.3606, 3.6551)
    run("difficulty_importance", spark, sf_dir)
    assert (seen["difficulty_importances"]["trees"], seen["difficulty_importances"]["depth"]) == (100, 30)


def test_curve_and_search(spark, sf_dir, seen):
    run("learning_curve", spark, sf_dir)
    asked = seen["forest_curve"]
    assert asked["folds"] == 3 and asked["fractions"] == pytest.approx((0.3, 0.475, 0.65, 0.825, 1.0))
    assert asked["vocabulary"] == 5000 and asked["trees"] == 705 and asked["how"] == {}
    run("param_search", spark, sf_dir)
    asked = seen["forest_search"]
    assert asked["trials"] == 30 and asked["space"] == text_forests.SPACE and asked["vocabulary"] == 5000
    assert asked["space"]["trees"] == ("int", 100, 1000) and asked["space"]["depth"] == ("int", 5, 50)


def test_network(spark, sf_dir, seen):
    for query in ("mlp_history", "mlp_best_epoch", "mlp_predictions"):
        run(query, spark, sf_dir)
        asked = seen["fit_network"]
        assert (asked["epochs"], asked["patience"], asked["hidden"], asked["batch"], asked["dropout"]) == (50, 5, (256, 128), 512, 0.2)
        assert asked["train"].columns == asked["held"].columns and network.MOST_STEPS == 64

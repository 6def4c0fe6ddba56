"""Model queries cover every target and split on all features."""

import pytest

import __spark_entry__ as entry
from antecede.catalog import model_queries

FOLDER = "/root/testdata/sf0.001"
TARGETS = {"strikeouts", "outs_recorded", "batters_faced", "pitches_thrown"}


@pytest.mark.parametrize("name", ["holdout_predictions", "production_refit"])
def test_every_target_is_forecast(spark, name):
    rows = entry.queries()[name](spark, FOLDER).groupBy("target").count().collect()
    assert {r.target for r in rows} == TARGETS and len({r["count"] for r in rows}) == 1


def test_volume_rate_runs_on_all_features(spark, monkeypatch):
    families, choose = [], model_queries.S.feature_columns
    monkeypatch.setattr(model_queries.S, "feature_columns", lambda f, family, *a: families.append(family) or choose(f, family, *a))
    assert entry.queries()["model_volume_rate_k"](spark, FOLDER).count() > 0 and families == ["full"]


def test_walk_forward_has_every_split_and_target(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(model_queries.M, "walk_forward", lambda f, splits, targets, family="full", models=(), *a, **k: calls.append((splits, targets, family, models)))
    entry.queries()["walk_forward"](spark, FOLDER)
    (splits, targets, family, models), = calls
    assert [s[2] for s in splits] == [1996, 1997, 1998, 1999, 2000] and set(targets) == TARGETS
    assert family == "full" and set(models) == {"ridge", "poisson", "volume_rate"}


def test_ablation_has_every_family_split_and_target_at_the_published_rounds(spark, monkeypatch):
    import inspect

    calls, signature = [], inspect.signature(model_queries.M.ablation)
    monkeypatch.setattr(model_queries.M, "ablation", lambda *a, **k: calls.append(signature.bind(*a, **k)))
    entry.queries()["ablation"](spark, FOLDER)
    (call,) = calls
    call.apply_defaults()
    given = call.arguments
    assert [s[2] for s in given["splits"]] == [1996, 1997, 1998, 1999, 2000] and set(given["targets"]) == TARGETS
    assert len(given["families"]) == 5 and given["rounds"] == model_queries.M.TREE_ROUNDS == 180


@pytest.mark.parametrize("kind, tolerance", [("ridge", 1e-6), ("poisson", 1e-4)])
def test_fits_on_all_features_solve_their_equations(spark, kind, tolerance):
    t = entry.Tables(spark, FOLDER)
    fold, test, columns, _ = model_queries._fold(t)
    assert len(columns) > 100
    model = model_queries.M.fit(fold, columns, "strikeouts", kind)
    assert model_queries.M.unsolved(model, fold.train, "strikeouts", kind) < tolerance
    rows = entry.queries()[f"model_{kind}"](spark, FOLDER).collect()
    assert len(rows) == test.count() and all(r.prediction is not None and r.prediction == r.prediction for r in rows)


def test_importance_lists_every_feature_and_none_for_a_constant(spark):
    rows = entry.queries()["permutation_importance"](spark, FOLDER).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) > 100
    gains = [r.importance_mae_increase for r in rows]
    assert gains == sorted(gains, reverse=True)
    frame = spark.createDataFrame([(2020, i, 1, float(i % 7), 1.0, float(i % 7)) for i in range(200)], "season long, game_id long, pitcher_mlbam_id long, a double, same double, y double")
    model = model_queries.M.fit(frame, ["a", "same"], "y", "ridge")
    top = {r.feature: r.importance_mae_increase for r in model_queries.M.permutation_importance(model, frame, ["a", "same"], "y").collect()}
    assert top["a"] > 0 and abs(top["same"]) < 1e-12

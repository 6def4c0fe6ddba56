"""Spark ML estimators against closed forms, and leak-free preparation."""

from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.operators import models as M


@pytest.fixture(scope="module")
def frame(spark):
    random = Random(2)
    rows = []
    for i in range(300):
        a, b = random.gauss(0, 1), random.gauss(3, 2)
        y = float(np.random.default_rng(i).poisson(np.exp(0.4 + 0.3 * a)))
        rows.append((2020 + i % 3, i, i % 9, a, None if i % 7 == 0 else b, None, y, 20.0 + i % 5))
    return spark.createDataFrame(
        rows,
        "season long, game_id long, pitcher_mlbam_id long, a double, b double, empty double, strikeouts double, batters_faced double",
    ).persist()


def matrix(frame):
    rows = frame.orderBy("game_id").collect()
    b = np.array([np.nan if r["b"] is None else r["b"] for r in rows])
    missing = np.isnan(b).astype(float)
    b = np.where(np.isnan(b), np.nanmedian(b), b)
    x = np.column_stack([[r["a"] for r in rows], b, missing])
    return (x - x.mean(0)) / x.std(0), np.array([r["strikeouts"] for r in rows])


def test_ridge_equals_the_normal_equations(frame):
    model = M.fit(frame, ["a", "b", "empty"], "strikeouts", "ridge")
    x, y = matrix(frame)
    w = np.linalg.solve(x.T @ x + 10.0 * np.eye(3), x.T @ (y - y.mean()))
    got = [r["prediction"] for r in M.predict(model, frame).orderBy("game_id").collect()]
    assert got == pytest.approx(list(x @ w + y.mean()), abs=1e-6)


def test_poisson_equals_newton_steps(frame):
    model = M.fit(frame, ["a", "b", "empty"], "strikeouts", "poisson")
    x, y = matrix(frame)
    x1 = np.column_stack([np.ones(len(y)), x])
    penalty = 0.1 * np.diag([0.0, 1.0, 1.0, 1.0])
    w = np.array([np.log(y.mean()), 0.0, 0.0, 0.0])
    for _ in range(50):
        mu = np.exp(x1 @ w)
        w -= np.linalg.solve(x1.T @ (x1 * mu[:, None]) / len(y) + penalty, x1.T @ (mu - y) / len(y) + penalty @ w)
    got = [r["prediction"] for r in M.predict(model, frame).orderBy("game_id").collect()]
    assert got == pytest.approx(list(np.exp(x1 @ w)), rel=1e-4)


def test_folds_and_importance(frame, tmp_path):
    train, test = frame.where("season < 2022"), frame.where("season = 2022")
    rows = M.fold_predictions(train, test, ["a", "b"], "strikeouts", "s", rounds=3)
    wide = rows.groupBy("game_id").pivot("model", list(M.MODELS)).agg(F.first("prediction")).collect()
    assert len(wide) == test.count()
    assert all(r["ensemble"] == pytest.approx((r["ridge"] + r["boosted_trees"]) / 2) for r in wide)
    assert all(0 <= r["volume_rate"] <= 30 for r in wide)
    model = M.final_fit(frame, 2021, ["a", "b"], "strikeouts", "ridge", str(tmp_path / "m"))
    top = M.permutation_importance(model, test, ["a", "b"], "strikeouts", group=50).orderBy("rank").collect()
    assert [r["feature"] for r in top] == ["a", "b"] and top[0]["importance_mae_increase"] > 0


def test_medians_of_many_columns_equal_sorting(spark, monkeypatch):
    random = Random(6)
    kinds = [lambda: random.gauss(0, 1), lambda: float(random.randrange(3)), lambda: None, lambda: random.choice([None, 1.0]), lambda: 7.5, lambda: random.choice([0.0, 1e9])]
    names = [f"c{k}" for k in range(24)]
    rows = [tuple(kinds[k % 6]() for k in range(24)) for _ in range(1501)] + [tuple(None for _ in names)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)

    def plain(k):
        known = sorted(r[k] for r in rows if r[k] is not None)
        return None if not known else (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2

    for accuracy in (M.BRACKET_ACCURACY, 7):  # a sketch so coarse that its bracket may miss
        monkeypatch.setattr(M, "BRACKET_ACCURACY", accuracy)
        got = {r.column_name: (r.median, r.missing) for r in M.column_medians(df, names).collect()}
        for k, n in enumerate(names):
            assert got[n] == (pytest.approx(plain(k)) if plain(k) is not None else None, sum(r[k] is None for r in rows))
    assert [r.median for r in M.column_medians(df.limit(0), names[:2]).collect()] == [None, None]


def test_linear_importance_equals_forecasting_every_variant(frame, monkeypatch):
    columns = ["a", "b", "empty"]
    model = M.fit(frame, columns, "strikeouts", "ridge")
    rows = lambda: {r.feature: r for r in M.permutation_importance(model, frame, columns, "strikeouts", group=50).collect()}
    seen = []
    monkeypatch.setattr(M, "predict", lambda *a, f=M.predict: seen.append(a) or f(*a))
    fast = rows()
    assert not seen  # no variant goes through the model
    monkeypatch.setattr(M, "_contributions", lambda *a: None)
    slow = rows()
    assert seen and set(fast) == set(slow) == set(columns)
    for c in columns:
        assert fast[c].importance_mae_increase == pytest.approx(slow[c].importance_mae_increase, abs=1e-9)
        assert (fast[c].rows, fast[c].variants) == (slow[c].rows, slow[c].variants) == (300, 900)


def test_a_fold_is_prepared_once_for_all_targets_and_products(frame, monkeypatch):
    made = []
    monkeypatch.setattr(M, "preparation", lambda *a, f=M.preparation: made.append(1) or f(*a))
    wide = frame.withColumn("outs_recorded", F.col("strikeouts") * 2)
    fold = M.Fold(wide, ["a", "b", "empty"])
    for target in ("strikeouts", "outs_recorded"):
        M.fold_predictions(fold, wide, fold.columns, target, "s", ("ridge", "poisson", "volume_rate"))
    assert len(made) == 1 and len(fold.fitted) == 7  # two ridges, two Poissons, two rates, one volume


def test_moments_of_filled_columns_equal_filling(frame):
    facts = M.column_facts(frame, ["a", "b", "batters_faced"])
    medians = {r.column_name: r.median for r in M.column_medians(frame, list(facts), facts).collect()}
    scale = M.imputed_scale(facts, medians, ["b"])
    for name, sql in M.imputed(list(facts), medians, ["b"]).items():
        mean, std = frame.selectExpr(f"avg({sql})", f"stddev_pop({sql})").first()
        assert (scale[f"mean_{name}"], scale[f"std_{name}"]) == (pytest.approx(mean), pytest.approx(std))


def test_ridge_assembles_no_rows_and_facts_take_one_pass(frame, monkeypatch):
    """A ridge follows from sums of products, so no vector per row is made and kept; the facts of all columns are one pass."""
    monkeypatch.setattr(M.Fold, "ready", lambda *a: pytest.fail("rows were assembled"))
    wide = frame.repartition(7).withColumn("y", F.when(F.col("game_id") % 5 > 0, F.col("strikeouts")))
    model = M.fit(wide, ["a", "b", "empty"], "y", "ridge")
    assert M.unsolved(model, wide, "y", "ridge") < 1e-9
    facts = M.Packed(wide, ["a", "b", "empty"]).facts
    for c in ("a", "b"):
        row = wide.agg(F.count(c), F.avg(c), F.var_pop(c), F.min(c), F.max(c)).first()
        assert [facts[c][k] for k in ("n", "mean", "var", "low", "high")] == pytest.approx(list(row))
    assert facts["empty"] == {"rows": 300, "n": 0, "mean": None, "var": None, "low": None, "high": None}


def test_assembled_rows_come_in_parts_of_bounded_size(frame, monkeypatch):
    monkeypatch.setattr(M, "READY_BYTES", 50 * 3 * 8)
    fold = M.Fold(frame.coalesce(1), ["a", "b", "empty"])
    sizes = [r["count"] for r in fold.ready("strikeouts", True)[0].groupBy(F.spark_partition_id()).count().collect()]
    fold.release()
    assert sum(sizes) == 300 and max(sizes) <= 120


def test_linear_folds_share_one_written_table_and_forecast_in_one_pass(frame, monkeypatch):
    """No vector per row is made for a Poisson fit, the table is packed once for all folds, and forecasts are those of the models."""
    from antecede.operators import packed as P

    written = []
    monkeypatch.setattr(M.Fold, "ready", lambda *a: pytest.fail("rows were assembled"))
    monkeypatch.setattr(P, "stage", lambda df, label, *a, f=P.stage: written.append(label) or f(df, label, *a))
    columns = ["season_a", "season_b", "season_empty"]
    wide = frame.select("*", *[F.col(c.removeprefix("season_")).alias(c) for c in columns]).drop("a", "b", "empty")
    wide = wide.withColumn("outs_recorded", F.when(F.col("game_id") % 5 > 0, F.col("strikeouts") * 2))
    splits = [("one", [2020], 2021), ("two", [2020, 2021], 2022)]
    rows = M.walk_forward(wide, splits, ("strikeouts", "outs_recorded"), models=M.LINEAR)
    assert written.count("values") == 1
    got = {(r.split, r.target, r.model, r.game_id): (r.prediction, r.actual) for r in rows.collect()}
    assert len(got) == 200 * 2 * 3
    for split, seasons, season in splits:
        fold = M.Fold(wide.where(F.col("season").isin(*seasons)), columns)
        test = wide.where(F.col("season") == season)
        for target in ("strikeouts", "outs_recorded"):
            every = [(kind, M.predict(M.fit(fold, columns, target, kind), test)) for kind in ("ridge", "poisson")]
            every.append(("volume_rate", M.volume_rate_forecast(fold, test, columns, target, "prediction")))
            for model, known in every:
                for r in known.collect():
                    assert got[split, target, model, r.game_id] == (pytest.approx(r.prediction, rel=1e-9), r[target])


def test_families_of_an_ablation_share_packed_folds_and_targets_are_fitted_side_by_side(frame, monkeypatch):
    from threading import Barrier

    from antecede.operators import packed as P

    written, medians, together = [], [], Barrier(4, timeout=120)
    monkeypatch.setattr(P, "stage", lambda df, label, *a, f=P.stage: written.append(label) or f(df, label, *a))
    monkeypatch.setattr(M, "column_medians", lambda *a, f=M.column_medians: medians.append(1) or f(*a))
    monkeypatch.setattr(M, "boosted_trees", lambda *a, f=M.boosted_trees: together.wait() >= 0 and f(*a))  # all four fits or none
    wide = frame.select("*", F.col("a").alias("season_a"), F.col("b").alias("opponent_b"), (F.col("strikeouts") * 2).alias("outs_recorded")).drop("a", "b", "empty")
    splits = [("one", [2020], 2021), ("two", [2020, 2021], 2022)]
    targets, families = ("strikeouts", "outs_recorded"), ("pitcher_history", "opponent")
    got = {(r.feature_family, r.split, r.target): (r.mae, r.n) for r in M.ablation(wide, splits, targets, families, rounds=3).collect()}
    assert len(got) == 8 and written.count("values") == 1 and len(medians) == 2
    monkeypatch.setattr(M, "boosted_trees", lambda *a, f=M.GBTRegressor: f(featuresCol="inputs", labelCol=a[0], maxIter=a[1], stepSize=0.05, maxDepth=4, seed=42))
    for family, columns in (("pitcher_history", ["season_a"]), ("opponent", ["season_a", "opponent_b"])):
        for split, seasons, season in splits:
            known = wide.where(F.col("season") == season)
            model = M.fit(wide.where(F.col("season").isin(*seasons)), columns, "strikeouts", "boosted_trees", 3)
            mae = M.predict(model, known).agg(F.avg(F.abs(F.greatest("prediction", F.lit(0.0)) - F.col("strikeouts")))).first()[0]
            assert got[family, split, "strikeouts"] == (pytest.approx(mae, rel=1e-9), 100)

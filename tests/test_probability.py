"""Tails, residual distributions, quantiles, calibration and diagnostics against brute force."""

import math
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.functions.quantiles import exact_quantiles
from antecede.functions.tails import negative_binomial_over, poisson_over
from antecede.operators import calibration as C
from antecede.operators import diagnostics as G
from antecede.operators import distributions as D
from antecede.operators import scoring as S


def poisson_tail(mu, line):
    return 1 - sum(math.exp(-mu + k * math.log(mu) - math.lgamma(k + 1)) for k in range(math.floor(line) + 1))


def nb_tail(mu, line, alpha):
    n = 1 / alpha
    p = n / (n + mu)
    terms = (
        math.exp(math.lgamma(k + n) - math.lgamma(n) - math.lgamma(k + 1) + n * math.log(p) + k * math.log(1 - p))
        for k in range(math.floor(line) + 1)
    )
    return 1 - sum(terms)


def test_tails(spark):
    cases = [(m, line, a) for m in (0.0, 0.3, 5.5, 17.2) for line in (0.5, 4.5, 10.5, 21.5) for a in (1e-6, 0.05, 2.0)]
    df = spark.createDataFrame(cases, "m double, line double, a double")
    rows = df.select("*", poisson_over("m", F.col("line")).alias("p"), negative_binomial_over("m", F.col("line"), "a").alias("nb")).collect()
    for r in rows:
        mu = max(r["m"], 1e-6)
        assert r["p"] == pytest.approx(poisson_tail(mu, r["line"]), abs=1e-12)
        want = poisson_tail(mu, r["line"]) if r["a"] <= 1e-6 else nb_tail(mu, r["line"], r["a"])
        assert r["nb"] == pytest.approx(want, abs=1e-10)
    fixed = df.where("line = 4.5").select("m", "a", poisson_over("m", 4.5).alias("p"), negative_binomial_over("m", 4.5, "a").alias("nb"))
    for r in fixed.collect():
        mu = max(r["m"], 1e-6)
        assert r["p"] == pytest.approx(poisson_tail(mu, 4.5), abs=1e-12)
        if r["a"] > 1e-6:
            assert r["nb"] == pytest.approx(nb_tail(mu, 4.5, r["a"]), abs=1e-10)


def test_quantiles_match_numpy_with_a_hot_value(spark):
    random = Random(1)
    values = {"a": [random.random() for _ in range(3000)] + [0.5] * 1500, "b": [3.0], "c": [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    ps = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]
    for row in exact_quantiles(df, ["g"], "v", ps).collect():
        assert row["quantiles"] == pytest.approx(np.quantile(values[row["g"]], ps), abs=1e-12)
    whole = exact_quantiles(df, [], "v", [0.5]).first()["quantiles"][0]
    assert whole == pytest.approx(np.median([v for vs in values.values() for v in vs]))


def simulated(spark, n=1500, seed=3):
    random = Random(seed)
    rows = []
    for i in range(n):
        mean = random.choice([2.0, 2.5, 3.25, 5.0, 5.5, 7.0]) if i % 3 else 4.0
        rows.append((2022 + i % 3, i, i % 40, "strikeouts", float(np.random.default_rng(i).poisson(mean)), mean))
    return rows, spark.createDataFrame(rows, "season long, game_id long, pitcher_mlbam_id long, target string, actual double, prediction double")


@pytest.mark.parametrize("conditional", [False, True])
def test_empirical_probabilities_match_brute_force(spark, conditional):
    rows, df = simulated(spark)
    grid = {"strikeouts": (2.5, 4.5, 6.5)}
    out = D.empirical_probabilities(df.where("season = 2024"), df.where("season < 2024"), ["target"], conditional, grid, min_size=150)
    past = [(r[5], round(r[4] - r[5], 9)) for r in rows if r[0] < 2024]
    edges = np.unique(np.quantile([p for p, _ in past], np.linspace(0, 1, 6)))[1:-1]
    pools = {}
    for p, residual in past:
        pools.setdefault(int(np.digitize(p, edges)), []).append(residual)
    everything = [residual for _, residual in past]
    got = out.collect()
    assert len(got) == 3 * sum(r[0] == 2024 for r in rows)
    for r in got:
        pool = everything
        if conditional:
            own = pools.get(int(np.digitize(r["prediction"], edges)), [])
            pool = own if len(own) >= 150 else everything
        want = np.mean(np.array(pool) > round(r["line"] - r["prediction"], 9))
        assert r["probability_over"] == pytest.approx(min(max(want, 1e-6), 1 - 1e-6), abs=1e-12)


def test_constant_prediction_has_one_bin(spark):
    df = spark.createDataFrame([(2023, i, 1, "k", float(i % 5), 2.0) for i in range(20)], "season long, game_id long, pitcher_mlbam_id long, target string, actual double, prediction double")
    assert D.bin_edges(df, ["target"]).first()["edges"] == []


def test_dispersion_floor(spark):
    df = spark.createDataFrame([("k", 2.0, 2.0)], "target string, actual double, prediction double")
    assert D.fit_dispersion(df, ["target"]).first()["alpha"] == 1e-6


def test_calibration_bins_are_closed_on_the_right(spark):
    ps = [0.0, 0.1, 0.1000001, 0.3, 0.30000000000000004, 0.95, 1.0]
    df = spark.createDataFrame([("k", p, 1) for p in ps], "target string, probability_over double, actual_over int")
    table = {r["bin"]: r["n"] for r in C.calibration_table(df).collect()}
    assert table == {0: 2, 1: 1, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 2}
    ece = C.expected_calibration_error(C.calibration_table(df)).first()[1]
    assert 0 < ece < 1


def test_monotonicity_ignores_gaps(spark):
    rows = [(1, "k", 0.5, 0.5), (1, "k", 1.5, 0.6), (2, "k", 0.5, 0.5), (2, "k", 2.5, 0.9), (1, "k", 2.5, 0.6)]
    df = spark.createDataFrame(rows, "game_id long, target string, line double, probability_over double")
    assert C.monotonicity_violations(df, key=("game_id",)).first()["monotonicity_violations"] == 1


def test_high_probability_buckets(spark):
    df = spark.createDataFrame([("k", p, 1) for p in (0.5499, 0.55, 0.6, 0.7, 1.0)], "target string, probability_over double, actual_over int")
    assert {r["bucket"]: r["n"] for r in C.calibration_buckets(df).collect()} == {"55-60%": 1, "60-65%": 1, "70%+": 2}


def predictions(spark):
    rows = [(2022, 1, 1, "k", "m", "s", 4.0, 5.0), (2022, 2, 1, "k", "m", "s", 6.0, 5.5), (2022, 3, 2, "k", "m", "s", 0.0, -1.0), (2022, 4, 2, "k", "m", "s", 3.0, 3.0)]
    return spark.createDataFrame(rows, "season long, game_id long, pitcher_mlbam_id long, target string, model string, split string, actual double, prediction double")


def test_point_scores(spark):
    row = S.point_scores(predictions(spark)).first()
    assert row["mae"] == pytest.approx((1 + 0.5 + 0 + 0) / 4) and row["n"] == 4
    assert row["correlation"] == pytest.approx(np.corrcoef([4, 6, 0, 3], [5, 5.5, 0, 3])[0, 1])
    terms = [2 * (y * math.log(y / p) - y + p) for y, p in ((4, 5), (6, 5.5), (3, 3))] + [2e-9]
    assert row["poisson_deviance"] == pytest.approx(np.mean(terms))
    flat = predictions(spark).withColumn("prediction", F.lit(2.0))
    assert S.point_scores(flat).first()["correlation"] == 0.0


def test_residual_summary_uses_the_sample_skew(spark):
    row = G.residual_summary(predictions(spark)).first()
    e = np.array([1.0, -0.5, -1.0, 0.0])
    n, d = len(e), e - e.mean()
    skew = (d**3).mean() / (d**2).mean() ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    assert row["residual_skew"] == pytest.approx(skew) and row["zero_clipped_predictions"] == 1
    assert row["residual_p05"] == pytest.approx(np.quantile(e, 0.05))


def test_bucketed_errors_cover_four_groupings(spark):
    context = spark.createDataFrame(
        [(2022, g, p, "R", starts) for g, p, starts in ((1, 1, 0), (2, 1, 9), (3, 2, 1), (4, 2, 8))],
        "season long, game_id long, pitcher_mlbam_id long, pitcher_handedness string, pitcher_starts_before_game long",
    )
    rows = G.bucketed_errors(predictions(spark), context).collect()
    kinds = {}
    for r in rows:
        kinds[r["bucket_type"]] = kinds.get(r["bucket_type"], 0) + r["n"]
    assert kinds == {"season": 4, "pitcher_handedness": 4, "projection_tier": 4, "experience_bucket": 4}


def test_splits_and_winners(spark):
    seasons = spark.createDataFrame([(s,) for s in (2021, 2022, 2023, 2024, 2025)], "season long")
    rows = S.chronological_splits(seasons, 2025).collect()
    names = {}
    for r in rows:
        names.setdefault(r["split"], []).append(r["train_season"])
    assert {k: sorted(v) for k, v in names.items()} == {
        "train_2021_2021_validate_2022": [2021],
        "train_2021_2022_validate_2023": [2021, 2022],
        "train_2021_2023_validate_2024": [2021, 2022, 2023],
    }
    scores = spark.createDataFrame([("k", "b", 1.0), ("k", "a", 1.0), ("o", "a", 2.0), ("o", "b", 1.5)], "target string, model string, mae double")
    assert {r["target"]: r["model"] for r in S.select_winners(scores).collect()} == {"k": "a", "o": "b"}


def test_families_are_cumulative(spark):
    names = ["season", "strikeouts", "season_k_pct", "month", "season_pitches_per_start", "opponent_team_k_pct", "last3_k_pct", "pitch_FF_usage"]
    df = spark.createDataFrame([tuple(1.0 for _ in names)], names)
    sizes = [S.feature_columns(df, f) for f in ("pitcher_history", "workload", "opponent", "recent", "full")]
    assert [len(s) for s in sizes] == [2, 3, 4, 5, 6]
    assert all(set(a) < set(b) for a, b in zip(sizes, sizes[1:]))
    with pytest.raises(ValueError):
        S.feature_columns(df, "other")


def test_block_borders_are_fixed_before_they_are_used_twice(spark):
    from antecede.functions import quantiles as Q

    df = spark.range(3000).selectExpr("id % 2 as g", "cast(id * 7 % 3001 as double) as v")
    blocked, starts = Q.block_counts(Q.value_counts(df, ["g"], "v"), ["g"])
    for table in (blocked, starts):  # a sketch in the plan would be made anew by each reader, with other borders
        assert "percentile_approx" not in table._jdf.queryExecution().toString()
    totals = blocked.groupBy("g", "block").agg(F.sum("n").alias("block_n"))
    assert totals.join(starts, ["g", "block", "block_n"]).count() == starts.count() == totals.count()


@pytest.mark.parametrize("how", ["conditional", "frozen"])
def test_shares_do_not_depend_on_a_sketch_that_cuts_differently_each_time(spark, monkeypatch, how):
    from antecede.operators import bundle as B

    sketch = F.percentile_approx
    moved = F.udf(lambda borders: [b + Random().uniform(-40, 40) for b in borders], "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a: F.array_sort(moved(sketch(*a))))
    counts = spark.range(900).selectExpr("'g' as target", "-1L as bin", "cast(id * 7 % 901 as double) as value", "1 + id % 3 as n")
    asked = spark.range(300).selectExpr("'g' as target", "-1L as bin", "cast(id * 3 as double) + 0.5 as threshold")
    if how == "conditional":
        rows = D.shares_above(counts, asked, ["target", "bin"])
    else:
        rows = B.ResidualTable(counts, None, ("target",)).shares_above(asked)
    pairs = [(r.value, r.n) for r in counts.collect()]
    total, got = sum(n for _, n in pairs), {r.threshold: r.share for r in rows.collect()}
    assert got == {k * 3 + 0.5: sum(n for v, n in pairs if v > k * 3 + 0.5) / total for k in range(300)}

"""Mergeable residual tables and frozen bundles."""

from random import Random

import pytest
from pyspark.sql import functions as F

from antecede.operators import bundle as B
from antecede.operators import distributions as D
from antecede.operators import models as M
from antecede.operators.quality import QualityError

GRIDS = {"strikeouts": (0.5, 1.5, 2.5, 3.5), "outs_recorded": (2.5, 4.5)}
BOUNDS = {"strikeouts": (0.0, 30.0), "outs_recorded": (0.0, 27.0)}


def points(spark, n, seed, seasons=(2020, 2021, 2022)):
    random, rows = Random(seed), []
    for k in range(n):
        target = random.choice(list(GRIDS))
        prediction = random.choice([None, random.random() * 5, float(round(random.random() * 5))])
        rows.append((random.choice(seasons), k, k % 9, target, random.choice([None, float(random.randrange(7))]), prediction))
    return spark.createDataFrame(rows, "season long, game_id long, pitcher_mlbam_id long, target string, actual double, prediction double")


def listed(df):
    return sorted((r.game_id, r.target, r.line, r.actual_over, None if r.probability_over is None else round(r.probability_over, 12)) for r in df.collect())


@pytest.mark.parametrize("min_size", [5, 10_000])
def test_merged_seasons_equal_a_rebuild_and_the_plain_form(spark, min_size):
    history, new = points(spark, 900, 1).cache(), points(spark, 200, 2, (2023,)).cache()
    known = history.where("prediction IS NOT NULL")
    edges = D.bin_edges(known, ["target"], 4)
    parts = [B.ResidualTable.of(history.where(F.col("season") == s), ["target"], edges) for s in (2020, 2021, 2022)]
    merged = parts[0].merged(*parts[1:])
    rebuilt = B.ResidualTable.of(history, ["target"], edges)
    key = lambda t: sorted(tuple(r) for r in t.counts.select("target", "bin", "value", "n").collect())
    assert key(merged) == key(rebuilt) == key(parts[0].with_history(history.where("season > 2020")))
    got = listed(merged.probabilities(new, GRIDS, min_size, BOUNDS))
    want = listed(D.empirical_probabilities(new, known, ["target"], True, GRIDS, 4, min_size, BOUNDS))
    assert got == want and len(got) > 300


def test_shares_equal_counting(spark):
    history = points(spark, 600, 3)
    table = B.ResidualTable.of(history, ["target"], D.bin_edges(history.where("prediction IS NOT NULL"), ["target"]))
    values = {}
    for r in table.counts.collect():
        values.setdefault((r.target, r.bin), []).extend([r.value] * r.n)
    asked = [(t, b, x) for t, b in values for x in (-99.0, -1.0, 0.0, 0.123, 1.0, 99.0, *values[t, b][:5])]
    got = table.shares_above(spark.createDataFrame(asked, "target string, bin long, threshold double")).collect()
    assert len(got) == len(set(asked))
    for r in got:
        own = values[r.target, r.bin]
        assert r.share == pytest.approx(sum(v > r.threshold for v in own) / len(own))


def test_a_bundle_is_scored_in_another_session_and_guards_its_contents(spark, tmp_path):
    random = Random(4)
    rows = [(2020 + i % 3, i, i % 9, random.gauss(0, 1), float(random.randrange(8)), float(random.randrange(9))) for i in range(300)]
    frame = spark.createDataFrame(rows, "season long, game_id long, pitcher_mlbam_id long, a double, strikeouts double, outs_recorded double")
    past, new = frame.where("season < 2022"), frame.where("season = 2022")
    models = {t: M.fit(past, ["a"], t, "ridge") for t in GRIDS}
    forecasts = B.Bundle(models, ("a",), None, {}).forecasts(past)
    residuals = B.ResidualTable.of(forecasts, ["target"])
    path = str(tmp_path)
    B.freeze(path, models, ["a"], residuals, "v1")
    with pytest.raises(QualityError):
        B.freeze(path, models, ["a"], residuals, "v1")
    other = spark.newSession()
    loaded = B.load(other, path, "v1")
    assert loaded.features == ("a",) and set(loaded.models) == set(GRIDS)
    again = other.createDataFrame(new.collect(), new.schema)
    assert listed(loaded.probabilities(again, GRIDS)) == listed(B.Bundle(models, ("a",), residuals, {}).probabilities(new, GRIDS))
    with pytest.raises(QualityError):
        loaded.forecasts(again.drop("a"))
    with pytest.raises(QualityError):
        B.load(spark, path, "v2")
    residuals.counts.limit(1).write.mode("append").parquet(f"{path}/v1/counts")
    with pytest.raises(QualityError):
        B.load(spark, path, "v1")

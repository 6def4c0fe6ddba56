"""Windows that end strictly before the current row."""

from datetime import date, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from antecede.operators import events as E
from antecede.operators import features as X
from antecede.operators import history as H
from antecede.operators.quality import QualityError

SPEC = H.Spec(entity=("who",), period=("season",), date="d", game="g")


def games(spark, rows):
    return spark.createDataFrame(rows, "who long, season long, d date, g long, x long")


def appearances(spark, starts):
    rows = [
        (2024, d, g, 7, "AAA", opponent, "home", "R", k, outs, pitches, faced)
        for d, g, opponent, k, outs, pitches, faced in starts
    ]
    return spark.createDataFrame(
        rows,
        "season long, game_date date, game_id long, pitcher_mlbam_id long, team string, opponent string,"
        "home_away string, pitcher_handedness string, strikeouts long, outs_recorded long, pitches_thrown long,"
        "batters_faced long",
    )


STARTS = [
    (date(2024, 4, 1), 1, "BBB", 2, 15, 80, 20),
    (date(2024, 4, 7), 2, "CCC", 6, 18, 95, 24),
    (date(2024, 4, 13), 3, "BBB", 5, 12, 100, 22),
]


def metrics(spark, starts):
    rows = []
    for d, g, _, k, outs, pitches, faced in starts:
        values = {m: 10 for m in E.ENTITY_METRICS}
        values |= {"k_count": k, "bf_metric": faced, "pitches": pitches, "velocity_sum": 900.0}
        rows.append((2024, d, g, 7, *[values[m] for m in E.ENTITY_METRICS]))
    kinds = ", ".join(f"{m} {'double' if m == 'velocity_sum' else 'long'}" for m in E.ENTITY_METRICS)
    return spark.createDataFrame(rows, f"season long, game_date date, game_id long, pitcher_mlbam_id long, {kinds}")


def test_first_rows_of_each_frame(spark):
    df = games(spark, [(1, 2024, date(2024, 1, d), d, d) for d in (1, 2, 5)])
    frames = [H.SEASON, H.Frame("last2", rows=2), H.Frame("day3d", days=3)]
    rows = H.with_prior(df, SPEC, frames, ["x"]).orderBy("d").collect()
    assert [r["season_x"] for r in rows] == [None, 1, 3]
    assert [r["season_history_starts"] for r in rows] == [0, 1, 2]
    assert [r["last2_history_starts"] for r in rows] == [0, 1, 2]
    # Day 5 looks back to day 2 inclusive; an empty span of days has no count at all.
    assert [r["day3d_x"] for r in rows] == [None, 1, 2]
    assert [r["day3d_history_starts"] for r in rows] == [None, 1, 1]


def test_two_games_on_one_day(spark):
    df = games(spark, [(1, 2024, date(2024, 1, 1), 1, 5), (1, 2024, date(2024, 1, 1), 2, 7)])
    rows = H.with_prior(df, SPEC, [H.SEASON, H.Frame("week", days=7)], ["x"]).orderBy("g").collect()
    assert rows[1]["season_x"] == 5 and rows[1]["week_x"] is None


def test_shifted_values_and_masking(spark):
    config = X.FeatureConfig(minimum=1)
    table = X.feature_table(appearances(spark, STARTS), metrics(spark, STARTS), config=config)
    first, second, third = table.orderBy("game_date").collect()
    assert first["season_k_pct"] is None and first["season_insufficient_history"] == 1
    assert second["season_k_pct"] == second["last3_k_pct"] == pytest.approx(0.1)
    assert second["season_outs_per_start"] == 15 and second["pitches_previous_start"] == 80
    assert third["pitches_median_before_game"] == 87.5 and third["pitcher_days_rest"] == 6
    assert third["starts_reaching_90_before_game"] == 1 and third["starts_reaching_100_before_game"] == 0
    strict = X.feature_table(appearances(spark, STARTS), metrics(spark, STARTS)).orderBy("game_date").collect()
    assert all(r["season_k_pct"] is None and r["season_insufficient_history"] == 1 for r in strict)
    assert not {"k_count", "velocity_sum", "hits"} & set(table.columns)


def test_future_changes_leave_earlier_rows_alone(spark):
    config = X.FeatureConfig(minimum=1)
    changed = STARTS[:2] + [(date(2024, 4, 13), 3, "ZZZ", 20, 27, 130, 40)]
    before, after = (
        X.feature_table(appearances(spark, s), metrics(spark, s), config=config)
        .where(F.col("game_id") <= 2).orderBy("game_id").collect()
        for s in (STARTS, changed)
    )
    assert before == after
    third = [
        X.feature_table(appearances(spark, s), metrics(spark, s), config=config)
        .where(F.col("game_id") == 3).drop("opponent", "strikeouts", "outs_recorded", "pitches_thrown", "batters_faced").collect()
        for s in (STARTS, changed)
    ]
    assert third[0] == third[1]


def test_current_categories_and_hands_do_not_leak(spark):
    def table(mix, hand):
        types = spark.createDataFrame(
            [(2024, d, g, 7, kind, 10, 900.0, 10, 2, 5, 3) for d, g, kind in mix],
            "season long, game_date date, game_id long, pitcher_mlbam_id long, pitch_type string, pitch_count long,"
            "velocity_sum double, velocity_count long, whiff_count long, strike_count long, csw_count long",
        )
        teams = spark.createDataFrame(
            [(2024, d, g, o, "R" if g < 3 else hand, *[8] * len(E.TEAM_METRICS)) for d, g, o, *_ in STARTS],
            "season long, game_date date, game_id long, team string, opponent_hand string, "
            + ", ".join(f"{m} long" for m in E.TEAM_METRICS),
        )
        frame = X.feature_table(appearances(spark, STARTS), metrics(spark, STARTS), types, teams, X.FeatureConfig(minimum=1))
        return frame.where(F.col("game_id") == 3).collect()

    old = [(date(2024, 4, 1), 1, "FF"), (date(2024, 4, 7), 2, "SL")]
    a = table([*old, (date(2024, 4, 13), 3, "FF")], "R")
    b = table([*old, (date(2024, 4, 13), 3, "CH")], "L")
    assert a == b
    assert a[0]["pitch_FF_usage"] == pytest.approx(10 / 175) and a[0]["pitch_FF_velocity"] == 90.0
    assert a[0]["opponent_k_pct_vs_RHP"] == 1.0 and a[0]["opponent_k_pct_vs_LHP"] is None


def test_full_schema_has_published_width(spark):
    names = X.entity_feature_names(X.FeatureConfig(), True) + X.opponent_feature_names(("R", "L"))
    assert len(names) == len(set(names)) == 244


def test_blocks_equal_plain_windows_with_a_hot_entity(spark):
    random = Random(5)
    rows = []
    for who, n in ((1, 400), (2, 12), (3, 1)):
        day = date(2024, 1, 1)
        for g in range(n):
            day += timedelta(days=random.choice([0, 0, 1, 1, 2, 9, 40]))
            rows.append((who, 2024, day, g, random.randrange(50)))
    df = games(spark, rows)
    frames = [H.SEASON, H.Frame("last3", rows=3), H.Frame("last10", rows=10), H.Frame("last7d", days=7), H.Frame("last20d", days=20)]
    names = ["who", "d", "g"] + [f"{f.name}_{m}" for f in frames for m in ("x", "history_starts")]
    plain = H.with_prior(df, SPEC, frames, ["x"]).select(*names)
    blocked = H.blocked_history(df, SPEC, frames, ["x"], H.Blocks(width=20)).select(*names)
    assert plain.exceptAll(blocked).count() == 0 and blocked.exceptAll(plain).count() == 0
    with pytest.raises(ValueError):
        H.blocked_history(df, SPEC, frames, ["x"], H.Blocks(width=5))


def test_one_exchange_and_one_sort_serve_all_entity_windows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = appearances(spark, STARTS).withColumn("outs_history", F.col("outs_recorded"))
        frame = frame.withColumns({m: F.lit(1).cast("bigint") for m in E.ENTITY_METRICS})
        plan = X.entity_features(frame, X.FeatureConfig(), False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.split("\n")
    assert sum("Exchange hashpartitioning" in line for line in lines) == 1
    assert sum(" Sort [" in line for line in lines) == 1


def test_keep_last_prefers_the_later_source(spark):
    schema = "game_id long, pitcher_mlbam_id long, game_date date, strikeouts long"
    day = date(2024, 5, 1)
    parts = [spark.createDataFrame([(1, 7, day, k)], schema) for k in (3, 4, None)]
    both = X.union_sources(historical=parts[0], completed=parts[1], scheduled=parts[2])
    kept = X.keep_last(both, ["game_id", "pitcher_mlbam_id"], ["game_date", "source_rank"]).collect()
    assert len(kept) == 1 and kept[0]["source_rank"] == 2 and kept[0]["strikeouts"] is None


def test_frozen_schema_and_unique_keys(spark):
    df = games(spark, [(1, 2024, date(2024, 1, 1), 1, 5), (1, 2024, date(2024, 1, 2), 1, 5)])
    with pytest.raises(QualityError):
        X.require_frozen_schema(df, ["x", "y"])
    with pytest.raises(QualityError):
        X.one_to_one_join(df, df, ["who", "g"])

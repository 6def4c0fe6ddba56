"""Event rollups, validation gates, sources and sinks."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from antecede.operators import events as E
from antecede.operators import quality as Q
from antecede.sources import scan, sinks

SCHEMA = (
    "game_date date, game_id long, pitcher_mlbam_id long, batter long, at_bat_number int, inning int,"
    "inning_topbot string, pitch_number int, events string, description string, p_throws string, pitch_type string,"
    "player_name string, away_team string, home_team string, post_away_score int, post_home_score int,"
    "outs_when_up int, zone int, release_speed double"
)


def pitch(pitcher, at_bat, number, event=None, description="foul", side="Top", inning=1, away=0, home=0, outs=0, zone=5):
    return (
        date(2024, 4, 1), 10, pitcher, 50 + at_bat, at_bat, inning, side, number, event, description, "R", "FF",
        f"P{pitcher}", "AWY", "HOM", away, home, outs, zone, 95.0,
    )


ROWS = [
    pitch(1, 1, 1, "strikeout", "swinging_strike"),
    pitch(1, 2, 1, "single", "hit_into_play", away=1),
    pitch(2, 3, 1, "walk", "ball", side="Bot"),
    pitch(2, 4, 1, "field_out", "hit_into_play", side="Bot"),
    pitch(3, 5, 1, "strikeout", "called_strike"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_appearances_are_first_pitchers(spark):
    away, home = E.appearance_table(frame(spark)).orderBy("home_away").collect()
    assert (home["pitcher_mlbam_id"], home["team"], home["opponent"]) == (1, "HOM", "AWY")
    assert (home["pitches_thrown"], home["batters_faced"], home["strikeouts"], home["outs_recorded"], home["hits"]) == (2, 2, 1, 1, 1)
    assert home["runs"] == 1 and home["pitcher_name"] == "P1"
    assert (away["pitcher_mlbam_id"], away["walks"], away["outs_recorded"]) == (2, 1, 1)


def test_automatic_ball_sacrifice_and_truncated_at_bat(spark):
    rows = [
        pitch(1, 1, 1, None, "automatic_ball"), pitch(1, 1, 2, "sac_fly", "hit_into_play"),
        pitch(1, 2, 1, "truncated_pa", "ball"), pitch(1, 3, 1, None, None),
    ]
    row = E.appearance_table(frame(spark, rows)).first()
    assert row["pitches_thrown"] == 3 and row["outs_recorded"] == 1 and row["batters_faced"] == 2


def test_completed_innings_are_topped_up(spark):
    rows = [
        pitch(1, 1, 1, "strikeout", inning=1), pitch(1, 2, 1, "double_play", inning=2, outs=1),
        pitch(1, 3, 1, "strikeout", inning=3),
    ]
    out = E.inning_reconciliation(frame(spark, rows), ["pitcher_mlbam_id"]).first()
    # Inning 1 lacks two outs; inning 2 began with an out; inning 3 is the last one.
    assert (out["explicit_outs"], out["inferred_outs"], out["outs_recorded"]) == (4, 2, 6)


def test_scores_missing_everywhere_stay_unknown(spark):
    rows = frame(spark).withColumn("post_away_score", F.lit(None).cast("int"))
    assert E.score_delta(rows, ["game_id"], "post_away_score", ["at_bat_number"]).first()["runs"] is None


def test_unknown_zone_is_neither_zone_nor_chase(spark):
    row = E.event_flags(frame(spark, [pitch(1, 1, 1, zone=None)]), ["pitcher_mlbam_id"]).first()
    assert row["zone_pitch_count"] == row["chase_pitch_count"] == 0 and row["swing_count"] == 1


def test_first_actor_skips_missing_and_rows_join_on_missing_groups(spark):
    rows = [pitch(None, 1, 1, side=None), pitch(4, 2, 1, side=None), pitch(5, 3, 1, side=None)]
    df = frame(spark, rows)
    order = ["at_bat_number", "pitch_number"]
    assert E.first_actor(df, ["game_id", "inning_topbot"], order, "pitcher_mlbam_id").first()["pitcher_mlbam_id"] == 4
    kept = E.keep_first_actor_rows(df, ["game_id", "inning_topbot"], order, "pitcher_mlbam_id").collect()
    assert [r["pitcher_mlbam_id"] for r in kept] == [4]


def raw(spark, rows):
    return spark.createDataFrame(
        rows,
        "game_date string, game_pk string, pitcher string, batter string, at_bat_number long, inning string,"
        "inning_topbot string, pitch_number string, events string, description string, stand string, p_throws string,"
        "pitch_type string",
    )


GOOD = ("2024-04-01", "1", "2", "3", 1, "1", "Bot", "1", None, "ball", "R", "L", "FF")


def test_validation_counts_and_gate(spark):
    bad = ("n/a", "1", "x", "3", 2, "31", "Mid", "201", None, "ball", "Q", None, "FFF")
    report = Q.full_report(raw(spark, [GOOD, GOOD, bad])).first()
    assert report["duplicate_rows"] == 1 and report["invalid_dates"] == 1 and report["invalid_pitcher"] == 1
    assert report["invalid_sides"] == report["invalid_innings"] == report["invalid_pitch_numbers"] == 1
    assert report["invalid_stand"] == 1 and report["invalid_p_throws"] == 0 and report["invalid_pitch_types"] == 1
    with pytest.raises(Q.QualityError, match="duplicate_pitch_records, invalid_dates"):
        Q.critical_gate(raw(spark, [GOOD, GOOD, bad]))
    assert Q.critical_gate(raw(spark, [GOOD])).count() == 1


def test_argument_gates(spark):
    with pytest.raises(Q.QualityError):
        Q.require_columns(frame(spark), ["nope"])
    with pytest.raises(Q.QualityError):
        Q.require_cutoff(datetime(2024, 1, 1))
    assert Q.require_cutoff(datetime(2024, 1, 1, tzinfo=timezone.utc))
    with pytest.raises(Q.QualityError):
        Q.require_iso_date("2024-1-1")
    df = spark.sql("select timestamp_ntz'2024-01-01 05:00:00' as at union all select timestamp_ntz'2024-01-01 06:00:00'")
    assert Q.before_cutoff(df, "at", datetime(2024, 1, 1, 6, tzinfo=timezone.utc)).count() == 1
    with pytest.raises(Q.QualityError):
        Q.before_cutoff(df, "at", datetime(2024, 1, 1, 6))


def test_partial_rows_stop_the_run(spark):
    df = spark.createDataFrame([(1.5, -110), (None, None)], "line double, odds int")
    assert Q.completed_rows(df, ["line", "odds"]).count() == 1
    with pytest.raises(Q.QualityError):
        Q.completed_rows(df.union(spark.createDataFrame([(2.5, None)], "line double, odds int")), ["line", "odds"])


def test_dictionary_rules():
    assert Q.column_role("strikeouts") == "target" and Q.column_role("season") == "identifier/context"
    assert Q.describe_column("season_k_pct").startswith("Historical rate")
    assert Q.describe_column("last3_insufficient_history").startswith("Flag")


def test_date_chunks(spark):
    rows = scan.date_chunks(spark, date(2024, 4, 1), date(2024, 4, 10), 7).collect()
    assert [(r["chunk_start"].day, r["chunk_end"].day) for r in rows] == [(1, 7), (8, 10)]
    for start, end, days in ((date(2024, 4, 2), date(2024, 4, 1), 7), (date(2024, 4, 1), date(2024, 4, 2), 0)):
        with pytest.raises(Q.QualityError):
            scan.date_chunks(spark, start, end, days)


def test_chunk_files_are_admitted_by_their_whole_range(spark, tmp_path):
    for start, end, day in (("2024-04-01", "2024-04-07", 3), ("2024-04-08", "2024-04-14", 9)):
        spark.createDataFrame([(date(2024, 4, day),)], "game_date date").toPandas().to_parquet(
            tmp_path / f"chunk_{start}_{end}.parquet"
        )
    rows = scan.admitted_chunks(spark, str(tmp_path), date(2024, 4, 10)).collect()
    assert [r["game_date"].day for r in rows] == [3]
    spark.createDataFrame([(date(2024, 4, 20),)], "game_date date").toPandas().to_parquet(
        tmp_path / "chunk_2024-03-01_2024-03-07.parquet"
    )
    with pytest.raises(Q.QualityError):
        scan.admitted_chunks(spark, str(tmp_path), date(2024, 4, 10))


def test_season_sink_replaces_only_its_seasons(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_seasons(spark.createDataFrame([(1, 2023), (2, 2024)], "x int, season int"), path)
    sinks.write_seasons(spark.createDataFrame([(3, 2024)], "x int, season int"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("x", "season").collect()) == [(1, 2023), (3, 2024)]
    pruned = scan.scan_seasons(spark, path, [2023])
    assert pruned.count() == 1 and "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().toString()


def test_snapshots_accumulate(spark, tmp_path):
    board = spark.createDataFrame([("a", 1.5)], "name string, line double")
    for hour in (1, 2):
        sinks.append_snapshot(board, str(tmp_path / "h"), datetime(2024, 4, 1, hour), date(2024, 4, 1))
    assert spark.read.parquet(str(tmp_path / "h")).select("captured_at").distinct().count() == 2


def test_scan_is_pruned(spark):
    from antecede.plans.standin import Tables

    plan = Tables(spark, "/root/testdata/sf0.001").pitches.select("zone")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan

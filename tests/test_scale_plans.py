"""Steps that must not do the same work several times, nor hold in one task what grows with the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.catalog import market_queries as Q
from antecede.operators import calibration as C
from antecede.operators import diagnostics as D
from antecede.operators import events as E
from antecede.operators import features as X
from antecede.operators import market as M
from antecede.operators import scoring as S
from antecede.operators.name_match import candidate_keys, match_names
from antecede.plans.standin import CONFIG, Tables
from antecede.sources import payloads


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_document_is_parsed_once(spark):
    documents = spark.createDataFrame([('{"id": "a", "bookmakers": null}',), (None,)], "payload string")
    df = payloads.flatten_odds(documents)
    assert optimized(df).count("from_json") == 1
    assert df.count() == 0


def test_a_name_is_spelled_out_once_per_block(spark):
    people = spark.createDataFrame([(1, "x", "Doe, Ann"), (2, "x", "Roe, Bo"), (3, "y", "Doe, Ann")], "id bigint, block string, name string")
    said = [(k, "Ann Doe", ["x", "y"]) for k in range(50)] + [(50, None, ["x"]), (51, "Bo Roe", []), (52, "Zed Roe", ["x", "x"]), (53, "Zed Doe", ["x", "y"])]
    mentions = spark.createDataFrame(said, "mention bigint, said string, blocks array<string>")
    df = match_names(mentions, people, ["mention"], "said", "blocks", "block", ["id"], "name")
    got = dict(df.collect())
    assert got == {k: 1 for k in range(50)} | {50: None, 51: None, 52: 2, 53: None}
    keys = candidate_keys(people, "block", ["id"], "name")
    assert "SortAggregate" not in keys._jdf.queryExecution().executedPlan().toString()


def test_coverage_makes_the_board_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(len(row))
            yield row

    board = spark.createDataFrame([("a", "strikeouts", "s"), ("a", "outs_recorded", "t"), ("b", "strikeouts", "s")], "pitcher_name string, target string, sportsbook string")
    df = M.board_coverage(board.mapInArrow(lambda batches: count(batches), board.schema))
    assert tuple(df.first()) == (3, 2, 1, 2, 2)
    assert seen.value == 3


def test_forecasts_are_not_dealt_by_a_few_keys(spark):
    """Winners, means and terciles are a few rows; a join dealt by their keys would leave a handful of tasks."""
    rows = spark.createDataFrame([(1, 1, 1, "t", "m", "s", 1.0, 2.0)], "season bigint, game_id bigint, pitcher_mlbam_id bigint, target string, model string, split string, actual double, prediction double")
    context = rows.select("season", "game_id", "pitcher_mlbam_id").selectExpr("*", "'R' as pitcher_handedness", "1L as pitcher_starts_before_game")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        won = S.winners_only(rows, rows.groupBy("target").agg({"model": "max"}).withColumnRenamed("max(model)", "model"))
        plan = won._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(target" not in plan.split("BroadcastExchange")[0]
        sums = D.error_sums(rows, context)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [target" in sums
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_guards_of_a_market_join_read_written_tables(spark):
    files = Q.joined(Tables(spark, "/root/testdata/sf0.001"), strict=True).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


def test_games_are_counted_in_one_deal_of_the_pitches(spark):
    """One aggregate equals the entity metrics and the category pivot joined, also for missing keys and at-bats."""
    rows = [(1, 7, 1, 1, "foul", "strikeout", "A"), (1, 7, 1, 1, "ball", None, "B"), (1, 7, 1, 2, "called_strike", "walk", "A"), (1, 7, None, 1, "foul", None, None), (1, 7, 2, None, "ball", "truncated_pa", "A"),
            (1, 8, 1, 3, None, None, "B"), (2, 7, 3, 1, "foul", "single", "Z"), (1, None, 4, 1, "foul", "single", "A"), (None, 7, 5, 1, "foul", "single", "A")]
    pitches = spark.createDataFrame(rows, "game_id bigint, pitcher_mlbam_id bigint, at_bat_number bigint, pitch_number bigint, description string, events string, pitch_type string").selectExpr(
        "*", "2000L as season", "date'2000-05-01' as game_date", "5L as zone", "cast(90.5 as double) as release_speed", "'L' as p_throws")
    got = E.entity_games(
        pitches, {c: F.when(F.col("pitch_type") == c, 1).otherwise(0) for c in "AB"}, {"thrown": E.row_flag("pitches")}, {"left": F.col("p_throws") == "L"})
    keys = pitches.groupBy(*X.KEYS).agg(F.sum(E.row_flag("pitches")).alias("thrown"), F.lit(None).alias("outs_recorded"))
    want = X.with_game_metrics(keys, E.entity_game_metrics(pitches), E.category_game_metrics(pitches), X.FeatureConfig(categories=("A", "B"))).drop("outs_recorded", "outs_history")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    faced = {(r.game_id, r.pitcher_mlbam_id): r.batters_faced for r in got.collect()}
    assert faced == {(1, 7): 2, (1, 8): 1, (2, 7): 1, (1, None): 1, (None, 7): 1}


def test_feature_windows_read_written_games(spark):
    plan = optimized(Tables(spark, "/root/testdata/sf0.001").features)
    assert plan.count("l_suppkey") == 0  # games and opponents are written tables by then


def test_a_slate_counts_only_games_in_reach(spark, monkeypatch):
    """The first slate of a season needs the six games before it, not all history, and gives the rows of the whole table."""
    t, slate, given = Tables(spark, "/root/testdata/sf0.001"), F.lit("2001-01-01").cast("date"), []
    build = X.feature_table_from_pitches
    monkeypatch.setattr(X, "feature_table_from_pitches", lambda p, a, c: given.append((p, a)) or build(p, a, c))
    scheduled = t.appearances.where(F.col("game_date") == slate).withColumns({c: F.lit(None).cast("bigint") for c in X.K.TARGETS})
    pitches = t.typed_pitches.join(t.at_bat_teams, "at_bat_number", "left")
    got = X.pre_event_features(t.appearances.where("season < 2001"), t.appearances.limit(0), scheduled, pitches, "2001-01-01", CONFIG)
    (own, rows), = given
    names = [c for c in got.columns if c not in X.K.TARGETS]
    want = t.features.where(F.col("game_date") == slate).select(*names)
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.collect()))
    assert 0 < rows.count() <= 7 * scheduled.count() and own.count() < pitches.count() / 4


def test_a_summary_makes_its_probabilities_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(1, 1, k, "t", line, p, k % 2) for k in range(4) for line, p in ((0.5, 0.6), (1.5, 0.2 + 0.2 * k))],
                                 "season bigint, game_id bigint, pitcher_mlbam_id bigint, target string, line double, probability_over double, actual_over bigint")
    got = C.probability_summary(rows.mapInArrow(count, rows.schema)).first()
    assert (got.n, got.monotonicity_violations) == (8, 1) and got.probability_std > 0
    assert seen.value == 8

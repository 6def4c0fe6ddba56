"""Carried-over state, running medians, mergeable error sums, gated and resumable writes."""

import statistics
import time
from datetime import date, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from antecede.operators import diagnostics as D
from antecede.operators import events as E
from antecede.operators import features as X
from antecede.operators import history as H
from antecede.operators import state as ST
from antecede.operators.quality import QualityError
from antecede.sources import publish

CONFIG = X.FeatureConfig(categories=("FF", "SL"), minimum=2)
CONTEXT = "season long, game_date date, game_id long, pitcher_mlbam_id long, team string, opponent string, home_away string, pitcher_handedness string"


def random_games(spark, seed, entities=4, per_season=14):
    """(appearances, pitcher, type, team) tables of three seasons; some games have no metrics, some values are missing."""
    random, apps, pitcher, types, teams, game = Random(seed), [], [], [], [], 0
    for season in (2021, 2022, 2023):
        for k in range(per_season):
            day = date(season, 4, 1) + timedelta(days=7 * k + random.randrange(6))
            for entity in range(entities):
                if random.random() < 0.3:
                    continue
                game += 1
                opponent = "ABC"[random.randrange(3)] * 3
                thrown = random.choice([None, *range(70, 110)])
                apps.append((season, day, game, entity, "TTT", opponent, random.choice(["home", "away"]), "RL"[entity % 2],
                             random.randrange(10), random.choice([None, 15, 18]), thrown, random.randrange(18, 28)))
                if random.random() < 0.9:
                    pitcher.append((season, day, game, entity, *[random.randrange(1, 30) for _ in E.ENTITY_METRICS]))
                for kind in ("FF", "SL", "CU"):
                    if random.random() < 0.7:
                        types.append((season, day, game, entity, kind, *[random.randrange(1, 20) for _ in E.CATEGORY_METRICS]))
                teams.append((season, day, game, opponent, "RL"[entity % 2], *[random.randrange(1, 40) for _ in E.TEAM_METRICS]))
    keys = "season long, game_date date, game_id long, pitcher_mlbam_id long"
    longs = lambda names: ", ".join(f"{m} {'double' if m == 'velocity_sum' else 'long'}" for m in names)
    real = lambda rows, names, at: [tuple(float(v) if at + names.index("velocity_sum") == k else v for k, v in enumerate(r)) if "velocity_sum" in names else r for r in rows]
    return (
        spark.createDataFrame(apps, CONTEXT + ", strikeouts long, outs_recorded long, pitches_thrown long, batters_faced long"),
        spark.createDataFrame(real(pitcher, list(E.ENTITY_METRICS), 4), f"{keys}, {longs(E.ENTITY_METRICS)}"),
        spark.createDataFrame(real(types, list(E.CATEGORY_METRICS), 5), f"{keys}, pitch_type string, {longs(E.CATEGORY_METRICS)}"),
        spark.createDataFrame(teams, f"season long, game_date date, game_id long, team string, opponent_hand string, {longs(E.TEAM_METRICS)}"),
    )


def inside(tables, keep):
    return tuple(t.where(keep) for t in tables)


def state_of(tables):
    apps, pitcher, types, teams = tables
    return ST.new_state(X.with_game_metrics(apps, pitcher, types, CONFIG), apps, teams, CONFIG)


def advanced(state, tables):
    apps, pitcher, types, teams = tables
    return ST.advance(state, X.with_game_metrics(apps, pitcher, types, CONFIG), apps, teams, CONFIG)


def rounded_rows(df):
    return sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r)
    )


@pytest.mark.parametrize("cutoff", [date(2022, 1, 1), date(2022, 5, 20), date(2023, 4, 2)])
def test_features_from_state_equal_the_full_build(spark, tmp_path, cutoff):
    tables = [t.cache() for t in random_games(spark, cutoff.day)]
    old, new = (inside(tables, F.col("game_date") < F.lit(cutoff)), inside(tables, F.col("game_date") >= F.lit(cutoff)))
    state_of(old).save(str(tmp_path / "s"))
    state = ST.HistoryState.load(spark, str(tmp_path / "s"))
    full = X.feature_table(*tables, CONFIG).where(F.col("game_date") >= F.lit(cutoff))
    got = ST.feature_table(state, *new, CONFIG)
    assert got.columns == full.columns
    assert rounded_rows(got) == rounded_rows(full) and full.count() > 20


def test_advancing_in_steps_gives_the_state_of_one_build(spark, tmp_path):
    tables = [t.cache() for t in random_games(spark, 5)]
    cuts = [date(2021, 5, 1), date(2022, 4, 20), date(2022, 6, 1), date(2023, 5, 1)]
    state_of(inside(tables, F.col("game_date") < F.lit(cuts[0]))).save(str(tmp_path / "0"))
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        step = inside(tables, (F.col("game_date") >= F.lit(low)) & (F.col("game_date") < F.lit(high)))
        advanced(ST.HistoryState.load(spark, str(tmp_path / str(k))), step).save(str(tmp_path / str(k + 1)))
    got = ST.HistoryState.load(spark, str(tmp_path / "3"))
    want = state_of(inside(tables, F.col("game_date") < F.lit(cuts[-1])))
    for name in ST.TABLES:
        left, right = getattr(got, name), getattr(want, name)
        assert sorted(left.columns) == sorted(right.columns)
        assert rounded_rows(left.select(sorted(left.columns))) == rounded_rows(right.select(sorted(left.columns))), name


def test_state_plan_reads_no_older_game(spark, tmp_path):
    tables = random_games(spark, 6)
    for name, t in zip(("apps", "pitcher", "types", "teams"), tables):
        t.write.partitionBy("season").parquet(str(tmp_path / name))
    read = lambda: [spark.read.parquet(str(tmp_path / n)).withColumn("season", F.col("season").cast("bigint")) for n in ("apps", "pitcher", "types", "teams")]
    state_of(inside(read(), F.col("season") < 2023)).save(str(tmp_path / "s"))
    state = ST.HistoryState.load(spark, str(tmp_path / "s"))
    plan = ST.feature_table(state, *inside(read(), F.col("season") == 2023), CONFIG)
    files = {f for f in plan.inputFiles() if "/s/" not in f}
    assert files and plan._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(season") >= 4
    with pytest.raises(QualityError):
        advanced(state, inside(read(), F.col("season") == 2022))


# --- running median ---------------------------------------------------------------------------


def test_running_median_equals_the_window(spark):
    random = Random(8)
    values = [None, 1.5, 1.5, *[float(v) for v in range(40)]]
    rows = [(e, d // 60, date(2024, 1, 1) + timedelta(days=d), d, random.choice(values) if e < 3 else None) for e in range(4) for d in range(150)]
    df = spark.createDataFrame(rows, "who long, season long, d date, g long, x double").repartition(3)
    spec = H.Spec(entity=("who",), period=("season",), date="d", game="g")
    want = {tuple(r) for r in df.select("who", "season", "d", "g", H.expanding_median(spec, "x").alias("m")).collect()}
    got = {tuple(r) for r in H.running_median(df, spec, "x", "m").collect()}
    assert got == want
    assert H.running_median(df.limit(0), spec, "x", "m").count() == 0


def test_running_median_of_one_huge_entity(spark):
    n, random = 100_000, Random(9)
    values = [random.randrange(1 << 30) for _ in range(n)]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "who long, t long, x long")
    spec = H.Spec(entity=("who",), period=(), date="t", game="t")
    start = time.time()
    got = {r.t: r.m for r in H.running_median(df, spec, "x", "m").collect()}
    assert time.time() - start < 180
    assert got[0] is None and len(got) == n
    for k in (1, 2, 3, 1000, 54_321, n - 1):
        assert got[k] == statistics.median(values[:k])


# --- mergeable error sums ----------------------------------------------------------------------


def test_error_sums_merge_and_expand_only_sums(spark):
    random = Random(10)
    keys = [(2021 + k % 3, k, k % 7) for k in range(400)]
    predictions = spark.createDataFrame(
        [(*k, "strikeouts", "m", f"s{k[0]}", float(random.randrange(9)), random.random() * 9) for k in keys],
        "season long, game_id long, pitcher_mlbam_id long, target string, model string, split string, actual double, prediction double",
    )
    context = spark.createDataFrame(
        [(*k, random.choice(["R", "L", None]), random.choice([None, 1, 9])) for k in keys],
        "season long, game_id long, pitcher_mlbam_id long, pitcher_handedness string, pitcher_starts_before_game long",
    )
    sums = D.error_sums(predictions, context).cache()
    whole = rounded_rows(D.merged_errors(sums, totals=True))
    halves = sums.where("season = '2021'").unionByName(sums.where("season <> '2021'"))
    assert rounded_rows(D.merged_errors(halves, totals=True)) == whole
    rows = predictions.join(context, ["season", "game_id", "pitcher_mlbam_id"]).collect()
    by_hand = {r.bucket_value: r.n for r in D.merged_errors(sums).where("bucket_type = 'pitcher_handedness' AND split = 's2022'").collect()}
    assert by_hand == {h: sum(r.split == "s2022" and r.pitcher_handedness == h for r in rows) for h in ("R", "L")}
    totals = {r.split: (r.n, round(r.mae, 9)) for r in D.merged_errors(sums, True).where("bucket_type = 'all'").collect()}
    for split in ("s2021", "s2022", "s2023"):
        errors = [abs(r.prediction - r.actual) for r in rows if r.split == split]
        assert totals[split] == (len(errors), round(sum(errors) / len(errors), 9))
    plan = D.bucketed_errors(predictions, context)._jdf.queryExecution().optimizedPlan().toString()
    expand = plan.index("Expand")
    assert "Aggregate" in plan[expand:] and plan.count("Expand") == 1  # below the expansion stand sums


# --- gated and resumable writes -----------------------------------------------------------------


def rows_of(spark, values):
    return spark.createDataFrame(values, "k long, x long")


def test_a_failing_part_publishes_nothing_and_keeps_what_was_there(spark, tmp_path):
    root = str(tmp_path)
    assert publish.published(spark, root) is None and publish.manifest(spark, root).count() == 0
    good, checks = publish.with_duplicates(rows_of(spark, [(1, 1), (2, 2)]), ["k"])
    checks |= {"missing_x": F.count_if(F.col("x").isNull())}
    assert publish.publish(good, root, "a", checks, drop=["_place"]) == "complete"
    for bad in ([(1, 5), (1, 6)], [(1, None)]):
        rows, found = publish.with_duplicates(rows_of(spark, bad), ["k"])
        with pytest.raises(QualityError):
            publish.publish(rows, root, "a", found | {"missing_x": F.count_if(F.col("x").isNull())}, drop=["_place"])
        assert {tuple(r) for r in publish.published(spark, root).collect()} == {(1, 1), (2, 2)}
    rows, found = publish.with_duplicates(rows_of(spark, [(1, 5), (1, 6)]), ["k"])
    assert publish.publish(rows, root, "b", found, {"duplicate_rows": 1}, drop=["_place"]) == "complete"
    assert publish.published(spark, root).count() == 4
    newer, found = publish.with_duplicates(rows_of(spark, [(9, 9)]), ["k"])
    publish.publish(newer, root, "a", found, drop=["_place"])
    assert {tuple(r) for r in publish.published(spark, root).collect()} == {(9, 9), (1, 5), (1, 6)}
    assert publish.attempts(spark, root).count() == 5


def test_checks_of_a_write_cost_one_scan(spark, tmp_path):
    source = str(tmp_path / "source")
    rows_of(spark, [(k, k) for k in range(1000)]).write.parquet(source)
    reads = spark.sparkContext.accumulator(0)
    df = spark.read.parquet(source)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    publish.publish(df.mapInArrow(counted, df.schema), str(tmp_path / "out"), "a", {"odd": F.count_if(F.col("x") % 2 == 1)}, {"odd": 500})
    assert reads.value == 1000 and publish.manifest(spark, str(tmp_path / "out")).first()["findings"] == {"odd": 500}


def test_a_killed_run_is_repeated_without_reading_finished_chunks(spark, tmp_path):
    root, reads = str(tmp_path), []
    calendar = spark.createDataFrame([(k, 10 * k, 10 * k + 9) for k in range(6)], "chunk long, low long, high long")
    source = rows_of(spark, [(k, k if k != 33 else None) for k in range(60)])

    def read(row):
        reads.append(row.chunk)
        if len(reads) == 3:
            raise ConnectionError
        return source.where(F.col("k").between(row.low, row.high))

    checks = {"missing_x": F.count_if(F.col("x").isNull())}
    with pytest.raises(ConnectionError):
        publish.ingest(calendar, root, read, checks)
    assert publish.published(spark, root).count() == 20
    assert publish.ingest(calendar, root, read, checks) == ["2", "3", "4", "5"]
    assert reads == [0, 1, 2, 2, 3, 4, 5]
    status = {r.part: r.status for r in publish.manifest(spark, root).collect()}
    assert status == {k: "failed" if k == "3" else "complete" for k in "012345"}
    assert publish.published(spark, root).count() == 50
    assert publish.ingest(calendar, root, read, checks, {"missing_x": 1}) == ["3"]
    assert sorted(r.k for r in publish.published(spark, root).collect()) == list(range(60))
    assert publish.ingest(calendar, root, read, checks) == []

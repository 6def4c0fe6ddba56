"""The tournament grid resumes where it ended."""

from random import Random

import pytest

from antecede.operators import models as M
from antecede.operators import tournament as T

SPLITS = [("train_2020_2020_validate_2021", [2020], 2021), ("train_2020_2021_validate_2022", [2020, 2021], 2022)]


def frame(spark):
    random = Random(3)
    rows = [
        (2020 + i % 3, i, i % 9, random.gauss(0, 1), random.gauss(2, 1) if i % 5 else None, float(random.randrange(9)), float(random.randrange(20)), 20.0 + i % 5)
        for i in range(240)
    ]
    return spark.createDataFrame(
        rows, "season long, game_id long, pitcher_mlbam_id long, season_a double, season_b double, strikeouts double, outs_recorded double, batters_faced double"
    ).persist()


def test_a_repeated_run_fits_only_unfinished_cells(spark, tmp_path):
    features, root, fits = frame(spark), str(tmp_path), []
    cells = T.grid(SPLITS, ("strikeouts", "outs_recorded"), ("ridge", "poisson"))
    assert len({c.name for c in cells}) == len(cells) == 8

    def before(cell):
        fits.append(cell.name)
        if len(fits) == 4:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        T.run(features, cells, root, before=before)
    assert T.finished(spark, root) == {c.name for c in cells[:3]}
    assert T.run(features, cells, root, before=before) == [c.name for c in cells[3:]]
    assert fits == [c.name for c in cells[:4]] + [c.name for c in cells[3:]]
    assert T.run(features, cells, root, before=before) == []
    key = lambda rows: sorted((r.split, r.target, r.model, r.game_id, round(r.prediction, 8)) for r in rows.collect())
    whole = M.walk_forward(features, SPLITS, ("strikeouts", "outs_recorded"), models=("ridge", "poisson"))
    assert key(T.forecasts(spark, root)) == key(whole)


def test_grids_leave_out_product_models_without_a_rate():
    cells = T.grid(SPLITS, ("strikeouts", "batters_faced"), ("volume_rate",), ("baseline", "full"))
    assert {(c.target, c.family) for c in cells} == {("strikeouts", "baseline"), ("strikeouts", "full")}


def test_all_folds_and_runs_share_one_written_table(spark, tmp_path, monkeypatch):
    from antecede.operators import packed as P

    written = []
    monkeypatch.setattr(P, "stage", lambda df, label, *a, f=P.stage: written.append(label) or f(df, label, *a))
    features, cells = frame(spark), T.grid(SPLITS, ("strikeouts", "outs_recorded"), ("ridge",))
    packed = T.packed(features)
    T.run(packed, cells[:3], str(tmp_path / "a"))
    T.run(packed, cells, str(tmp_path / "a"))
    T.run(features, cells, str(tmp_path / "b"))
    assert written.count("values") == 2  # one for both halves, one for the run that packs by itself
    key = lambda root: sorted((r.split, r.target, r.game_id, round(r.prediction, 8)) for r in T.forecasts(spark, root).collect())
    assert key(str(tmp_path / "a")) == key(str(tmp_path / "b"))

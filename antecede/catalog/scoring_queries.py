"""Splits, closed-form forecasts, scores, winners and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.catalog import parts as P
from antecede.catalog.history_queries import FEATURES
from antecede.catalog.registry import part, query, r, rounded, sql
from antecede.functions import constants as K
from antecede.functions.quantiles import exact_quantiles
from antecede.operators import diagnostics as D
from antecede.operators import scoring as S
from antecede.plans.standin import HOLDOUT_SEASON, MODELS

NAIVE = {"strikeouts": "k_per_start", "outs_recorded": "outs_per_start",
         "pitches_thrown": "pitches_per_start", "batters_faced": "bf_per_start"}

part("score_rows", f"""SELECT {P.KEYS}, pitcher_handedness, {', '.join(NAIVE)},
  season_n AS pitcher_starts_before_game, {', '.join(P.rates(f, 1) for f in ('season', 'last3'))} FROM hist""", "hist")
part("seasons", "SELECT DISTINCT season FROM app", "app")
part("splits", f"""SELECT CASE WHEN v.season = {HOLDOUT_SEASON} THEN 'holdout_{HOLDOUT_SEASON}'
   ELSE 'train_' || min(s.season) OVER w || '_' || max(s.season) OVER w
    || '_validate_' || v.season END AS split,
   s.season AS train_season, v.season AS validation_season
  FROM seasons s JOIN seasons v ON s.season < v.season WINDOW w AS (PARTITION BY v.season)""", "seasons")
part("means", f"""SELECT split, validation_season, {', '.join(f'CAST(sum({t}) AS DOUBLE) / count({t}) AS mean_{t}' for t in NAIVE)}
  FROM splits JOIN app ON season = train_season GROUP BY split, validation_season""", "splits", "app")


def _model(name: str, target: str) -> str:
    own = f"coalesce(season_{NAIVE[target]}, mean_{target})"
    return {
        "naive": own, "recent": f"coalesce(last3_{NAIVE[target]}, mean_{target})",
        "constant": f"mean_{target}", "ensemble": f"({own} + mean_{target}) / 2.0",
    }[name]


part("predictions", " UNION ALL ".join(
    f"""SELECT season, game_id, pitcher_mlbam_id, '{t}' AS target, '{m}' AS model, split,
     CAST({t} AS DOUBLE) AS actual, {_model(m, t)} AS prediction
     FROM score_rows JOIN means ON season = validation_season""" for t in NAIVE for m in MODELS), "score_rows", "means")
SCORES = f"""target, model, split, avg(abs(p - actual)) AS mae, sqrt(avg((p - actual) * (p - actual))) AS rmse,
  avg(p - actual) AS bias,
  CASE WHEN min(actual) = max(actual) OR min(p) = max(p) THEN 0.0 ELSE corr(actual, p) END AS correlation,
  avg(2.0 * (CASE WHEN actual > 0 THEN actual * ln(actual / greatest(p, 1e-9)) ELSE 0.0 END - actual + greatest(p, 1e-9))) AS poisson_deviance,
  count(*) AS n"""
part("scores", f"SELECT {SCORES} FROM (SELECT *, greatest(prediction, 0.0) AS p FROM predictions) GROUP BY target, model, split", "predictions")
part("dev_scores", f"SELECT * FROM scores WHERE split NOT LIKE 'holdout%'", "scores")
part("model_means", "SELECT target, model, avg(mae) AS mae FROM dev_scores GROUP BY target, model", "dev_scores")
part("winners", "SELECT target, arg_min(model, (round(mae, 12), model)) AS model, min(mae) AS mae FROM model_means GROUP BY target", "model_means")


def scores(t):
    return S.point_scores(t.predictions)


def staged_scores(t):
    return S.point_scores(t.forecasts)


def dev_scores(t):
    return staged_scores(t).where(~F.col("split").startswith("holdout"))


def winners(t):
    return S.select_winners(dev_scores(t))


@query("chronological_splits", sql("SELECT * FROM splits", "splits"))
def chronological_splits(t):
    return t.splits


@query("naive_forecast", sql("SELECT * EXCLUDE (model) FROM predictions WHERE model = 'naive'", "predictions"))
def naive_forecast(t):
    return S.closed_form_predictions(t.score_rows, t.splits, {"naive": S.naive}).drop("model")


@query("walk_forward_closed_form", sql("SELECT * FROM predictions", "predictions"))
def walk_forward_closed_form(t):
    return t.predictions


FIVE = ", ".join(f"{r(c)} AS {c}" for c in ("mae", "rmse", "bias", "correlation", "poisson_deviance"))


@query("point_scores", sql(f"SELECT target, model, split, {FIVE}, n FROM scores", "scores"))
def point_scores(t):
    return rounded(scores(t))


@query("select_winners", sql(f"SELECT target, model, {r('mae')} AS mae FROM winners", "winners"))
def select_winners(t):
    return rounded(winners(t))


@query("baseline_improvement", sql(f"""SELECT w.target, w.model AS winner, {r('b.mae')} AS baseline_mae, {r('w.mae')} AS winner_mae,
  round((b.mae - w.mae) / b.mae * 100, 2) + 0.0 AS improvement_pct
  FROM winners w JOIN model_means b ON w.target = b.target AND b.model = 'naive'""", "winners", "model_means"))
def baseline_improvement(t):
    return rounded(S.baseline_improvement(dev_scores(t), winners(t)))


@query("ablation_pivot", sql(f"""SELECT target, {', '.join(f"{r(f'''avg(mae) FILTER (model = '{m}')''')} AS {m}" for m in MODELS)}
  FROM dev_scores GROUP BY target""", "dev_scores"))
def ablation_pivot(t):
    return rounded(S.score_pivot(dev_scores(t), "model", list(MODELS)))


ROLLING = ("last3_", "last5_", "last10_", "last60d_", "last120d_")


def _family_rows() -> str:
    def member(c):
        if c in K.WORKLOAD_COLUMNS:
            return 1
        if c.startswith("season_") or c in ("month", "home_indicator"):
            return 0
        return 2 if c.startswith("opponent_") else 3 if c.startswith(ROLLING) else 4

    return " UNION ALL ".join(
        f"SELECT '{f}' AS family, CAST({sum(member(c) <= i for c in FEATURES)} AS BIGINT) AS columns, "
        f"count(*) AS n_rows FROM app" for i, f in enumerate(K.FAMILIES)
    )


@query("feature_family_counts", sql(_family_rows(), "app"))
def feature_family_counts(t):
    """Number of model inputs per family next to the rows they are defined on."""
    schema = t.features
    sizes = F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(len(S.feature_columns(schema, f, ROLLING))).cast("bigint").alias("columns"))
        for f in K.FAMILIES
    ])
    return t.appearances.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(sizes), "n_rows")


@query("fold_feature_columns", sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n FROM features WHERE season < 1997" for c in FEATURES)
    + ")", "features").replace("features AS (", "features AS MATERIALIZED ("))
def fold_feature_columns(t):
    return S.observed_columns(t.features.where(F.col("season") < 1997), FEATURES)


# --- exact quantiles and diagnostics ---------------------------------------------------------------

def quantile_sql(source: str, by: str, value: str, p: float) -> str:
    """Linear interpolation between the two neighbouring order statistics."""
    p = f"{p!r}::DOUBLE"
    return f"""(SELECT {by}, min(v) FILTER (rn = floor({p} * (n - 1))) + (min(v) FILTER (rn = ceil({p} * (n - 1)))
     - min(v) FILTER (rn = floor({p} * (n - 1)))) * (any_value({p} * (n - 1)) - floor(any_value({p} * (n - 1)))) AS q
   FROM (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS rn,
     count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {value} IS NOT NULL) GROUP BY {by})"""


@query("exact_quantiles", sql("""SELECT supp AS l_suppkey, a.q AS q10, b.q AS q50, c.q AS q99 FROM
  (SELECT l_suppkey AS supp, q FROM """ + quantile_sql("lineitem", "l_suppkey", "l_extendedprice", 0.1) + """) a JOIN
  (SELECT l_suppkey AS supp, q FROM """ + quantile_sql("lineitem", "l_suppkey", "l_extendedprice", 0.5) + """) b USING (supp) JOIN
  (SELECT l_suppkey AS supp, q FROM """ + quantile_sql("lineitem", "l_suppkey", "l_extendedprice", 0.99) + """) c USING (supp)"""))
def exact_quantiles_query(t):
    df = exact_quantiles(t.lineitem, ["l_suppkey"], "l_extendedprice", [0.1, 0.5, 0.99])
    return df.select("l_suppkey", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q10", "q50", "q99"))])


part("won", "SELECT p.* FROM predictions p JOIN winners w USING (target, model)", "predictions", "winners")
part("tiers", "SELECT a.target, a.model, a.q AS q1, b.q AS q2 FROM "
     + quantile_sql("won", "target, model", "prediction", 1 / 3) + " a JOIN "
     + quantile_sql("won", "target, model", "prediction", 2 / 3) + " b USING (target, model)", "won")
part("bucket_rows", """SELECT won.target, won.model, won.split, prediction - actual AS e, CAST(won.season AS VARCHAR) AS season,
   pitcher_handedness, CASE WHEN pitcher_starts_before_game < 5 THEN 'early_season' ELSE 'established' END AS experience_bucket,
   CASE WHEN prediction <= q1 THEN 'low' WHEN q1 = q2 OR prediction <= q2 THEN 'medium' ELSE 'high' END AS projection_tier
  FROM won JOIN tiers USING (target, model)
  JOIN score_rows s ON s.season = won.season AND s.game_id = won.game_id AND s.pitcher_mlbam_id = won.pitcher_mlbam_id""",
     "won", "tiers", "score_rows")


@query("bucketed_errors", sql(" UNION ALL ".join(
    f"""SELECT target, model, split, '{b}' AS bucket_type, {b} AS bucket_value, {r('avg(abs(e))')} AS mae,
      {r('avg(e)')} AS bias, count(*) AS n FROM bucket_rows GROUP BY target, model, split, {b}"""
    for b in ("season", "pitcher_handedness", "projection_tier", "experience_bucket")), "bucket_rows"))
def bucketed_errors(t):
    won = S.winners_only(t.forecasts, winners(t))
    return rounded(D.bucketed_errors(won, t.score_rows))


def _bucket_sql(totals: bool) -> str:
    rows = [(b, b) for b in ("season", "pitcher_handedness", "projection_tier", "experience_bucket")]
    rows += [("all", "CAST(NULL AS VARCHAR)")] if totals else []
    return " UNION ALL ".join(
        f"""SELECT target, model, split, '{kind}' AS bucket_type, {value} AS bucket_value, {r('avg(abs(e))')} AS mae,
      {r('avg(e)')} AS bias, count(*) AS n FROM bucket_rows GROUP BY target, model, split{'' if kind == 'all' else f', {value}'}"""
        for kind, value in rows)


@query("error_rollup", sql(_bucket_sql(True), "bucket_rows"))
def error_rollup(t):
    """All groupings and totals from error sums that were made per season and merged."""
    won = S.winners_only(t.forecasts, winners(t))
    sums = D.error_sums(won, t.score_rows)
    return rounded(D.merged_errors(sums, totals=True))


@query("residual_summary", sql(f"""SELECT x.target, x.model, x.split, {r('residual_mean')} AS residual_mean,
   {r('residual_std')} AS residual_std, {r('residual_skew')} AS residual_skew, {r('a.q')} AS residual_p05,
   {r('b.q')} AS residual_p95, extreme_residual_count_gt3sd, zero_clipped_predictions, n FROM
  (SELECT target, model, split, avg(e) AS residual_mean, stddev_samp(e) AS residual_std, skewness(e) AS residual_skew,
    count(*) FILTER (abs(e) > 3 * sd) AS extreme_residual_count_gt3sd,
    count(*) FILTER (prediction <= 0) AS zero_clipped_predictions, count(*) AS n
   FROM (SELECT *, stddev_samp(e) OVER (PARTITION BY target, model, split) AS sd FROM residuals)
   GROUP BY target, model, split) x
  JOIN {quantile_sql('residuals', 'target, model, split', 'e', 0.05)} a USING (target, model, split)
  JOIN {quantile_sql('residuals', 'target, model, split', 'e', 0.95)} b USING (target, model, split)""", "predictions").replace(
    "\nSELECT x.target", ", residuals AS (SELECT *, prediction - actual AS e FROM predictions)\nSELECT x.target", 1))
def residual_summary(t):
    return rounded(D.residual_summary(t.forecasts))


LAST = "train_1995_1999_validate_2000"


@query("overfit_gap", sql(f"""SELECT v.target, v.model, {r('v.mae')} AS validation_mae, {r('h.mae')} AS holdout_mae,
  {r('h.mae - v.mae')} AS gap, {r('(h.mae - v.mae) / v.mae * 100')} AS gap_pct
  FROM scores v JOIN scores h USING (target, model) WHERE v.split = '{LAST}' AND h.split LIKE 'holdout%'""", "scores"))
def overfit_gap(t):
    all_scores = staged_scores(t)
    holdout = all_scores.where(F.col("split").startswith("holdout"))
    return rounded(D.overfit_gap(all_scores, holdout, LAST))


PROXY = {"constant": "pitcher_history", "naive": "workload", "recent": "opponent", "ensemble": "recent"}
RANKED = list(PROXY.values())


@query("family_deltas", sql("SELECT target, " + ", ".join(
    f"{r(f'''avg(mae) FILTER (model = '{m}')''')} AS {f}" for m, f in PROXY.items()) + ", " + ", ".join(
    f"{r(f'''avg(mae) FILTER (model = '{b}') - avg(mae) FILTER (model = '{a}')''')} AS delta_vs_prior_adding_{PROXY[b]}"
    for a, b in zip(list(PROXY), list(PROXY)[1:])) + " FROM dev_scores GROUP BY target", "dev_scores"))
def family_deltas(t):
    """Each closed-form model stands for one feature family."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in PROXY.items() for x in kv]), F.col("model"))
    return rounded(D.family_deltas(dev_scores(t).withColumn("feature_family", named), RANKED))


@query("oos_residuals", sql("""SELECT season, game_id, pitcher_mlbam_id, won.target, actual - prediction AS residual
  FROM won""", "won"))
def oos_residuals(t):
    """Out-of-sample residuals of the winners, all validation seasons and the holdout."""
    won = S.winners_only(t.forecasts, winners(t))
    return won.select(*S.PREDICTION_KEYS, "target", (F.col("actual") - F.col("prediction")).alias("residual"))

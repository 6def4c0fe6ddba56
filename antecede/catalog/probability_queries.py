"""Distributions and calibration (D1-D18) on out-of-sample forecasts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from antecede.catalog.registry import big, part, query, r, r6, rounded, sql
from antecede.catalog.scoring_queries import quantile_sql
from antecede.functions import constants as K
from antecede.functions.expr import clip_probability
from antecede.functions.tails import negative_binomial_over, poisson_over
from antecede.operators import bundle as B
from antecede.operators import calibration as C
from antecede.operators import distributions as D
from antecede.operators import scoring as S
from antecede.plans.standin import GRIDS, HOLDOUT_SEASON
from antecede.session import scratch_path

KEY = "season, game_id, pitcher_mlbam_id, target"
part("points", f"""SELECT {KEY}, actual, prediction FROM predictions
  WHERE model = 'ensemble' AND target IN ('strikeouts', 'outs_recorded')""", "predictions")
part("lines", " UNION ALL ".join(
    f"SELECT '{t}' AS target, unnest({list(g)}::DOUBLE[]) AS line" for t, g in GRIDS.items()))
part("grid", """SELECT points.*, line, CASE WHEN actual > line THEN 1::BIGINT ELSE 0::BIGINT END AS actual_over
  FROM points JOIN lines USING (target)""", "points", "lines")


def poisson_sql(mean: str, line: str = "line") -> str:
    mu = f"greatest({mean}, 1e-6)"
    return (f"(1.0 - list_sum(list_transform(range(0, CAST(floor({line}) AS BIGINT) + 1), "
            f"lambda k: exp(-{mu} + k * ln({mu}) - lgamma(k + 1)))))")


def nb_sql(mean: str, alpha: str, line: str = "line") -> str:
    mu, n = f"greatest({mean}, 1e-6)", f"(1.0 / {alpha})"
    p = f"({n} / ({n} + {mu}))"
    return (f"CASE WHEN {alpha} <= 1e-6 THEN {poisson_sql(mean, line)} ELSE (1.0 - list_sum(list_transform("
            f"range(0, CAST(floor({line}) AS BIGINT) + 1), lambda k: exp(lgamma(k + {n}) - lgamma({n}) - lgamma(k + 1) "
            f"+ {n} * ln({p}) + k * ln(1 - {p}))))) END")


def clipped(expression: str) -> str:
    return f"least(greatest({expression}, 1e-6), 1 - 1e-6)"


part("prob", f"SELECT *, {clipped(poisson_sql('prediction'))} AS probability_over FROM grid", "grid")


def probability_rows(t):
    return D.poisson_probabilities(t.points, GRIDS)


OUT = ["season", "game_id", "pitcher_mlbam_id", "target", "line"]


@query("line_grid", sql("SELECT * FROM grid", "grid"))
def line_grid(t):
    return D.line_grid(t.points, GRIDS)


@query("poisson_tail", sql(f"SELECT {KEY}, line, actual_over, {r('probability_over')} AS probability_over FROM prob", "prob"))
def poisson_tail(t):
    rows = probability_rows(t)
    return rows.select(*OUT, "actual_over", r6("probability_over").alias("probability_over"))


@query("poisson_tail_line_column", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  {r(clipped(poisson_sql('l_quantity / 4', 'l_linenumber * 2 + 0.5')))} AS probability_over FROM lineitem""")
def poisson_tail_line_column(t):
    """The line differs per row, so the sum is folded over a sequence."""
    over = poisson_over(F.col("l_quantity") / 4, F.col("l_linenumber") * 2 + 0.5)
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6(clip_probability(over)).alias("probability_over")
    )


DISPERSION = "greatest(avg(((actual - greatest(prediction, 1e-6)) ** 2 - greatest(prediction, 1e-6)) / greatest(prediction, 1e-6) ** 2), 1e-6)"
part("alphas", f"SELECT target, {DISPERSION} AS alpha FROM points WHERE season < {HOLDOUT_SEASON} GROUP BY target", "points")


def dev(t):
    return t.points.where(F.col("season") < HOLDOUT_SEASON)


def holdout(t):
    return t.points.where(F.col("season") == HOLDOUT_SEASON)


@query("nb_dispersion", sql(f"SELECT target, {r('alpha')} AS alpha FROM alphas", "alphas"))
def nb_dispersion(t):
    return rounded(D.fit_dispersion(dev(t), ["target"]))


@query("nb_tail", sql(f"""SELECT {KEY}, line, actual_over, {r(clipped(nb_sql('prediction', 'alpha')))} AS probability_over
  FROM grid JOIN alphas USING (target) WHERE season = {HOLDOUT_SEASON}""", "grid", "alphas"))
def nb_tail(t):
    rows = D.negative_binomial_probabilities(holdout(t), dev(t), ["target"], GRIDS)
    return rows.select(*OUT, "actual_over", r6("probability_over").alias("probability_over"))


@query("nb_tail_over_dispersed", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  {r(clipped(nb_sql('l_quantity / 4', '(l_discount + 0.01)', 'l_linenumber * 2 + 0.5')))} AS probability_over FROM lineitem""")
def nb_tail_over_dispersed(t):
    over = negative_binomial_over(
        F.col("l_quantity") / 4, F.col("l_linenumber") * 2 + 0.5, F.col("l_discount") + 0.01
    )
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6(clip_probability(over)).alias("probability_over")
    )


# --- empirical --------------------------------------------------------------------------------------

part("residuals", f"""SELECT target, prediction, round(actual - prediction, 9) AS v FROM points
  WHERE season < {HOLDOUT_SEASON}""", "points")
part("asked", f"SELECT *, round(line - prediction, 9) AS th FROM grid WHERE season = {HOLDOUT_SEASON}", "grid")


@query("empirical_tail", sql(f"""SELECT {KEY}, line, actual_over, {r(clipped('share'))} AS probability_over FROM asked
  JOIN (SELECT target, th, count(*) FILTER (v > th) / CAST(count(*) AS DOUBLE) AS share
    FROM (SELECT DISTINCT target, th FROM asked) JOIN residuals USING (target) GROUP BY target, th) USING (target, th)""",
    "asked", "residuals"))
def empirical_tail(t):
    rows = D.empirical_probabilities(holdout(t), dev(t), ["target"], False, GRIDS)
    return rows.select(*OUT, "actual_over", r6("probability_over").alias("probability_over"))


def edges_sql(source: str, by: str) -> str:
    qs = [quantile_sql(source, by, "prediction", k / 5) for k in range(6)]
    joined = qs[0] + " q0 " + " ".join(f"JOIN {q} q{k} USING ({by})" for k, q in enumerate(qs) if k)
    return f"""SELECT {by}, CASE WHEN len(d) >= 3 THEN d[2:len(d)-1] ELSE []::DOUBLE[] END AS edges FROM (
      SELECT {by}, list_sort(list_distinct([{', '.join(f'q{k}.q' for k in range(6))}])) AS d FROM {joined})"""


BIN = "len(list_filter(edges, lambda e: e <= prediction))"
part("edges", edges_sql("residuals", "target"), "residuals")
part("binned", f"SELECT target, v, {BIN} AS bin FROM residuals JOIN edges USING (target)", "residuals", "edges")
part("large", "SELECT target, bin FROM binned GROUP BY target, bin HAVING count(*) >= 250", "binned")
part("pool", """SELECT target, -1 AS bin, v FROM binned UNION ALL
  SELECT target, bin, v FROM binned JOIN large USING (target, bin)""", "binned", "large")
part("asked_bins", f"""SELECT a.*, coalesce(l.bin, -1) AS use_bin FROM (SELECT asked.*, {BIN} AS bin FROM asked
  JOIN edges USING (target)) a LEFT JOIN large l ON a.target = l.target AND a.bin = l.bin""", "asked", "edges", "large")


@query("conditional_empirical_tail", sql(f"""SELECT {KEY}, line, actual_over, {r(clipped('share'))} AS probability_over
  FROM asked_bins JOIN (SELECT a.target, a.use_bin, th, count(*) FILTER (v > th) / CAST(count(*) AS DOUBLE) AS share
    FROM (SELECT DISTINCT target, use_bin, th FROM asked_bins) a JOIN pool p ON p.target = a.target AND p.bin = a.use_bin
    GROUP BY a.target, a.use_bin, th) USING (target, use_bin, th)""", "asked_bins", "pool"))
def conditional_empirical_tail(t):
    rows = D.empirical_probabilities(holdout(t), dev(t), ["target"], True, GRIDS)
    return rows.select(*OUT, "actual_over", r6("probability_over").alias("probability_over"))


CONDITIONAL_SQL = sql(f"""SELECT {KEY}, line, actual_over, {r(clipped('share'))} AS probability_over
  FROM asked_bins JOIN (SELECT a.target, a.use_bin, th, count(*) FILTER (v > th) / CAST(count(*) AS DOUBLE) AS share
    FROM (SELECT DISTINCT target, use_bin, th FROM asked_bins) a JOIN pool p ON p.target = a.target AND p.bin = a.use_bin
    GROUP BY a.target, a.use_bin, th) USING (target, use_bin, th)""", "asked_bins", "pool")


@query("merged_residual_tail", CONDITIONAL_SQL)
def merged_residual_tail(t):
    """The same probabilities from residuals that were counted season by season and added up."""
    history = dev(t)
    edges = D.bin_edges(history, ["target"])
    seasons = sorted(x.season for x in history.select("season").distinct().collect())  # a handful
    table = B.ResidualTable.of(history.where(F.col("season") == seasons[0]), ["target"], edges)
    for season in seasons[1:]:
        table = table.with_history(history.where(F.col("season") == season))
    rows = table.probabilities(holdout(t), GRIDS)
    return rows.select(*OUT, "actual_over", r6("probability_over").alias("probability_over"))


@query("frozen_bundle_forward", CONDITIONAL_SQL)
def frozen_bundle_forward(t):
    """Models and residuals frozen on the seasons before the holdout, saved, loaded, and applied to it."""
    past = t.score_rows.where(F.col("season") < HOLDOUT_SEASON)
    means = past.agg(*[F.avg(target).alias(target) for target in GRIDS]).first().asDict()
    models = {}
    for target, mean in means.items():
        own = f"coalesce(`{K.NAIVE_FEATURE[target]}`, {mean!r}D)"
        models[target] = PipelineModel([SQLTransformer(statement=f"select *, ({own} + {mean!r}D) / 2.0D as prediction from __THIS__")])
    path = scratch_path(t.spark, "bundle")
    B.freeze(path, models, sorted({K.NAIVE_FEATURE[target] for target in GRIDS}), B.ResidualTable.of(dev(t), ["target"]), "v1")
    bundle = B.load(t.spark, path, "v1")
    rows = bundle.probabilities(t.score_rows.where(F.col("season") == HOLDOUT_SEASON), GRIDS)
    return rows.select(*OUT, "actual_over", r6("probability_over").alias("probability_over"))


# --- method selection over expanding folds --------------------------------------------------------

part("folds", f"""SELECT DISTINCT p.season AS fold FROM points p WHERE season < {HOLDOUT_SEASON} AND
  season > (SELECT min(season) FROM points)""", "points")
part("f_hist", "SELECT fold, target, actual, prediction, round(actual - prediction, 9) AS v FROM points JOIN folds ON season < fold", "points", "folds")
part("f_grid", "SELECT fold, grid.*, round(line - prediction, 9) AS th FROM grid JOIN folds ON season = fold", "grid", "folds")
part("f_alpha", f"SELECT fold, target, {DISPERSION} AS alpha FROM f_hist GROUP BY fold, target", "f_hist")
part("f_edges", edges_sql("f_hist", "fold, target"), "f_hist")
part("f_binned", f"SELECT fold, target, v, {BIN} AS bin FROM f_hist JOIN f_edges USING (fold, target)", "f_hist", "f_edges")
part("f_large", "SELECT fold, target, bin FROM f_binned GROUP BY ALL HAVING count(*) >= 250", "f_binned")
part("f_pool", """SELECT fold, target, -1 AS bin, v FROM f_binned UNION ALL
  SELECT fold, target, bin, v FROM f_binned JOIN f_large USING (fold, target, bin)""", "f_binned", "f_large")
part("f_asked", f"""SELECT a.*, coalesce(l.bin, -1) AS use_bin FROM (SELECT f_grid.*, {BIN} AS bin FROM f_grid
  JOIN f_edges USING (fold, target)) a LEFT JOIN f_large l ON a.fold = l.fold AND a.target = l.target AND a.bin = l.bin""",
     "f_grid", "f_edges", "f_large")


def share_sql(bin_column: str) -> str:
    return f"""(SELECT a.fold, a.target, a.b, th, count(*) FILTER (v > th) / CAST(count(*) AS DOUBLE) AS share
    FROM (SELECT DISTINCT fold, target, {bin_column} AS b, th FROM f_asked) a
    JOIN f_pool p ON p.fold = a.fold AND p.target = a.target AND p.bin = a.b GROUP BY a.fold, a.target, a.b, th)"""


part("f_prob", f"""SELECT fold, target, 'poisson' AS method, actual_over, {clipped(poisson_sql('prediction'))} AS p FROM f_grid
 UNION ALL SELECT fold, target, 'negative_binomial', actual_over, {clipped(nb_sql('prediction', 'alpha'))} FROM f_grid JOIN f_alpha USING (fold, target)
 UNION ALL SELECT fold, target, 'empirical', actual_over, {clipped('share')} FROM f_asked JOIN {share_sql('-1')} s USING (fold, target, th)
 UNION ALL SELECT f_asked.fold, f_asked.target, 'conditional_empirical', actual_over, {clipped('share')} FROM f_asked
   JOIN {share_sql('use_bin')} s ON s.fold = f_asked.fold AND s.target = f_asked.target AND s.b = use_bin AND s.th = f_asked.th""",
     "f_grid", "f_alpha", "f_asked", "f_pool")
SCORE = """avg((p - actual_over) ** 2) AS brier,
  avg(CASE WHEN actual_over = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS log_loss, count(*) AS n"""
part("f_scores", f"SELECT fold, target, method, {SCORE} FROM f_prob GROUP BY fold, target, method", "f_prob")


def method_scores(t):
    return D.validate_methods(dev(t), grids=GRIDS)


@query("distribution_validation", sql(f"""SELECT fold, target, method, {r('brier')} AS brier, {r('log_loss')} AS log_loss, n
  FROM f_scores""", "f_scores"))
def distribution_validation(t):
    return rounded(method_scores(t))


@query("select_distribution", sql(f"""SELECT target, method, {r('brier')} AS brier, {r('log_loss')} AS log_loss FROM (
  SELECT target, method, avg(brier) AS brier, avg(log_loss) AS log_loss, row_number() OVER (PARTITION BY target
    ORDER BY round(avg(brier), 12), round(avg(log_loss), 12), method) AS rn FROM f_scores GROUP BY target, method)
  WHERE rn = 1""", "f_scores"))
def select_distribution(t):
    return rounded(D.select_distribution(method_scores(t)))


# --- calibration -----------------------------------------------------------------------------------

BIN10 = " + ".join(f"(probability_over > {k * 0.1!r})::BIGINT" for k in range(1, 10))


def calibration_sql(source: str) -> str:
    return f"""SELECT target, bin, coalesce(n, 0) AS n, predicted_probability, observed_rate,
     predicted_probability - observed_rate AS calibration_error
    FROM (SELECT DISTINCT target FROM {source}) CROSS JOIN (SELECT CAST(i AS BIGINT) AS bin FROM range(10) t(i))
    LEFT JOIN (SELECT target, {BIN10} AS bin, count(*) AS n, avg(probability_over) AS predicted_probability,
      avg(actual_over) AS observed_rate FROM {source} GROUP BY 1, 2) USING (target, bin)"""


part("calibration", calibration_sql("prob"), "prob")
part("ece", """SELECT target, sum(abs(calibration_error) * n) / sum(n) AS expected_calibration_error
  FROM calibration WHERE calibration_error IS NOT NULL GROUP BY target""", "calibration")
CAL = ", ".join(f"{r(c)} AS {c}" for c in ("predicted_probability", "observed_rate", "calibration_error"))


@query("probability_scores", sql(f"""SELECT target, {r('brier')} AS brier, {r('log_loss')} AS log_loss, n FROM
  (SELECT target, {SCORE.replace('p -', 'probability_over -').replace('ln(p)', 'ln(probability_over)').replace('(1 - p)', '(1 - probability_over)')}
   FROM prob GROUP BY target)""", "prob"))
def probability_scores(t):
    return rounded(D.probability_scores(probability_rows(t), ["target"]))


@query("calibration_table", sql(f"SELECT target, bin, n, {CAL} FROM calibration", "calibration"))
def calibration_table(t):
    return rounded(C.calibration_table(probability_rows(t)))


@query("expected_calibration_error", sql(f"SELECT target, {r('expected_calibration_error')} AS expected_calibration_error FROM ece", "ece"))
def expected_calibration_error(t):
    return rounded(C.expected_calibration_error(C.calibration_table(probability_rows(t))))


# Rows with gaps and bumps, so that the check has something to find.
part("bumpy", """SELECT season, game_id, pitcher_mlbam_id, target, line,
  probability_over + CASE WHEN (game_id + pitcher_mlbam_id) % 5 = 0 AND line = 2.5 THEN 0.5 ELSE 0.0 END AS probability_over
  FROM prob WHERE NOT ((game_id + pitcher_mlbam_id) % 3 = 0 AND line = 1.5)""", "prob")
part("bumpy_dense", """SELECT *, lag(probability_over) OVER (PARTITION BY target, season, game_id, pitcher_mlbam_id ORDER BY line) AS before
  FROM (SELECT k.*, line, probability_over FROM (SELECT DISTINCT season, game_id, pitcher_mlbam_id, target FROM bumpy) k
   JOIN lines USING (target) LEFT JOIN bumpy USING (season, game_id, pitcher_mlbam_id, target, line))""", "bumpy", "lines")


@query("monotonicity_violations", sql("""SELECT target, count(*) FILTER (probability_over - before > 1e-12) AS monotonicity_violations
  FROM bumpy_dense GROUP BY target""", "bumpy_dense"))
def monotonicity_violations(t):
    who = F.col("game_id") + F.col("pitcher_mlbam_id")
    rows = probability_rows(t).where(~((who % 3 == 0) & (F.col("line") == 1.5))).withColumn(
        "probability_over",
        F.col("probability_over") + F.when((who % 5 == 0) & (F.col("line") == 2.5), 0.5).otherwise(0.0),
    )
    return C.monotonicity_violations(rows)


PROB_SCORE = SCORE.replace("p -", "probability_over -").replace("ln(p)", "ln(probability_over)").replace("(1 - p)", "(1 - probability_over)")
MEANS = """avg(probability_over) AS mean_predicted_over, avg(actual_over) AS actual_over_rate,
  avg(probability_over) - avg(actual_over) AS calibration_error"""


@query("per_line_scores", sql("SELECT target, line, n, " + ", ".join(f"{r(c)} AS {c}" for c in (
    "brier", "log_loss", "mean_predicted_over", "actual_over_rate", "calibration_error"))
    + f" FROM (SELECT target, line, {PROB_SCORE}, {MEANS} FROM prob GROUP BY target, line)", "prob"))
def per_line_scores(t):
    return rounded(C.per_line_scores(probability_rows(t)), "brier", "log_loss", "mean_predicted_over", "actual_over_rate", "calibration_error")


CHECKED = {"strikeouts": (0.5, 1.5, 2.5), "outs_recorded": (1.5, 2.5, 3.5, 4.5)}
AVG3 = """count(*) AS n, avg(probability_over) AS predicted, avg(actual_over) AS observed,
  avg(probability_over) - avg(actual_over) AS calibration_error"""
THREE = ", ".join(f"{r(c)} AS {c}" for c in ("predicted", "observed", "calibration_error"))


@query("calibration_at_lines", sql(f"""SELECT target, line, n, {THREE} FROM (SELECT target, line, {AVG3} FROM prob
  WHERE season = {HOLDOUT_SEASON} AND ((target = 'strikeouts' AND line IN (0.5, 1.5, 2.5)) OR
   (target = 'outs_recorded' AND line IN (1.5, 2.5, 3.5, 4.5))) GROUP BY target, line)""", "prob"))
def calibration_at_lines(t):
    rows = C.calibration_at_lines(probability_rows(t), CHECKED, HOLDOUT_SEASON)
    return rounded(rows, "predicted", "observed", "calibration_error")


@query("calibration_buckets", sql(f"""SELECT target, bucket, n, {THREE} FROM (SELECT target, CASE
   WHEN probability_over >= 0.55 AND probability_over < 0.60 THEN '55-60%'
   WHEN probability_over >= 0.60 AND probability_over < 0.65 THEN '60-65%'
   WHEN probability_over >= 0.65 AND probability_over < 0.70 THEN '65-70%'
   WHEN probability_over >= 0.70 THEN '70%+' END AS bucket, {AVG3} FROM prob GROUP BY 1, 2)
  WHERE bucket IS NOT NULL""", "prob"))
def calibration_buckets(t):
    return rounded(C.calibration_buckets(probability_rows(t)))


SUMMARY = f"""SELECT target, {r('brier')} AS brier, {r('log_loss')} AS log_loss, n,
  {r('expected_calibration_error')} AS expected_calibration_error, {r('probability_std')} AS probability_std,
  CAST(0 AS BIGINT) AS monotonicity_violations"""


@query("probability_summary", sql(SUMMARY + f""" FROM (SELECT target, {PROB_SCORE}, stddev_samp(probability_over) AS probability_std
  FROM prob GROUP BY target) JOIN ece USING (target)""", "prob", "ece"))
def probability_summary(t):
    return rounded(C.probability_summary(probability_rows(t)))


part("prob_h", f"SELECT * FROM prob WHERE season = {HOLDOUT_SEASON}", "prob")
part("calibration_h", calibration_sql("prob_h"), "prob_h")


@query("forward_evaluation", sql(SUMMARY + f""", {r('mae')} AS mae, {r('bias')} AS bias
  FROM (SELECT target, {PROB_SCORE}, stddev_samp(probability_over) AS probability_std FROM prob_h GROUP BY target)
  JOIN (SELECT target, sum(abs(calibration_error) * n) / sum(n) AS expected_calibration_error FROM calibration_h
    WHERE calibration_error IS NOT NULL GROUP BY target) USING (target)
  JOIN (SELECT target, avg(abs(greatest(prediction, 0.0) - actual)) AS mae, avg(greatest(prediction, 0.0) - actual) AS bias
    FROM points WHERE season = {HOLDOUT_SEASON} GROUP BY target) USING (target)""", "prob_h", "calibration_h", "points"))
def forward_evaluation(t):
    """The unseen season: forecasts and probabilities frozen before it, scored once."""
    rows = D.poisson_probabilities(holdout(t), GRIDS)
    point = S.point_scores(holdout(t), ["target"]).select("target", "mae", "bias")
    return rounded(C.probability_summary(rows).join(point, "target"))


@query("forward_errors", sql(f"""SELECT {KEY}, actual, prediction, prediction - actual AS signed_error FROM points
  WHERE season = {HOLDOUT_SEASON}""", "points"))
def forward_errors(t):
    return holdout(t).withColumn("signed_error", S.signed_error())


ODDS = "CASE WHEN {p} >= 0.5 THEN -100.0 * {p} / (1 - {p}) ELSE 100.0 * (1 - {p}) / {p} END"


def odds_sql(p: str) -> str:
    return f"round({ODDS.replace('{p}', clipped(p))}, 2) + 0.0"


@query("fair_odds_table", sql(f"""SELECT {KEY}, line, {r('probability_over')} AS probability_over,
  {r('1 - probability_over')} AS probability_under, {odds_sql('probability_over')} AS fair_odds_over,
  {odds_sql('(1 - probability_over)')} AS fair_odds_under FROM prob_h""", "prob_h"))
def fair_odds_table(t):
    rows = C.fair_odds_table(D.poisson_probabilities(holdout(t), GRIDS))
    return rows.select(
        *OUT,
        r6("probability_over").alias("probability_over"),
        r6("probability_under").alias("probability_under"),
        *[(F.round(c, 2) + F.lit(0.0)).alias(c) for c in ("fair_odds_over", "fair_odds_under")],
    )

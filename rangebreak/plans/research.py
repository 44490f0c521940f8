"""Registered queries: statistics, the study and the forecast."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from rangebreak.operators import forecast as fc
from rangebreak.operators import stats, study, trades
from rangebreak.params import DIRECTIONAL_FEATURES
from rangebreak.functions.frames import unpivot_features
from rangebreak.plans import catalogue
from rangebreak.plans.sql import research as sql
from rangebreak.plans.sql.base import num

# These plans read bars on several branches.
query = partial(catalogue.query, stage=True)

FIND = f"""feature, two_sided, measurable, {num('gap_all', 'gap_first', 'gap_second', digits=4)},
 failures_first, failures_second, testable, holds"""


@query("split_date", "w", "SELECT d::VARCHAR AS split_date FROM split_$")
def split_date(fx):
    return study.split_date(fx.context, fx.params)


@query("feature_buckets", "w", f"SELECT feature, scope, third, {num('lower', 'upper')}, n FROM thirds_$")
def feature_buckets(fx):
    return study.feature_buckets(fx.feature_stage, fx.params)


@query("bust_rate_by_third", "w", f"""SELECT feature, scope, third, {num('lower', 'upper')}, n, busted AS failures, {num('failure_pct')},
 table_n, table_failures, round(table_failures / table_n * 100, 6) AS base_pct FROM rates_$""")
def bust_rate_by_third(fx):
    return study.bust_rate_by_third(fx.feature_stage, fx.params)


@query("feature_findings", "w", f"SELECT {FIND} FROM find_$", digits=4)
def feature_findings(fx):
    return study.feature_findings(fx.feature_stage, fx.params)


STUDY = f"""SELECT n_breakouts, {num('base_rate_pct')}, split_date::VARCHAR AS split_date, second_half_failures, n_tested,
 n_directional, n_testable, n_holding, {num('family_error')}, verdict FROM study_$"""


@query("study_verdict", "w", STUDY)
def study_verdict(fx):
    return study.study_verdict(fx.feature_stage, fx.params)


@query("study_verdict_months", "m", STUDY)
def study_verdict_months(fx):
    return study.study_verdict(fx.feature_stage, fx.params)


@query("family_error", "w", """SELECT feature, n_tests, round(1 - pow(0.95::DOUBLE, n_tests), 6) AS family_error
 FROM (SELECT feature, count(*) AS n_tests FROM thirds_$ GROUP BY feature)""")
def family_error(fx):
    cuts = study.feature_buckets(fx.feature_stage, fx.params)
    return cuts.groupBy("feature").agg(F.count("*").alias("n_tests")).withColumn(
        "family_error", study.family_error(F.col("n_tests"), fx.params)
    )


_FLAGGED = "(SELECT direction, session_date, CASE WHEN label = 'BUSTED' THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM events_$)"


@query("session_bootstrap", "w", f"""SELECT direction, defined_draws, {num('ci_low', 'ci_high')} FROM
 ({sql.bootstrap(_FLAGGED, 'direction', 'y', '1', sql.MEAN)})""")
def session_bootstrap(fx):
    busted = (F.col("label") == "BUSTED").cast("double")
    return stats.session_bootstrap(fx.events, ["direction"], busted, F.lit(1), fx.params)


_SHARE = f"""SELECT direction, sum(m) AS n_rows, count(*) AS n_sessions, CASE WHEN sum(m) >= 2 THEN
 CASE WHEN any_value(tot) > 0 THEN sum(m * pow(mean - allmean, 2)) / any_value(tot) ELSE 0 END END AS variance_share FROM (
 SELECT s.*, a.allmean, a.tot FROM (SELECT direction, session_date, count(*) AS m, avg(y) AS mean FROM {_FLAGGED} GROUP BY ALL) s
 JOIN (SELECT direction, avg(y) AS allmean, var_pop(y) * count(*) AS tot FROM {_FLAGGED} GROUP BY direction) a USING (direction)) GROUP BY direction"""


@query("session_variance_share", "w", f"SELECT direction, n_rows, n_sessions, {num('variance_share')} FROM ({_SHARE})")
def session_variance_share(fx):
    busted = (F.col("label") == "BUSTED").cast("double")
    return stats.session_variance_share(fx.context, ["direction"], busted)


@query("effective_sample_size", "w", f"""SELECT direction, n_rows, n_sessions, {num('variance_share')}, round(n_rows /
 (1 + (n_rows / n_sessions - 1) * least(greatest(variance_share, 0), 1)), 4) AS effective_rows FROM ({_SHARE})""".replace(", 6)", ", 4)"), digits=4)
def effective_sample_size(fx):
    busted = (F.col("label") == "BUSTED").cast("double")
    return stats.effective_sample_size(stats.session_variance_share(fx.context, ["direction"], busted))


_RULE_NUMBERS = num("lower", "upper", "raw_rate", "rate_busted", "rate_neither", "rate_sustained")


@query("shrink_rate", "w", f"SELECT feature, third, n, busted, {num('raw_rate', 'rate_busted')} FROM rule_$")
def shrink_rate(fx):
    return fc.fit_rule(fx.feature_stage, fx.params).select(
        "feature", "third", "n", "busted", "raw_rate", "rate_busted"
    )


@query("fit_rule", "w", f"""SELECT feature, third, n, busted, neither, sustained, n_train, train_busted, train_neither, train_sustained,
 {num('base_busted', 'base_neither', 'base_sustained')}, {_RULE_NUMBERS} FROM rule_$""")
def fit_rule(fx):
    return fc.fit_rule(fx.feature_stage, fx.params).drop("above", "through")


@query("assign_bucket", "w", f"""SELECT l.symbol, l.session_date::VARCHAR AS session_date, l.direction, l.feature, {num('l.value')}, r.third,
 {num('r.rate_busted')} FROM rows6_$ l JOIN cut6_$ c USING (feature) JOIN rule_$ r ON r.feature = l.feature AND
 r.third = CASE WHEN l.value <= c.e0 THEN 'low' WHEN l.value <= c.e1 THEN 'mid' ELSE 'high' END""")
def assign_bucket(fx):
    values = unpivot_features(fx.feature_stage, DIRECTIONAL_FEATURES, fc.ROW_KEY)
    hit = fc.assign_bucket(values, fc.fit_rule(fx.feature_stage, fx.params), ["feature"])
    return hit.select(*fc.ROW_KEY, "feature", "value", "third", "rate_busted")


_ROW = "symbol, session_date::VARCHAR AS session_date, direction"
_TAIL = f"""breakout_time::VARCHAR AS breakout_time, n_train, train_failures, features_used, outcome, {num('p_fail', 'base_rate',
 'p_busted', 'p_neither', 'p_sustained', 'base_busted', 'base_neither', 'base_sustained')}"""


@query("predict_binary", "w", f"SELECT {_ROW}, features_used, {num('p_fail', 'p_fail_average', 'base_rate')} FROM pred_$")
def predict_binary(fx):
    return fx.predictions.select(*fc.ROW_KEY, "features_used", "p_fail", "p_fail_average", "base_rate")


_THREE = tuple(f"p_{c}{s}" for s in ("", "_average") for c in fc.CLASSES)


@query("predict_three_way", "w", f"SELECT {_ROW}, features_used, {num(*_THREE)} FROM pred_$")
def predict_three_way(fx):
    return fx.predictions.select(*fc.ROW_KEY, "features_used", *_THREE)


@query("prediction_explain", "w", f"""SELECT {_ROW}, feature, third, {num('rate_busted', 'log_odds', 'rate_neither', 'rate_sustained')} FROM hits_$""")
def prediction_explain(fx):
    told = fc.prediction_explain(fx.feature_stage, fx.params)
    rows = told.select(*fc.ROW_KEY, "contributions", "log_odds", "class_rates", F.explode("buckets").alias("feature", "third"))
    return rows.select(
        *fc.ROW_KEY, "feature", "third",
        F.col("contributions")[F.col("feature")].alias("rate_busted"),
        F.col("log_odds")[F.col("feature")].alias("log_odds"),
        F.col("class_rates")[F.col("feature")]["neither"].alias("rate_neither"),
        F.col("class_rates")[F.col("feature")]["sustained"].alias("rate_sustained"),
    )


@query("walk_forward", "w", f"SELECT {_ROW}, {_TAIL} FROM pred_$")
def walk_forward(fx):
    return fc.walk_forward(fx.feature_stage, fx.params)


@query("walk_forward_by_supplier", "s", f"SELECT {_ROW}, {_TAIL} FROM pred_$")
def walk_forward_by_supplier(fx):
    return fc.walk_forward(fx.feature_stage, fx.params)


@query("compare_combinations", "w", f"""SELECT 'logodds' AS combination, count(*) AS n, round(avg(err), 6) AS brier, round(avg(base_err), 6) AS brier_base,
 round(1 - avg(err) / avg(base_err), 6) AS skill FROM rps_$ HAVING count(*) > 0 UNION ALL SELECT 'average', count(*), round(avg(err_average), 6), round(avg(base_err), 6),
 round(1 - avg(err_average) / avg(base_err), 6) FROM rps_$ HAVING count(*) > 0""")
def compare_combinations(fx):
    parts = [
        fc.brier_score(fc.as_combination(fx.predictions, c).withColumn("combination", F.lit(c)), fx.params, ["combination"])
        for c in ("logodds", "average")
    ]
    return parts[0].unionByName(parts[1]).select("combination", "n", "brier", "brier_base", "skill")


_VERDICT = "CASE WHEN {n} < 30 THEN 'insufficient_sample' WHEN ci_low IS NULL THEN NULL WHEN ci_low > 0 THEN 'informative' ELSE 'no_better_than_base_rate' END AS verdict"


@query("brier_score", "w", f"""SELECT n, n_sessions, failures, {num('variance_share', 'brier', 'brier_base')}, round(1 - brier / brier_base, 6) AS skill,
 {num('ci_low', 'ci_high')}, {_VERDICT.format(n='failures')} FROM (SELECT count(*) AS n, count(DISTINCT session_date) AS n_sessions,
 sum(a)::BIGINT AS failures, avg(err) AS brier, avg(base_err) AS brier_base FROM rps_$),
 ({sql.bootstrap('rps_$', '', 'err', 'base_err', sql.SKILL)}),
 (SELECT sum(m * pow(mean - allmean, 2)) / any_value(tot) AS variance_share FROM (SELECT count(*) AS m, avg(a) AS mean FROM rps_$ GROUP BY session_date),
 (SELECT avg(a) AS allmean, var_pop(a) * count(*) AS tot FROM rps_$))""")
def brier_score(fx):
    return fc.brier_score(fx.predictions, fx.params)


_BIN = "CASE WHEN p < 0.1 THEN {0} WHEN p < 0.2 THEN {1} WHEN p < 0.3 THEN {2} WHEN p < 0.5 THEN {3} ELSE {4} END"


@query("calibration", "w", f"""SELECT forecast, {_BIN.format('0.0', '0.1', '0.2', '0.3', '0.5')}::DOUBLE AS bin_low,
 {_BIN.format('0.1', '0.2', '0.3', '0.5', '1.0')}::DOUBLE AS bin_high, count(*) AS n, round(avg(p), 6) AS mean_forecast, round(avg(y), 6) AS observed_rate
 FROM (SELECT 'p_fail' AS forecast, p_fail AS p, a AS y FROM rps_$ UNION ALL SELECT 'p_busted', p_busted, a FROM rps_$
 UNION ALL SELECT 'p_sustained', p_sustained, 1.0::DOUBLE - b FROM rps_$) GROUP BY ALL""")
def calibration(fx):
    return fc.calibration(fx.predictions, fx.params)


@query("ranked_probability_score", "w", f"SELECT {_ROW}, {num('rps', 'rps_base')} FROM rps_$")
def ranked_probability_score(fx):
    return fc.ranked_probability_score(fx.predictions).select(*fc.ROW_KEY, "rps", "rps_base")


@query("three_way_score", "w", f"""SELECT n, n_sessions, busted, neither, sustained, CASE WHEN busted = least(busted, neither, sustained) THEN 'BUSTED'
 WHEN neither = least(busted, neither, sustained) THEN 'NEITHER' ELSE 'SUSTAINED' END AS rarest_class, least(busted, neither, sustained) AS rarest_count,
 {num('rps', 'rps_base')}, round(1 - rps / rps_base, 6) AS skill, {num('ci_low', 'ci_high', 'accuracy')},
 round(greatest(busted, neither, sustained) / nullif(n, 0), 6) AS accuracy_baseline, {_VERDICT.format(n='least(busted, neither, sustained)')}
 FROM (SELECT count(*) AS n, count(DISTINCT session_date) AS n_sessions, count(*) FILTER (outcome = 'BUSTED') AS busted,
 count(*) FILTER (outcome = 'NEITHER') AS neither, count(*) FILTER (outcome = 'SUSTAINED') AS sustained, avg(rps) AS rps, avg(rps_base) AS rps_base,
 avg(CASE WHEN outcome = CASE WHEN p_busted >= p_neither AND p_busted >= p_sustained THEN 'BUSTED'
  WHEN p_neither >= p_sustained THEN 'NEITHER' ELSE 'SUSTAINED' END THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM rps_$),
 ({sql.bootstrap('rps_$', '', 'rps', 'rps_base', sql.SKILL)})""")
def three_way_score(fx):
    return fc.three_way_score(fx.predictions, fx.params)


SETUP_GATE = """SELECT setup, symbol, session_date::VARCHAR AS session_date, direction, signal_slot FROM fobsig_$, study_$
 WHERE verdict = 'signal'"""


@query("setup_gate_months", "m", SETUP_GATE)
@query("setup_gate", "w", SETUP_GATE)
def setup_gate(fx):
    verdict = study.study_verdict(fx.feature_stage, fx.params)
    gated = trades.setup_gate(trades.failed_orb_signals(fx.events), verdict)
    return gated.select("setup", "symbol", "session_date", "direction", "signal_slot")

"""Registered queries: the random control, expectancy and the report tables."""

from __future__ import annotations

from functools import partial

from rangebreak.operators import summary as sm
from rangebreak.operators import study
from rangebreak.operators.control import LEVEL
from rangebreak.operators.trades import gate_setups
from rangebreak.plans import catalogue
from rangebreak.plans.research import FIND  # noqa: F401
from rangebreak.plans.sql import research  # noqa: F401  (registers the SQL steps)
from rangebreak.plans.sql.base import num

# These plans read bars on several branches.
query = partial(catalogue.query, stage=True)

L = "setup, variant, slippage_bps"
# The failed breakout is a setup only if the study found a signal.
GATE = "(setup <> 'failed_orb' OR (SELECT verdict FROM study_$) = 'signal')"


def gated(fx, results):
    return gate_setups(results, study.study_verdict(fx.feature_stage, fx.params))


@query("eligible_sessions", "m", f"SELECT symbol, session_date::VARCHAR AS session_date, n_bars, first_pos, last_pos, {num('atr')} FROM elig_$")
def eligible(fx):
    return fx.eligible


@query("matched_random", "m", f"""SELECT trade_id, symbol, session_date::VARCHAR AS session_date, setup, matched_setup, variant, direction, {num('atr')},
 1.0::DOUBLE AS stop_atr_multiple, entry_slot, entry_time::VARCHAR AS entry_time, {num('entry_price', 'stop_price')}, exit_slot, exit_time::VARCHAR AS exit_time,
 {num('exit_price')}, exit_reason, duration_bars, {num('mfe_price')} FROM twins_$""")
def twins(fx):
    return fx.twins


@query("edge_vs_random", "m", f"SELECT {L}, n, {num('mean_strategy_r', 'mean_random_r', 'edge_r', 'ci_low', 'ci_high', digits=5)}, flat FROM edge_$", digits=5)
def edges(fx):
    return fx.edges


_EXPECTANCY = num("win_rate", "avg_win_r", "avg_loss_r", "expectancy_r", "ci_low", "ci_high", "breakeven_failure_rate", digits=5)


@query("expectancy", "m", f"SELECT {L}, n, computed, {_EXPECTANCY}, flat FROM exp_$", digits=5)
def expectancy(fx):
    return fx.overall


@query("segment_keys", "m", """SELECT setup, variant, symbol, session_date::VARCHAR AS session_date, direction, slippage_bps, seg_rvol, seg_or_width,
 seg_half_hour FROM seg_$""")
def segment_keys(fx):
    return fx.segmented.select("setup", "variant", "symbol", "session_date", "direction", "slippage_bps", *sm.SEGMENTS)


@query("segmented_expectancy", "m", f"SELECT {L}, segment, segment_value, n, computed, {_EXPECTANCY}, flat FROM segexp_$", digits=5)
def segmented_expectancy(fx):
    return sm.segmented_expectancy(fx.segmented, fx.params)


@query("backtest_summary", "m", f"""SELECT {L}, n, flat, has_expectancy, {num('mean_strategy_r', 'mean_random_r', 'edge_r', 'ci_low', 'ci_high', 'win_rate',
 'avg_win_r', 'avg_loss_r', 'expectancy_r', 'expectancy_ci_low', 'expectancy_ci_high', 'breakeven_failure_rate', digits=5)} FROM bt_$ WHERE {GATE}""", digits=5)
def backtest_summary(fx):
    return gated(fx, sm.backtest_summary(fx.edges, fx.overall))


@query("results_by_role", "m", f"""SELECT {L}, role, symbol, session_date::VARCHAR AS session_date, direction, trade_id, {num('net_pnl', 'cost_total', 'r_net', digits=4)}
 FROM role_$""", digits=4)
def results_by_role(fx):
    return sm.results_by_role(fx.strategy_results, fx.random_results).select(
        *LEVEL, "role", "symbol", "session_date", "direction", "trade_id", "net_pnl", "cost_total", "r_net"
    )


@query("setup_verdict", "m", f"""SELECT setup, CASE WHEN NOT bool_and(has_expectancy) THEN 'insufficient sample'
 WHEN NOT bool_and(ci_low IS NOT NULL AND expectancy_ci_low IS NOT NULL) THEN NULL
 WHEN bool_and(ci_low > 0 AND expectancy_ci_low > 0) THEN 'edge detected' ELSE 'no edge' END AS setup_verdict
 FROM bt_$ WHERE variant = 'base' AND {GATE} GROUP BY setup""")
def setup_verdict(fx):
    return sm.setup_verdict(gated(fx, sm.backtest_summary(fx.edges, fx.overall)))


@query("money_summary", "m", f"""SELECT setup, slippage_bps, n_trades, round(per_trade, 2) AS per_trade, round(total, 2) AS total, slippage_bps = 10 AS is_middle,
 CASE WHEN slippage_bps = 10 THEN round_even(win_share * 10, 0) END AS wins_in_ten, CASE WHEN slippage_bps = 10 THEN round(cost, 2) END AS cost,
 CASE WHEN slippage_bps = 10 THEN round(random, 2) END AS random_mean, CASE WHEN slippage_bps = 10 THEN flat END AS same_as_random
 FROM (SELECT setup, slippage_bps, count(*) FILTER (role = 'strategy') AS n_trades, avg(net_pnl) FILTER (role = 'strategy') AS per_trade,
 sum(net_pnl) FILTER (role = 'strategy') AS total, avg(CASE WHEN net_pnl > 0 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (role = 'strategy') AS win_share,
 avg(cost_total) FILTER (role = 'strategy') AS cost, avg(net_pnl) FILTER (role = 'random') AS random FROM role_$ WHERE variant = 'base'
 GROUP BY setup, slippage_bps) JOIN (SELECT setup, slippage_bps, flat FROM edge_$ WHERE variant = 'base') USING (setup, slippage_bps) WHERE {GATE}""", digits=2)
def money_summary(fx):
    return gated(fx, sm.money_summary(sm.results_by_role(fx.strategy_results, fx.random_results), fx.edges))


@query("report_facts", "w", """SELECT n_breakouts, n_sessions, first_date::VARCHAR AS first_date, last_date::VARCHAR AS last_date, busted_pct, neither_pct, sustained_pct,
 (SELECT arg_max(feature, gap_all) FROM find_$ WHERE testable) AS best_feature, (SELECT round(max(gap_all), 6) FROM find_$ WHERE testable) AS best_gap,
 (SELECT string_agg(feature, '; ' ORDER BY f, place) FROM (SELECT feature, place, least(coalesce(failures_first, 0), coalesce(failures_second, 0)) AS f
  FROM find_$ ORDER BY f, place LIMIT 4)) AS thinnest
 FROM (SELECT count(*) AS n_breakouts, count(DISTINCT session_date) AS n_sessions, min(session_date) AS first_date, max(session_date) AS last_date,
 round_even(count(*) FILTER (label = 'BUSTED') / count(*) * 100, 1) AS busted_pct, round_even(count(*) FILTER (label = 'NEITHER') / count(*) * 100, 1) AS neither_pct,
 round_even(count(*) FILTER (label = 'SUSTAINED') / count(*) * 100, 1) AS sustained_pct FROM events_$)""")
def report_facts(fx):
    return sm.report_facts(fx.feature_stage, study.feature_findings(fx.feature_stage, fx.params))

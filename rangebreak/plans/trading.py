"""Registered queries: features, signals, trades and costs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from rangebreak.operators import features as feat
from rangebreak.operators import trades as tr
from rangebreak.operators.indicators import atr_prior_day
from rangebreak.params import ALL_FEATURES
from rangebreak.plans import catalogue
from rangebreak.plans.sql import base, trading  # noqa: F401  (registers the SQL steps)
from rangebreak.plans.sql.base import num

# These plans read bars on several branches.
query = partial(catalogue.query, stage=True)
KEYS = "symbol, session_date::VARCHAR AS session_date, direction"
TRADE_KEYS = "setup, symbol, session_date::VARCHAR AS session_date, direction"


@query("feature_table", "m", f"""SELECT {KEYS}, breakout_slot, breakout_index, breakout_time::VARCHAR AS breakout_time,
 label, {num('max_extension_atr', *trading.FEATURES)} FROM feat_$""")
def feature_table(fx):
    return fx.features


@query("feature_table_hours", "h", f"""SELECT {KEYS}, breakout_slot, breakout_index, breakout_time::VARCHAR AS breakout_time,
 label, {num('max_extension_atr', *trading.FEATURES)} FROM feat_$""")
def feature_table_hours(fx):
    return fx.features


def _one_feature(key: str, name: str) -> None:
    @query(key, "m", f"SELECT {KEYS}, {num(name)} FROM feat_$")
    def build(fx):
        events = fx.events if name == "rvol_breakout_bar" else fx.context
        wide = feat.feature_columns(events, fx.bars, fx.index_bars, fx.expiries, fx.params, only=(name,))
        return wide.select(*feat.EVENT_KEY, name)


for _key, _name in {
    "f_rvol_open": "rvol_open_15m",
    "f_rvol_breakout_bar": "rvol_breakout_bar",
    "f_bar_body_ratio": "bar_body_ratio",
    "f_rel_strength": "rel_strength_vs_index",
    "f_index_agrees": "index_or_agrees",
    "f_gap_atr": "gap_atr_signed",
    "f_breakout_depth": "breakout_depth_atr",
    "f_prior_day_return": "prior_day_return_atr_signed",
    "f_is_expiry": "is_expiry_day",
    "f_or_width": "or_width_atr",
    "f_minutes_since_open": "minutes_since_open",
    "f_day_of_week": "day_of_week",
}.items():
    _one_feature(_key, _name)


@query("orb_signals", "m", f"SELECT {TRADE_KEYS}, signal_slot, {num('atr', digits=4)}, {num('vwap', digits=4)} FROM orbsig_$", digits=4)
def orb_signals(fx):
    return tr.orb_signals(fx.context).drop("feature_direction")


@query("failed_orb_signals", "m", f"SELECT {TRADE_KEYS}, feature_direction, signal_slot, {num('atr')} FROM fobsig_$")
def failed_orb_signals(fx):
    return tr.failed_orb_signals(fx.context).drop("vwap")


@query("entry_rule", "m", f"""SELECT {TRADE_KEYS}, feature_direction, signal_slot, {num('atr', 'entry_price')}, entry_slot,
 entry_time::VARCHAR AS entry_time FROM ent_$""")
def entry_rule(fx):
    return tr.entry_rule(fx.signals, fx.bars, fx.params)


_EXIT = f"""SELECT {TRADE_KEYS}, variant, entry_slot, {num('entry_price', 'stop_price', 'exit_price', 'mfe_price')},
 exit_slot, exit_time::VARCHAR AS exit_time, exit_reason, duration_bars FROM trades_$"""
_EXIT_COLUMNS = [
    *tr.TRADE, "variant", "entry_slot", "entry_price", "stop_price", "exit_price", "mfe_price",
    "exit_slot", "exit_time", "exit_reason", "duration_bars",
]


@query("exit_base", "m", _EXIT + " WHERE variant = 'base'")
def exit_base(fx):
    return tr.exit_base(fx.signals, fx.bars, fx.params).select(*_EXIT_COLUMNS)


@query("exit_partial_1r", "m", _EXIT + " WHERE variant = 'partial_1r'")
def exit_partial_1r(fx):
    return tr.exit_partial_1r(fx.signals, fx.bars, fx.params).select(*_EXIT_COLUMNS)


@query("build_trades", "w", f"""SELECT {TRADE_KEYS}, feature_direction, signal_slot, entry_slot, entry_time::VARCHAR AS entry_time,
 {num('atr', 'entry_price', 'stop_price')}, variant, exit_slot, exit_time::VARCHAR AS exit_time, {num('exit_price')}, exit_reason,
 duration_bars, {num('mfe_price')}, stop_atr_multiple FROM trades_$""")
def build_trades(fx):
    return fx.trades.drop("vwap")


@query("setup_run_counts", "m", """SELECT n.setup, sessions_seen, sessions_without_atr, coalesce(e.n_entries, 0) AS n_entries,
 coalesce(x.n_signals, 0) - coalesce(e.n_entries, 0) AS skipped_late_entries
 FROM (VALUES ('orb'), ('failed_orb')) n(setup)
 LEFT JOIN (SELECT s.setup, count(*) AS n_signals FROM sig_$ s GROUP BY s.setup) x ON x.setup = n.setup
 LEFT JOIN (SELECT setup, count(*) AS n_entries FROM ent_$ GROUP BY setup) e ON e.setup = n.setup,
 (SELECT count(*) AS sessions_seen, count(*) FILTER (p.atr IS NULL) AS sessions_without_atr FROM facts_$ f
 LEFT JOIN prior_$ p USING (symbol, session_date)) c""")
def setup_run_counts(fx):
    sessions = atr_prior_day(fx.daily.select("symbol", "session_date"), fx.daily, fx.calendar, fx.params)
    entries = tr.entry_rule(fx.signals, fx.bars, fx.params)
    parts = [
        tr.setup_run_counts(
            sessions, fx.signals.where(F.col("setup") == s), entries.where(F.col("setup") == s)
        ).select(F.lit(s).alias("setup"), "*")
        for s in ("orb", "failed_orb")
    ]
    return parts[0].unionByName(parts[1])


_COSTS = (
    "brokerage_buy", "brokerage_sell", "stt", "exchange_buy", "exchange_sell", "stamp", "sebi_buy",
    "sebi_sell", "gst", "slippage_buy", "slippage_sell", "statutory",
)


@query("trade_costs", "m", f"""SELECT {TRADE_KEYS}, variant, slippage_bps, {num('buy_turnover', 'sell_turnover', *_COSTS, digits=4)},
 {num('cost_slippage', 'cost_total', digits=4)} FROM results_$""", digits=4)
def trade_costs(fx):
    rows = tr.evaluate_trades(fx.trades, fx.params)
    return rows.select(
        *tr.TRADE, "variant", "slippage_bps", "buy_turnover", "sell_turnover",
        *[F.col(f"costs.{c}").alias(c) for c in _COSTS],
        F.col("costs.slippage").alias("cost_slippage"), F.col("costs.total").alias("cost_total"),
    )


@catalogue.query("participation_slippage", "m", f"""SELECT symbol, session_date::VARCHAR AS session_date, slot, {num('order_value', 'bar_value', digits=4)}, 5 AS base_bps,
 round(CASE WHEN bar_value > 0 THEN 5 + 10.0::DOUBLE * sqrt(least(order_value / bar_value, 1.0::DOUBLE)) ELSE 5 END, 4) AS slippage_bps
 FROM (SELECT symbol, session_date, slot, 50000.0::DOUBLE AS order_value, close * volume AS bar_value FROM bars_$)""", digits=4)
def participation_slippage(fx):
    orders = fx.bars.select(
        "symbol", "session_date", "slot",
        F.lit(50_000.0).alias("order_value"),
        (F.col("close") * F.col("volume")).alias("bar_value"),
        F.lit(5).alias("base_bps"),
    )
    return tr.participation_slippage(orders)


_EVALUATED = f"""SELECT {TRADE_KEYS}, variant, slippage_bps, quantity, {num('risk', 'gross_pnl', 'net_pnl', digits=2)},
 {num('r_gross', 'r_net', 'mfe_r', digits=2)}, duration_bars FROM results_$"""


@query("evaluate_trades", "m", _EVALUATED, digits=2)
def evaluate_trades(fx):
    rows = tr.evaluate_trades(fx.trades, fx.params)
    return rows.select(
        *tr.TRADE, "variant", "slippage_bps", "quantity", "risk", "gross_pnl", "net_pnl", "r_gross",
        "r_net", "mfe_r", "duration_bars",
    )


@query("results_table", "m", f"""SELECT r.setup, r.variant, r.symbol, r.session_date::VARCHAR AS session_date, r.direction, r.entry_slot,
 r.entry_time::VARCHAR AS entry_time, r.exit_slot, r.exit_time::VARCHAR AS exit_time, r.exit_reason, r.slippage_bps, r.quantity, r.duration_bars,
 {num('r.entry_price', 'r.exit_price', 'r.stop_price', 'r.atr', 'r.stop_atr_multiple', 'r.risk', 'r.gross_pnl', 'r.cost_total', 'r.cost_slippage',
      'r.net_pnl', 'r.r_gross', 'r.r_net', 'r.mfe_r', *['f.' + c for c in ALL_FEATURES], digits=2)}
 FROM results_$ r LEFT JOIN feat_$ f ON f.symbol = r.symbol AND f.session_date = r.session_date AND f.direction = r.feature_direction""", digits=2)
def results_table(fx):
    return tr.results_table(tr.evaluate_trades(fx.trades, fx.params), fx.features)

"""SQL for features, signals, trades and costs."""

from __future__ import annotations

from rangebreak.plans.fixtures import PARAMS, POSITION
from rangebreak.plans.sql.compose import step

FEATURES = (
    "rvol_open_15m rvol_breakout_bar bar_body_ratio rel_strength_vs_index index_or_agrees gap_atr_signed "
    "prior_day_return_atr_signed is_expiry_day or_width_atr minutes_since_open day_of_week breakout_depth_atr"
).split()

for _g, _p in PARAMS.items():
    n = _p.opening_range_bars
    step(
        f"feat_{_g}",
        f"""SELECT e.symbol, e.session_date, e.direction, e.breakout_slot, e.breakout_index, e.breakout_time,
 e.label, e.max_extension_atr, ra.rvol_at_time AS rvol_open_15m, rb.rvol_bar AS rvol_breakout_bar,
 CASE WHEN e.b_high - e.b_low > 0 THEN abs(e.breakout_close - e.b_open) / (e.b_high - e.b_low) END AS bar_body_ratio,
 CASE WHEN io.o > 0 AND f.session_open > 0 THEN sg * ((e.breakout_close / f.session_open - 1)
  - (s.index_close / io.o - 1)) * 100 END AS rel_strength_vs_index,
 CASE WHEN e.direction = 'long' THEN s.index_up ELSE s.index_down END::DOUBLE AS index_or_agrees,
 sg * (f.session_open - f.session_open / (1 + g.gap_pct / 100)) / e.atr AS gap_atr_signed,
 sg * (e.prev_close - e.prev_open) / e.atr AS prior_day_return_atr_signed,
 CASE WHEN e.session_date BETWEEN x.a AND x.b THEN
  CASE WHEN e.session_date IN (SELECT date FROM expiries_{_g}) THEN 1.0 ELSE 0.0 END END::DOUBLE AS is_expiry_day,
 e.or_width / e.atr AS or_width_atr, e.minutes_since_open::DOUBLE AS minutes_since_open,
 (isodow(e.session_date) - 1)::DOUBLE AS day_of_week,
 abs(e.breakout_close - CASE WHEN e.direction = 'long' THEN e.or_high ELSE e.or_low END) / e.atr AS breakout_depth_atr
 FROM (SELECT *, CASE WHEN direction = 'long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM events_{_g}) e
 JOIN facts_{_g} f USING (symbol, session_date)
 LEFT JOIN rvolat_{_g} ra ON ra.symbol = e.symbol AND ra.session_date = e.session_date AND ra.slot = {n - 1}
 LEFT JOIN rvolbar_{_g} rb ON rb.symbol = e.symbol AND rb.session_date = e.session_date AND rb.slot = e.breakout_slot
 LEFT JOIN gap_{_g} g ON g.symbol = e.symbol AND g.session_date = e.session_date
 LEFT JOIN istate_{_g} s ON s.session_date = e.session_date AND s.slot = e.breakout_slot
 LEFT JOIN (SELECT session_date, arg_min(open, slot) AS o FROM idx_{_g} GROUP BY session_date) io
  ON io.session_date = e.session_date, (SELECT min(date) AS a, max(date) AS b FROM expiries_{_g}) x""",
    )
    step(
        f"vwap_{_g}",
        f"""SELECT symbol, session_date, slot, CASE WHEN sum(volume) OVER w > 0 THEN
 sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w END AS vwap FROM bars_{_g}
 WINDOW w AS (PARTITION BY symbol, session_date ORDER BY slot)""",
    )
    step(
        f"orbsig_{_g}",
        f"""SELECT 'orb' AS setup, e.symbol, e.session_date, e.direction, e.direction AS feature_direction,
 e.breakout_slot AS signal_slot, e.atr, v.vwap FROM events_{_g} e JOIN vwap_{_g} v ON v.symbol = e.symbol
 AND v.session_date = e.session_date AND v.slot = e.breakout_slot
 WHERE CASE WHEN e.direction = 'long' THEN e.breakout_close > v.vwap ELSE e.breakout_close < v.vwap END""",
    )
    step(
        f"fobsig_{_g}",
        f"""SELECT 'failed_orb' AS setup, symbol, session_date,
 CASE WHEN direction = 'long' THEN 'short' ELSE 'long' END AS direction, direction AS feature_direction,
 resolved_slot AS signal_slot, atr, NULL::DOUBLE AS vwap FROM events_{_g} WHERE label = 'BUSTED'""",
    )
    step(
        f"sig_{_g}",
        f"SELECT * FROM orbsig_{_g} UNION ALL SELECT * FROM fobsig_{_g}",
    )
    step(
        f"ent_{_g}",
        f"""SELECT s.*, b.slot AS entry_slot, b.ts AS entry_time, b.open AS entry_price,
 CASE WHEN s.direction = 'long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg,
 b.open - CASE WHEN s.direction = 'long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * {_p.stop_atr}::DOUBLE * s.atr AS stop_price
 FROM sig_{_g} s JOIN bars_{_g} b ON b.symbol = s.symbol AND b.session_date = s.session_date
 AND b.slot = (SELECT min(q.slot) FROM bars_{_g} q WHERE q.symbol = s.symbol AND q.session_date = s.session_date
  AND q.slot > s.signal_slot) WHERE b.slot <= {_p.last_entry_slot}""",
    )
    # The exit walk, bar by bar: a recursive state machine over each trade's later bars.
    step(
        f"path_{_g}",
        f"""SELECT e.setup, e.symbol, e.session_date, e.direction, e.sg, e.entry_price, e.stop_price,
 row_number() OVER (PARTITION BY e.setup, e.symbol, e.session_date, e.direction ORDER BY b.slot) - 1 AS k,
 count(*) OVER (PARTITION BY e.setup, e.symbol, e.session_date, e.direction) - 1 AS last_k,
 b.slot, b.ts, b.open, b.close, CASE WHEN e.sg > 0 THEN b.high ELSE b.low END AS best,
 CASE WHEN e.sg > 0 THEN b.low ELSE b.high END AS worst,
 e.entry_price + e.sg * (e.sg * (e.entry_price - e.stop_price)) AS target
 FROM ent_{_g} e JOIN bars_{_g} b ON b.symbol = e.symbol AND b.session_date = e.session_date AND b.slot >= e.entry_slot""",
    )
    step(
        f"walked_{_g}",
        f"""SELECT setup, symbol, session_date, direction, v.variant, any_value(entry_price) AS entry_price,
 list_reduce(list({{'k': k, 'slot': slot, 'ts': ts, 'px': NULL::DOUBLE, 'done': 0, 'half': false,
   'stop': stop_price, 'mfe': entry_price, 'o': open, 'c': close, 'b': best, 'w': worst, 'sg': sg,
   'e': entry_price, 't': target, 'var': v.variant, 'last': last_k}} ORDER BY k),
  lambda a, x: CASE WHEN a.done > 0 THEN a
   WHEN x.sg * (x.w - a.stop) <= 0 THEN {{'k': x.k, 'slot': x.slot, 'ts': x.ts,
    'px': CASE WHEN a.half THEN 0.5::DOUBLE * x.t + 0.5::DOUBLE * CASE WHEN x.sg * (x.o - a.stop) <= 0 THEN x.o ELSE a.stop END
     ELSE CASE WHEN x.sg * (x.o - a.stop) <= 0 THEN x.o ELSE a.stop END END,
    'done': 1, 'half': a.half, 'stop': a.stop, 'mfe': x.sg * greatest(x.sg * a.mfe, x.sg * x.b),
    'o': x.o, 'c': x.c, 'b': x.b, 'w': x.w, 'sg': x.sg, 'e': x.e, 't': x.t, 'var': x.var, 'last': x.last}}
   ELSE {{'k': x.k, 'slot': x.slot, 'ts': x.ts,
    'px': CASE WHEN a.half OR (x.var = 'partial_1r' AND x.sg * (x.b - x.t) >= 0)
     THEN 0.5::DOUBLE * x.t + 0.5::DOUBLE * x.c ELSE x.c END,
    'done': 0, 'half': a.half OR (x.var = 'partial_1r' AND x.sg * (x.b - x.t) >= 0),
    'stop': CASE WHEN NOT a.half AND x.var = 'partial_1r' AND x.sg * (x.b - x.t) >= 0 THEN x.e ELSE a.stop END,
    'mfe': x.sg * greatest(x.sg * a.mfe, x.sg * x.b),
    'o': x.o, 'c': x.c, 'b': x.b, 'w': x.w, 'sg': x.sg, 'e': x.e, 't': x.t, 'var': x.var, 'last': x.last}} END,
  {{'k': -1::BIGINT, 'slot': -1::BIGINT, 'ts': NULL::TIMESTAMP, 'px': NULL::DOUBLE, 'done': 0, 'half': false,
   'stop': any_value(stop_price), 'mfe': any_value(entry_price), 'o': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'b': 0.0::DOUBLE,
   'w': 0.0::DOUBLE, 'sg': any_value(sg), 'e': any_value(entry_price), 't': 0.0::DOUBLE, 'var': v.variant, 'last': 0::BIGINT}}) AS st
 FROM path_{_g}, (VALUES ('base'), ('partial_1r')) v(variant)
 GROUP BY setup, symbol, session_date, direction, v.variant""",
    )
    step(
        f"trades_{_g}",
        f"""SELECT e.setup, e.symbol, e.session_date, e.direction, e.feature_direction, e.signal_slot, e.atr,
 e.entry_slot, e.entry_time, e.entry_price, e.stop_price, w.variant, w.st.slot AS exit_slot, w.st.ts AS exit_time,
 w.st.px AS exit_price, CASE WHEN w.st.done = 1 THEN 'stop' WHEN w.st.half THEN 'target' ELSE 'eod' END AS exit_reason,
 w.st.k AS duration_bars, w.st.mfe AS mfe_price, {_p.stop_atr}::DOUBLE AS stop_atr_multiple, e.sg
 FROM ent_{_g} e JOIN walked_{_g} w ON w.setup = e.setup AND w.symbol = e.symbol AND w.session_date = e.session_date
 AND w.direction = e.direction""",
    )


def evaluated(source: str, levels: str = "(VALUES (5), (10), (20)) z(slippage_bps)") -> str:
    """P&L, costs and R multiples of the trades in ``source`` at each slippage level."""
    return f"""SELECT *, gross_pnl / risk AS r_gross, net_pnl / risk AS r_net,
  sg * (mfe_price - entry_price) * quantity / risk AS mfe_r FROM (
 SELECT *, gross_pnl - cost_total AS net_pnl FROM (
 SELECT *, brokerage_buy + brokerage_sell + stt + exchange_buy + exchange_sell + stamp + sebi_buy + sebi_sell + gst AS statutory,
  slippage_buy + slippage_sell AS cost_slippage, brokerage_buy + brokerage_sell + stt + exchange_buy + exchange_sell
  + stamp + sebi_buy + sebi_sell + gst + (slippage_buy + slippage_sell) AS cost_total FROM (
 SELECT *, least(20.0::DOUBLE, 0.0003::DOUBLE * buy_turnover) AS brokerage_buy, least(20.0::DOUBLE, 0.0003::DOUBLE * sell_turnover) AS brokerage_sell,
  0.00025::DOUBLE * sell_turnover AS stt, 0.0000297::DOUBLE * buy_turnover AS exchange_buy,
  0.0000297::DOUBLE * sell_turnover AS exchange_sell, 0.00003::DOUBLE * buy_turnover AS stamp,
  0.000001::DOUBLE * buy_turnover AS sebi_buy, 0.000001::DOUBLE * sell_turnover AS sebi_sell,
  0.18::DOUBLE * (least(20.0::DOUBLE, 0.0003::DOUBLE * buy_turnover) + least(20.0::DOUBLE, 0.0003::DOUBLE * sell_turnover)
   + 0.0000297::DOUBLE * buy_turnover + 0.0000297::DOUBLE * sell_turnover + 0.000001::DOUBLE * (buy_turnover + sell_turnover)) AS gst,
  slippage_bps / 10000.0::DOUBLE * buy_turnover AS slippage_buy, slippage_bps / 10000.0::DOUBLE * sell_turnover AS slippage_sell FROM (
 SELECT *, quantity * (sg * (entry_price - stop_price)) AS risk, sg * (exit_price - entry_price) * quantity AS gross_pnl,
  quantity * CASE WHEN sg > 0 THEN entry_price ELSE exit_price END AS buy_turnover,
  quantity * CASE WHEN sg > 0 THEN exit_price ELSE entry_price END AS sell_turnover FROM (
 SELECT *, floor({POSITION}::DOUBLE / entry_price) AS quantity FROM {source}, {levels})))))"""


for _g in PARAMS:
    step(f"results_{_g}", evaluated(f"trades_{_g}"))

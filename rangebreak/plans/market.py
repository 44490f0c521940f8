"""Registered queries: calendars, indicators and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangebreak.operators import calendar as cal
from rangebreak.operators import indicators as ind
from rangebreak.operators import labelling as lab
from rangebreak.plans.catalogue import query
from rangebreak.plans.sql import base  # noqa: F401  (registers the SQL steps)
from rangebreak.plans.sql.base import num

BOUNDS = "(SELECT min(session_date) AS a, max(session_date) AS b FROM dates_$)"
YEARS = "(SELECT min(year(date)) AS y0, max(year(date)) AS y1 FROM holidays_$)"
_TRADING = f"""SELECT r.session_date, isodow(r.session_date) < 6 AND h.date IS NULL AS is_trading_day, h.name AS holiday_name
 FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS session_date FROM {BOUNDS}) r
 LEFT JOIN holidays_$ h ON h.date = r.session_date"""


def bounds(fx):
    return fx.dates.agg(F.min("session_date").alias("start"), F.max("session_date").alias("end"))


@query("is_trading_day", "m", f"""SELECT d.session_date::VARCHAR AS session_date,
 CASE WHEN year(d.session_date) BETWEEN y.y0 AND y.y1 THEN isodow(d.session_date) < 6 AND h.date IS NULL END AS is_trading_day,
 CASE WHEN year(d.session_date) BETWEEN y.y0 AND y.y1 THEN h.name END AS holiday_name
 FROM dates_$ d LEFT JOIN holidays_$ h ON h.date = d.session_date, {YEARS} y""")
def is_trading_day(fx):
    return cal.trading_days(fx.dates, fx.holidays)


@query("sessions_between", "m", f"SELECT session_date::VARCHAR AS session_date FROM ({_TRADING}) WHERE is_trading_day")
def sessions_between(fx):
    return cal.sessions_between(bounds(fx), fx.holidays)


@query("previous_trading_day", "m", f"""SELECT t.session_date::VARCHAR AS session_date, t.is_trading_day,
 (SELECT max(q.session_date) FROM ({_TRADING}) q WHERE q.is_trading_day AND q.session_date < t.session_date)::VARCHAR
 AS prev_trading_day FROM ({_TRADING}) t""")
def previous_trading_day(fx):
    return cal.calendar_table(bounds(fx), fx.holidays)


@query("is_expiry_day", "h", """SELECT d.session_date::VARCHAR AS session_date,
 CASE WHEN d.session_date BETWEEN x.a AND x.b THEN d.session_date IN (SELECT date FROM expiries_$) END AS is_expiry
 FROM dates_$ d, (SELECT min(date) AS a, max(date) AS b FROM expiries_$) x""")
def is_expiry_day(fx):
    return cal.is_expiry_day(fx.dates, fx.expiries)


@query("slot_grid", "h", """SELECT session_date::VARCHAR AS session_date, slot, printf('%02d:00', slot) AS slot_time
 FROM dates_$, (SELECT unnest(range(24)) AS slot)""")
def slot_grid(fx):
    return cal.slot_grid(fx.dates, fx.params)


@query("sessionize", "m", """SELECT symbol, session_date::VARCHAR AS session_date, slot, pos, n_bars,
 bar_index - pos AS session_start, bar_index FROM hist_$""")
def sessionize(fx):
    return cal.sessionize(fx.bars).select(
        "symbol", "session_date", "slot", "pos", "n_bars", "session_start", "bar_index"
    )


@query("time_buckets", "h", """SELECT symbol, session_date::VARCHAR AS session_date, slot, slot * 60 AS minutes_since_open,
 isodow(session_date) - 1 AS day_of_week, printf('%02d:00', slot) AS half_hour,
 strftime(session_date, '%Y-%m') AS month FROM bars_$""")
def time_buckets(fx):
    return cal.time_buckets(fx.bars.select("symbol", "session_date", "slot"), fx.params)


@query("session_vwap", "m", """SELECT symbol, session_date::VARCHAR AS session_date, slot, round(CASE WHEN v > 0 THEN pv / v END, 4) AS vwap
 FROM (SELECT *, sum((high + low + close) / 3 * volume) OVER w AS pv, sum(volume) OVER w AS v FROM bars_$
 WINDOW w AS (PARTITION BY symbol, session_date ORDER BY slot))""", digits=4)
def session_vwap(fx):
    return ind.session_vwap(fx.bars).select("symbol", "session_date", "slot", "vwap")


@query("session_sigma", "m", """SELECT symbol, session_date::VARCHAR AS session_date, slot,
 round(CASE WHEN n >= 3 THEN stddev_samp(r) OVER w END, 6) AS sigma FROM (SELECT symbol, session_date, slot,
 row_number() OVER v AS n, close / lag(close) OVER v - 1 AS r FROM bars_$
 WINDOW v AS (PARTITION BY symbol, session_date ORDER BY slot))
 WINDOW w AS (PARTITION BY symbol, session_date ORDER BY slot)""")
def session_sigma(fx):
    return ind.session_sigma(fx.bars).select("symbol", "session_date", "slot", "sigma")


@query("opening_range", "m", f"""SELECT symbol, session_date::VARCHAR AS session_date, or_valid,
 CASE WHEN or_valid THEN round(or_high, 6) END AS or_high, CASE WHEN or_valid THEN round(or_low, 6) END AS or_low,
 CASE WHEN or_valid THEN round(or_high - or_low, 6) END AS or_width FROM facts_$""")
def opening_range(fx):
    return ind.opening_range(fx.bars, fx.params)


@query("rvol_at_time", "m", f"SELECT symbol, session_date::VARCHAR AS session_date, slot, {num('rvol_at_time')} FROM rvolat_$")
def rvol_at_time(fx):
    return ind.rvol_at_time(fx.bars, fx.params)


@query("rvol_bar", "m", f"SELECT symbol, session_date::VARCHAR AS session_date, slot, {num('rvol_bar')} FROM rvolbar_$")
def rvol_bar(fx):
    return ind.rvol_bar(fx.bars, fx.params)


@query("gap_pct", "m", f"SELECT symbol, session_date::VARCHAR AS session_date, {num('gap_pct')} FROM gap_$")
def gap_pct(fx):
    return ind.gap_pct(fx.bars, fx.calendar, fx.params)


@query("true_range", "m", f"SELECT symbol, session_date::VARCHAR AS session_date, k, {num('true_range')} FROM tr_$")
def true_range(fx):
    return ind.true_range(fx.daily).select("symbol", "session_date", "k", "true_range")


@query("atr_wilder", "w", f"SELECT symbol, session_date::VARCHAR AS session_date, {num('atr')} FROM atr_$")
def atr_wilder(fx):
    return ind.atr_wilder(fx.daily, fx.params).select("symbol", "session_date", "atr")


@query("atr_prior_day", "m", f"""SELECT f.symbol, f.session_date::VARCHAR AS session_date,
 {num('p.atr', 'p.prev_open', 'p.prev_close')} FROM facts_$ f LEFT JOIN prior_$ p USING (symbol, session_date)""")
def atr_prior_day(fx):
    sessions = fx.daily.select("symbol", "session_date")
    return ind.atr_prior_day(sessions, fx.daily, fx.calendar, fx.params).drop("prev_trading_day")


@query("index_bar_at", "h", f"""SELECT b.symbol, b.session_date::VARCHAR AS session_date, b.slot, {num('b.close')},
 round(i.close, 6) AS index_close FROM bars_$ b LEFT JOIN idx_$ i USING (session_date, slot)""")
def index_bar_at(fx):
    bars = fx.bars.select("symbol", "session_date", "slot", "close")
    return ind.index_bar_at(bars, fx.index_bars)


@query("index_session_open", "m", """SELECT session_date::VARCHAR AS session_date, round(arg_min(open, slot), 6) AS index_open
 FROM idx_$ GROUP BY session_date""")
def index_session_open(fx):
    return ind.index_session_open(fx.index_bars)


@query("index_breakout_state", "m", """SELECT b.symbol, b.session_date::VARCHAR AS session_date, b.slot,
 s.index_up::DOUBLE AS index_up, s.index_down::DOUBLE AS index_down FROM bars_$ b LEFT JOIN istate_$ s USING (session_date, slot)""")
def index_breakout_state(fx):
    bars = fx.bars.select("symbol", "session_date", "slot")
    return ind.index_breakout_state(bars, fx.index_bars, fx.params)


@query("detect_breakouts", "m", f"""SELECT symbol, session_date::VARCHAR AS session_date, direction, breakout_slot,
 {num('or_high', 'or_low')} FROM brk_$""")
def detect_breakouts(fx):
    return lab.detect_breakouts(fx.bars, fx.params)


@query("resolve_breakouts", "m", f"""SELECT symbol, session_date::VARCHAR AS session_date, direction, breakout_slot, label,
 resolved_slot, {num('max_extension_atr')} FROM events_$""", stage=True)
def resolve_breakouts(fx):
    detected = lab.detect_breakouts(fx.bars, fx.params)
    prior = ind.atr_prior_day(detected, fx.daily, fx.calendar, fx.params).where("atr is not null")
    return lab.resolve_breakouts(prior, fx.bars, fx.params)


EVENT_SQL = f"""SELECT symbol, session_date::VARCHAR AS session_date, direction, breakout_slot, breakout_index,
 breakout_time::VARCHAR AS breakout_time, minutes_since_open, {num('or_high', 'or_low', 'or_width', 'breakout_close', 'atr')},
 label, resolved_slot, {num('max_extension_atr')} FROM events_$"""


@query("label_sessions", "m", EVENT_SQL, stage=True)
def label_sessions(fx):
    return lab.label_sessions(fx.all_bars, fx.daily, fx.calendar, fx.params)


@query("label_sessions_by_supplier", "s", EVENT_SQL, stage=True)
def label_sessions_by_supplier(fx):
    return lab.label_sessions(fx.bars, fx.daily, fx.calendar, fx.params)


@query("skipped_sessions", "m", """SELECT f.symbol, count(*) AS skipped_sessions FROM facts_$ f
 LEFT JOIN prior_$ p USING (symbol, session_date) WHERE p.atr IS NULL GROUP BY f.symbol""")
def skipped_sessions(fx):
    return lab.skipped_sessions(fx.all_bars, fx.daily, fx.calendar, fx.params)


RATES_SQL = """SELECT coalesce(month, 'all') AS month, busted, neither, sustained, n,
 round_even(busted / n * 100, 1) AS busted_pct, round_even(neither / n * 100, 1) AS neither_pct,
 round_even(sustained / n * 100, 1) AS sustained_pct FROM (SELECT strftime(session_date, '%Y-%m') AS month,
 count(*) FILTER (label = 'BUSTED') AS busted, count(*) FILTER (label = 'NEITHER') AS neither,
 count(*) FILTER (label = 'SUSTAINED') AS sustained, count(*) AS n FROM events_$
 GROUP BY GROUPING SETS ((strftime(session_date, '%Y-%m')), ())) WHERE n > 0"""


@query("base_rates", "m", RATES_SQL, stage=True)
def base_rates(fx):
    return lab.base_rates(lab.label_sessions(fx.bars, fx.daily, fx.calendar, fx.params))


@query("base_rates_by_supplier", "s", RATES_SQL, stage=True)
def base_rates_by_supplier(fx):
    return lab.base_rates(lab.label_sessions(fx.bars, fx.daily, fx.calendar, fx.params))

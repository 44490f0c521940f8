"""SQL for bars, calendars, indicators and labels."""

from __future__ import annotations

from rangebreak.plans.fixtures import PARAMS
from rangebreak.plans.sql.compose import step

_SEQ = """(l_orderkey * 8 + l_linenumber) * 1048576
 + (l_partkey * 7919 + l_suppkey * 104729 + floor(l_extendedprice * 100 + 0.5)::BIGINT) % 1048576"""

for _g, _symbol, _date, _slot in (
    ("m", "l_returnflag || l_linestatus", "date_trunc('month', l_shipdate)::DATE", "day(l_shipdate) - 1"),
    ("w", "l_returnflag || l_linestatus", "date_trunc('week', l_shipdate)::DATE", "isodow(l_shipdate) - 1"),
    ("s", "l_suppkey::VARCHAR", "date_trunc('month', l_shipdate)::DATE", "day(l_shipdate) - 1"),
):
    step(
        f"ticks_{_g}",
        f"""SELECT {_symbol} AS symbol, {_date} AS session_date, {_slot} AS slot, l_shipdate AS ts,
 l_extendedprice / l_quantity AS price, l_quantity AS quantity, {_SEQ} AS seq FROM lineitem""",
    )
step(
    "ticks_h",
    """SELECT event_type AS symbol, ts::DATE AS session_date, hour(ts) AS slot, ts, value AS price,
 1 AS quantity, event_id AS seq FROM events""",
)

for _g, _p in PARAMS.items():
    n, last, L, per = _p.opening_range_bars, _p.slots_per_session, _p.rvol_lookback, _p.atr_period
    back = {"m": "INTERVAL 1 MONTH", "s": "INTERVAL 1 MONTH", "w": "INTERVAL 7 DAY", "h": "INTERVAL 1 DAY"}[_g]
    step(
        f"bars_{_g}",
        f"""SELECT symbol, session_date, slot, min(ts) AS ts, arg_min(price, seq) AS open,
 max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(quantity)::BIGINT AS volume
 FROM ticks_{_g} GROUP BY symbol, session_date, slot""",
    )
    step(
        f"idx_{_g}",
        f"""SELECT 'INDEX' AS symbol, session_date, slot, min(ts) AS ts, arg_min(price, seq) AS open,
 max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, 0::BIGINT AS volume
 FROM ticks_{_g} GROUP BY session_date, slot""",
    )
    step(
        f"daily_{_g}",
        f"""SELECT symbol, session_date, arg_min(open, slot) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, slot) AS close, sum(volume)::BIGINT AS volume FROM bars_{_g} GROUP BY symbol, session_date""",
    )
    step(
        f"tr_{_g}",
        f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS k,
 CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY session_date) IS NOT NULL THEN greatest(high - low,
  abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY session_date)),
  abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY session_date))) END AS true_range
 FROM daily_{_g}""",
    )
    # Wilder's recursion as such: a fold over the true ranges of each symbol.
    step(
        f"atr_{_g}",
        f"""SELECT t.symbol, t.session_date, t.open, t.high, t.low, t.close, t.volume,
 CASE WHEN t.k = {per} THEN list_avg(trs[1:{per}])
  WHEN t.k > {per} THEN list_reduce(trs[{per + 1}:t.k], lambda v, x: (v * {per - 1}.0::DOUBLE + x) / {per}.0::DOUBLE,
   list_avg(trs[1:{per}])) END AS atr
 FROM tr_{_g} t JOIN (SELECT symbol, list(true_range ORDER BY k) FILTER (k >= 1) AS trs
  FROM tr_{_g} GROUP BY symbol) h USING (symbol)""",
    )
    step(
        f"prior_{_g}",
        f"""SELECT symbol, (session_date + {back})::DATE AS session_date, atr, open AS prev_open,
 close AS prev_close, session_date AS prev_trading_day FROM atr_{_g}""",
    )
    step(
        f"facts_{_g}",
        f"""SELECT symbol, session_date, count(*) AS n_bars, arg_min(open, slot) AS session_open,
 arg_max(close, slot) AS session_close, count(*) FILTER (slot < {n}) AS or_bars,
 count(*) FILTER (slot < {n}) = {n} AS or_valid,
 max(high) FILTER (slot < {n}) AS or_high, min(low) FILTER (slot < {n}) AS or_low,
 coalesce(sum(volume) FILTER (slot < {n}), 0) AS or_volume FROM bars_{_g} GROUP BY symbol, session_date""",
    )
    step(
        f"ord_{_g}",
        f"""SELECT symbol, session_date, row_number() OVER (PARTITION BY symbol ORDER BY session_date)
 AS session_ordinal FROM (SELECT DISTINCT symbol, session_date FROM bars_{_g})""",
    )
    # Relative volume as a plain self-join against the previous sessions.
    step(
        f"rvolat_{_g}",
        f"""SELECT b.symbol, b.session_date, b.slot, CASE WHEN o.session_ordinal > {L} THEN
  CASE WHEN base.v > 0 THEN cum.v / (base.v / {L}) END END AS rvol_at_time
 FROM bars_{_g} b JOIN ord_{_g} o USING (symbol, session_date),
 LATERAL (SELECT sum(x.volume)::DOUBLE AS v FROM bars_{_g} x WHERE x.symbol = b.symbol
  AND x.session_date = b.session_date AND x.slot <= b.slot) cum,
 LATERAL (SELECT coalesce(sum(x.volume), 0)::DOUBLE AS v FROM bars_{_g} x JOIN ord_{_g} q USING (symbol, session_date)
  WHERE x.symbol = b.symbol AND x.slot <= b.slot AND q.session_ordinal >= o.session_ordinal - {L}
   AND q.session_ordinal < o.session_ordinal) base""",
    )
    step(
        f"rvolbar_{_g}",
        f"""SELECT b.symbol, b.session_date, b.slot, CASE WHEN o.session_ordinal > {L} THEN
  CASE WHEN base.v > 0 THEN b.volume / (base.v / {L}) END END AS rvol_bar
 FROM bars_{_g} b JOIN ord_{_g} o USING (symbol, session_date),
 LATERAL (SELECT coalesce(sum(x.volume), 0)::DOUBLE AS v FROM bars_{_g} x JOIN ord_{_g} q USING (symbol, session_date)
  WHERE x.symbol = b.symbol AND x.slot = b.slot AND q.session_ordinal >= o.session_ordinal - {L}
   AND q.session_ordinal < o.session_ordinal) base""",
    )
    step(
        f"gap_{_g}",
        f"""SELECT symbol, session_date, CASE WHEN (pd + {back})::DATE = session_date
  THEN (session_open - pc) / pc * 100 END AS gap_pct
 FROM (SELECT *, lag(session_date) OVER w AS pd, lag(session_close) OVER w AS pc FROM facts_{_g}
  WINDOW w AS (PARTITION BY symbol ORDER BY session_date))""",
    )
    step(
        f"brk_{_g}",
        f"""SELECT f.symbol, f.session_date, d.direction, f.or_high, f.or_low, min(b.slot) AS breakout_slot
 FROM facts_{_g} f, (VALUES ('long'), ('short')) d(direction), bars_{_g} b
 WHERE f.or_valid AND b.symbol = f.symbol AND b.session_date = f.session_date AND b.slot >= {n}
  AND ((d.direction = 'long' AND b.close > f.or_high) OR (d.direction = 'short' AND b.close < f.or_low))
 GROUP BY ALL""",
    )
    step(
        f"walk_{_g}",
        f"""SELECT k.symbol, k.session_date, k.direction, k.breakout_slot, k.or_high, k.or_low, p.atr,
 p.prev_open, p.prev_close, b.slot, b.close,
 max(greatest(CASE WHEN k.direction = 'long' THEN b.high - k.or_high ELSE k.or_low - b.low END, 0.0))
  OVER (PARTITION BY k.symbol, k.session_date, k.direction ORDER BY b.slot) AS ext
 FROM brk_{_g} k JOIN prior_{_g} p ON p.symbol = k.symbol AND p.session_date = k.session_date AND p.atr IS NOT NULL
 JOIN bars_{_g} b ON b.symbol = k.symbol AND b.session_date = k.session_date AND b.slot >= k.breakout_slot""",
    )
    step(
        f"settled_{_g}",
        f"""SELECT symbol, session_date, direction, breakout_slot, or_high, or_low, atr, prev_open, prev_close,
 min(slot) FILTER (ext >= {_p.sustain_atr} * atr) AS s_slot,
 min(slot) FILTER (slot < {_p.bust_cutoff_slot} AND ext < {_p.bust_atr} * atr AND
  CASE WHEN direction = 'long' THEN close < or_low ELSE close > or_high END) AS b_slot,
 max(ext) / atr AS max_extension_atr FROM walk_{_g}
 GROUP BY symbol, session_date, direction, breakout_slot, or_high, or_low, atr, prev_open, prev_close""",
    )
    step(
        f"hist_{_g}",
        f"""SELECT symbol, session_date, slot, row_number() OVER (PARTITION BY symbol ORDER BY session_date, slot) - 1
 AS bar_index, row_number() OVER (PARTITION BY symbol, session_date ORDER BY slot) - 1 AS pos,
 count(*) OVER (PARTITION BY symbol, session_date) AS n_bars FROM bars_{_g}""",
    )
    step(
        f"events_{_g}",
        f"""SELECT s.symbol, s.session_date, s.direction, s.breakout_slot, h.bar_index AS breakout_index,
 b.ts AS breakout_time, s.breakout_slot * {_p.slot_minutes} AS minutes_since_open, s.or_high, s.or_low,
 s.or_high - s.or_low AS or_width, b.close AS breakout_close, s.atr,
 CASE WHEN s_slot IS NOT NULL AND (b_slot IS NULL OR s_slot <= b_slot) THEN 'SUSTAINED'
  WHEN b_slot IS NOT NULL THEN 'BUSTED' ELSE 'NEITHER' END AS label,
 CASE WHEN s_slot IS NOT NULL AND (b_slot IS NULL OR s_slot <= b_slot) THEN s_slot ELSE b_slot END AS resolved_slot,
 s.max_extension_atr, s.prev_open, s.prev_close, b.open AS b_open, b.high AS b_high, b.low AS b_low
 FROM settled_{_g} s JOIN bars_{_g} b ON b.symbol = s.symbol AND b.session_date = s.session_date
  AND b.slot = s.breakout_slot
 JOIN hist_{_g} h ON h.symbol = s.symbol AND h.session_date = s.session_date AND h.slot = s.breakout_slot""",
    )
    step(
        f"dates_{_g}",
        "SELECT DISTINCT ts::DATE AS session_date FROM events"
        if _g == "h"
        else "SELECT DISTINCT l_shipdate::DATE AS session_date FROM lineitem",
    )
    step(
        f"holidays_{_g}",
        f"""SELECT session_date AS date, 'holiday ' || dayofyear(session_date) AS name FROM dates_{_g}
 WHERE dayofyear(session_date) % 29 = 0""",
    )
    step(
        f"expiries_{_g}",
        f"""SELECT DISTINCT session_date AS date FROM bars_{_g}
 WHERE {"month(session_date) % 3 = 0" if _g in "ms" else "dayofyear(session_date) % 4 = 0"}""",
    )
    step(
        f"istate_{_g}",
        f"""SELECT g.session_date, g.slot,
 (SELECT i.close FROM idx_{_g} i WHERE i.session_date = g.session_date AND i.slot = g.slot) AS index_close,
 CASE WHEN r.c = {n} AND g.slot >= {n - 1} THEN (SELECT coalesce(max(CASE WHEN i.close > r.h THEN 1.0 ELSE 0.0 END), 0.0)
  FROM idx_{_g} i WHERE i.session_date = g.session_date AND i.slot >= {n} AND i.slot <= g.slot) END AS index_up,
 CASE WHEN r.c = {n} AND g.slot >= {n - 1} THEN (SELECT coalesce(max(CASE WHEN i.close < r.l THEN 1.0 ELSE 0.0 END), 0.0)
  FROM idx_{_g} i WHERE i.session_date = g.session_date AND i.slot >= {n} AND i.slot <= g.slot) END AS index_down
 FROM (SELECT d.session_date, s.slot FROM (SELECT DISTINCT session_date FROM idx_{_g}) d,
  (SELECT unnest(range({last})) AS slot) s) g
 JOIN (SELECT session_date, count(*) FILTER (slot < {n}) AS c, max(high) FILTER (slot < {n}) AS h,
  min(low) FILTER (slot < {n}) AS l FROM idx_{_g} GROUP BY session_date) r USING (session_date)""",
    )


def num(*names: str, digits: int = 6) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n.split('.')[-1]}" for n in names)

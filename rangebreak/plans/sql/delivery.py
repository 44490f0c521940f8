"""SQL for delivered bars, their verdicts, the store and the daily universe."""

from __future__ import annotations

from rangebreak.plans.fixtures import MONTHS
from rangebreak.plans.sql.compose import step

TRADING = """SELECT r.session_date, isodow(r.session_date) < 6 AND h.date IS NULL AS is_trading_day
 FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS session_date FROM
  (SELECT min(session_date) AS a, max(session_date) AS b FROM dates_{g})) r LEFT JOIN holidays_{g} h ON h.date = r.session_date"""

step("caldays_h", TRADING.format(g="h"))
step("caldays_m", TRADING.format(g="m"))
step(
    "raw_h",
    """SELECT f.* EXCLUDE (place, rep), place + c.copy AS ingest_seq,
 (SELECT max(session_date) FROM dates_h)::TIMESTAMP + INTERVAL 18 HOUR AS fetched_at FROM (
 SELECT symbol, session_date, CASE WHEN sid % 11 = 3 AND slot = 12 THEN st + INTERVAL 30 MINUTE
  WHEN sid % 13 = 4 AND slot = 23 THEN st + INTERVAL 1 HOUR ELSE st END AS ts, open,
  CASE WHEN fs % 97 = 1 THEN low ELSE high END AS high, CASE WHEN fs % 97 = 1 THEN high ELSE low END AS low,
  CASE WHEN fs % 79 <> 4 THEN close END AS close,
  CASE WHEN fs % 89 = 2 THEN -volume WHEN sid % 5 = 2 AND slot % 3 <> 0 THEN 0 ELSE volume END AS volume,
  CASE WHEN sid % 17 = 5 AND slot = 5 THEN 900 ELSE slot * 10 END AS place, fs % 83 = 3 AS rep
 FROM (SELECT b.*, q.fs, min(q.fs) OVER (PARTITION BY b.symbol, b.session_date) AS sid, b.session_date::TIMESTAMP + to_hours(slot) AS st
  FROM bars_h b JOIN (SELECT symbol, session_date, slot, min(seq) AS fs FROM ticks_h GROUP BY ALL) q USING (symbol, session_date, slot))
 WHERE NOT (sid % 7 = 0 AND slot >= 22) AND NOT (sid % 7 = 1 AND slot = 10)) f, (VALUES (0), (1)) c(copy) WHERE c.copy = 0 OR f.rep""",
)
step(
    "kept_h",
    """SELECT *, CASE WHEN minute(ts) = 0 THEN hour(ts) END AS gs FROM (SELECT *, CASE WHEN session_date = fetched_at::DATE
 THEN least(2, count(*) OVER (PARTITION BY symbol, session_date)) ELSE 0 END AS dropped,
 row_number() OVER (PARTITION BY symbol, session_date ORDER BY ts DESC, ingest_seq DESC) AS e FROM raw_h) WHERE e > dropped""",
)
step(
    "chk_h",
    """SELECT k.*, c.is_trading_day, CASE WHEN len(missing) > 0 THEN dropped = 0 AND len(missing) <= 2 AND missing[1] = 24 - len(missing) END AS tail
 FROM (SELECT symbol, session_date, count(*) AS n, max(dropped) AS dropped, count(*) FILTER (bk) AS backward, count(*) FILTER (rp) AS repeated,
 count(*) FILTER (ts::DATE <> session_date) AS wrong_date, count(*) FILTER (gs IS NULL) AS off_grid,
 count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS nulls,
 count(*) FILTER (least(open, high, low, close) <= 0) AS nonpos, count(*) FILTER (low > least(open, close)) AS lowabove,
 count(*) FILTER (high < greatest(open, close)) AS highbelow, count(*) FILTER (volume < 0) AS negvol, count(*) FILTER (volume = 0) AS zerovol,
 list_filter(range(24), lambda x: NOT list_contains(list(gs) FILTER (gs IS NOT NULL), x)) AS missing
 FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol, session_date ORDER BY ingest_seq) > ts AS bk,
  lag(ts) OVER (PARTITION BY symbol, session_date ORDER BY ts, ingest_seq) = ts AS rp FROM kept_h) GROUP BY symbol, session_date) k
 LEFT JOIN caldays_h c USING (session_date)""",
)
_RULES = [
    ("CORRUPT", "NOT is_trading_day", "not a trading day"),
    ("CORRUPT", "backward > 0", "timestamps not ascending"),
    ("CORRUPT", "repeated > 0", "duplicate timestamp"),
    ("CORRUPT", "wrong_date > 0", "bars dated outside the session"),
    ("CORRUPT", "off_grid > 0", "bars off the session grid"),
    ("CORRUPT", "nulls > 0", "missing values"),
    ("CORRUPT", "nulls = 0 AND nonpos > 0", "price not positive"),
    ("CORRUPT", "nulls = 0 AND lowabove > 0", "low above open or close"),
    ("CORRUPT", "nulls = 0 AND highbelow > 0", "high below open or close"),
    ("CORRUPT", "nulls = 0 AND negvol > 0", "negative volume"),
    ("TAIL_COLLAPSED", "tail", "last slots folded away"),
    ("PARTIAL", "NOT tail", "slots missing"),
    ("SUSPECT", "zerovol > 0.5 * n", "mostly zero volume"),
]


def _any(verdict: str) -> str:
    return " OR ".join(f"({c})" for v, c, _ in _RULES if v == verdict)


_LIST = ", ".join(f"CASE WHEN {c} THEN '{v}: {t}' END" for v, c, t in _RULES)
step(
    "verd_h",
    f"""SELECT *, CASE WHEN {_any('CORRUPT')} THEN 'CORRUPT' WHEN {_any('SUSPECT')} THEN 'SUSPECT' WHEN {_any('PARTIAL')} THEN 'PARTIAL'
 WHEN {_any('TAIL_COLLAPSED')} THEN 'TAIL_COLLAPSED' ELSE 'CLEAN' END AS verdict,
 array_to_string(list_filter([{_LIST}], lambda x: x IS NOT NULL), '; ') AS reasons,
 array_to_string(list_transform(missing, lambda s: printf('%02d:00', s)), '; ') AS missing_slots FROM chk_h""",
)
step(
    "tier_h",
    "SELECT *, CASE WHEN verdict IN ('CLEAN', 'TAIL_COLLAPSED') THEN 'bars' ELSE 'quarantine' END AS tier FROM verd_h",
)
step(
    "rawday_m",
    """SELECT symbol, ts::DATE AS session_date, CASE WHEN fs % 83 = 3 THEN 0.0::DOUBLE ELSE open END AS open,
 CASE WHEN fs % 97 = 1 THEN low ELSE high END AS high, CASE WHEN fs % 97 = 1 THEN high ELSE low END AS low,
 CASE WHEN fs % 79 <> 4 THEN close END AS close, CASE WHEN fs % 89 = 2 THEN -volume ELSE volume END AS volume
 FROM bars_m JOIN (SELECT symbol, session_date, slot, min(seq) AS fs FROM ticks_m GROUP BY ALL) USING (symbol, session_date, slot)""",
)
step(
    "dayverd_m",
    """SELECT symbol, session_date, CASE WHEN closed IS NOT NULL OR shape IS NOT NULL THEN 'CORRUPT' WHEN open / CASE WHEN pc > 0 THEN pc END < 0.6
  OR open / CASE WHEN pc > 0 THEN pc END > 1.6 THEN 'SUSPECT' ELSE 'CLEAN' END AS verdict,
 CASE WHEN closed IS NOT NULL OR shape IS NOT NULL THEN concat_ws('; ', closed, shape) WHEN open / CASE WHEN pc > 0 THEN pc END < 0.6
  OR open / CASE WHEN pc > 0 THEN pc END > 1.6 THEN 'SUSPECT: possible corporate action' ELSE '' END AS reasons FROM (
 SELECT d.*, CASE WHEN NOT c.is_trading_day THEN 'CORRUPT: not a trading day' END AS closed, CASE WHEN open IS NULL OR close IS NULL OR
  high IS NULL OR low IS NULL OR volume IS NULL THEN 'CORRUPT: missing values' WHEN least(open, high, low, close) <= 0 THEN 'CORRUPT: price not positive'
  WHEN low > least(open, close) OR high < greatest(open, close) THEN 'CORRUPT: prices inconsistent' WHEN volume < 0 THEN 'CORRUPT: negative volume' END AS shape,
  lag(close) OVER (PARTITION BY symbol ORDER BY session_date) AS pc FROM rawday_m d LEFT JOIN caldays_m c USING (session_date)
  WHERE session_date <> (SELECT max(session_date) FROM dates_m))""",
)
# Hourly outcomes use the daily rows of the same fixture: each session as one daily row.
step("asked_h", "SELECT symbol FROM bars_h UNION SELECT r_name FROM region")
step(
    "lack_h",
    """SELECT u.symbol, c.session_date FROM asked_h u, caldays_h c WHERE c.is_trading_day
 AND NOT EXISTS (SELECT 1 FROM verd_h v WHERE v.symbol = u.symbol AND v.session_date = c.session_date)""",
)
step(
    "slots_h",
    """SELECT symbol, slot, count(*) AS n FROM (SELECT symbol, unnest(missing) AS slot FROM verd_h WHERE verdict IN ('PARTIAL', 'TAIL_COLLAPSED'))
 GROUP BY symbol, slot""",
)
step(
    "outc_h",
    """SELECT u.symbol, (SELECT count(*) FROM caldays_h WHERE is_trading_day) AS expected_sessions, coalesce(r.received, 0) AS received_sessions,
 coalesce(l.dates, '') AS missing_dates, coalesce(r.clean, 0) AS clean, coalesce(r.tail_collapsed, 0) AS tail_collapsed, coalesce(r.partial, 0) AS partial,
 coalesce(r.suspect, 0) AS suspect, coalesce(r.corrupt, 0) AS corrupt, coalesce(s.slots, '') AS missing_slot_counts
 FROM asked_h u LEFT JOIN (SELECT symbol, count(*) AS received, count(*) FILTER (verdict = 'CLEAN') AS clean,
  count(*) FILTER (verdict = 'TAIL_COLLAPSED') AS tail_collapsed, count(*) FILTER (verdict = 'PARTIAL') AS partial,
  count(*) FILTER (verdict = 'SUSPECT') AS suspect, count(*) FILTER (verdict = 'CORRUPT') AS corrupt FROM verd_h GROUP BY symbol) r USING (symbol)
 LEFT JOIN (SELECT symbol, string_agg(session_date::VARCHAR, '; ' ORDER BY session_date) AS dates FROM lack_h GROUP BY symbol) l USING (symbol)
 LEFT JOIN (SELECT symbol, string_agg(printf('%02d:00', slot) || '=' || n, '; ' ORDER BY slot) AS slots FROM slots_h GROUP BY symbol) s USING (symbol)""",
)

# ---- daily universe --------------------------------------------------------------------
MIN_TURNOVER = 5e6
IN_PLAY = 2
_T = f"{MIN_TURNOVER:g}"
step(
    "pool_m",
    f"""SELECT symbol, session_date, prior_close, prior_turnover, prior_atr, CASE WHEN prior_close > 0 THEN prior_atr / prior_close * 100 END AS atr_pct,
 CASE WHEN prior_close IS NULL THEN 'no prior session' ELSE concat_ws('; ', CASE WHEN prior_close < {MONTHS.min_price} THEN 'price below {MONTHS.min_price:g}' END,
  CASE WHEN prior_atr IS NULL OR prior_atr <= 0 THEN 'no prior-day ATR' WHEN prior_atr / prior_close * 100 < {MONTHS.min_atr_pct} THEN 'ATR below {MONTHS.min_atr_pct:g}%' END,
  CASE WHEN prior_turnover < {MIN_TURNOVER} THEN 'turnover below {_T}' END) END AS reasons FROM (
 SELECT c.symbol, c.session_date, (SELECT arg_max(d.close, d.session_date) FROM daily_m d WHERE d.symbol = c.symbol AND d.session_date < c.session_date) AS prior_close,
  (SELECT arg_max(d.close * d.volume, d.session_date) FROM daily_m d WHERE d.symbol = c.symbol AND d.session_date < c.session_date) AS prior_turnover,
  p.atr AS prior_atr FROM (SELECT a.symbol, b.session_date FROM (SELECT DISTINCT symbol FROM bars_m) a, (SELECT DISTINCT session_date FROM bars_m) b) c
 LEFT JOIN prior_m p USING (symbol, session_date))""",
)
step(
    "orvol_m",
    f"""SELECT h.symbol, h.session_date, r.rvol_at_time AS opening_rvol FROM hist_m h JOIN rvolat_m r USING (symbol, session_date, slot)
 WHERE h.pos = {MONTHS.opening_range_bars - 1}""",
)
step(
    "cand_m",
    """SELECT p.*, reasons = '' AS eligible, o.opening_rvol, CASE WHEN reasons = '' AND o.opening_rvol IS NOT NULL THEN
 row_number() OVER (PARTITION BY p.session_date, reasons = '' AND o.opening_rvol IS NOT NULL ORDER BY o.opening_rvol DESC, p.symbol) END AS rank
 FROM pool_m p LEFT JOIN orvol_m o USING (symbol, session_date)""",
)
_POISON_SLOT = 2
step(
    "poison_m",
    f"""SELECT b.symbol, b.session_date, b.slot, CASE WHEN hit THEN ramp * 0.995 ELSE open END AS open, CASE WHEN hit THEN ramp * 1.01 ELSE high END AS high,
 CASE WHEN hit THEN ramp * 0.99 ELSE low END AS low, CASE WHEN hit THEN ramp ELSE close END AS close,
 CASE WHEN hit THEN trunc(med * 50)::BIGINT ELSE volume END AS volume FROM (
 SELECT m.*, h.med, h.hc * (1 + 0.5::DOUBLE * (0.2::DOUBLE + CASE WHEN m.cnt > 1 THEN (m.rn - 1) * ((1.0::DOUBLE - 0.2::DOUBLE) / (m.cnt - 1)) ELSE 0 END)) AS ramp
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol, hit ORDER BY slot) AS rn, count(*) OVER (PARTITION BY symbol, hit) AS cnt FROM (
  SELECT *, session_date = max(session_date) OVER (PARTITION BY symbol) AND slot >= {_POISON_SLOT} AS hit FROM bars_m)) m
 JOIN (SELECT symbol, quantile_cont(volume::DOUBLE, 0.5) AS med, arg_max(close, epoch(session_date) * 100 + slot) AS hc FROM (
  SELECT *, session_date = max(session_date) OVER (PARTITION BY symbol) AND slot >= {_POISON_SLOT} AS hit FROM bars_m) WHERE NOT hit GROUP BY symbol) h USING (symbol)) b""",
)

"""Registered queries: delivered bars, verdicts, the store, the daily universe and the audits."""

from __future__ import annotations

import datetime
import uuid
from functools import partial

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import require_none, stage_root, write_stage
from rangebreak.operators import audit, quality, study, universe
from rangebreak.operators.features import EVENT_KEY, breakout_context, feature_columns
from rangebreak.operators.indicators import rvol_at_time, rvol_bar, session_sigma, session_vwap
from rangebreak.operators.labelling import detect_breakouts
from rangebreak.plans import catalogue
from rangebreak.operators.trades import failed_orb_signals, orb_signals
from rangebreak.plans.fixtures import INDEX, ZONE
from rangebreak.plans.sql import delivery as sql
from rangebreak.plans.sql.base import num
from rangebreak.sources import artifacts, reference, store
from rangebreak.sources.ticks import daily_rows

# These plans read bars on several branches.
query = partial(catalogue.query, stage=True)

S = "symbol, session_date::VARCHAR AS session_date"
OHLC = num("open", "high", "low", "close")


def scratch(fx, name: str) -> str:
    return f"{stage_root(fx.spark)}/{name}-{uuid.uuid4().hex}"


# ---- validation ------------------------------------------------------------------------


@query("drop_settling_tail", "h", f"SELECT {S}, ts::VARCHAR AS ts, ingest_seq, dropped AS dropped_tail_bars FROM kept_h")
def drop_settling_tail(fx):
    kept = quality.drop_settling_tail(fx.delivered, fx.params)
    return kept.select("symbol", "session_date", "ts", "ingest_seq", "dropped_tail_bars")


def _checks(key: str, columns: dict[str, str]) -> None:
    picked = ", ".join(f"{theirs} AS {mine}" for mine, theirs in columns.items())

    @query(key, "h", f"SELECT {S}, {picked} FROM chk_h")
    def build(fx):
        rows = quality.session_checks(fx.delivered, fx.real_calendar, fx.params)
        missing = F.transform("missing", lambda s: s.cast("string"))
        return rows.withColumn("missing", missing).select("symbol", "session_date", *columns)


_checks("check_trading_day", {"is_trading_day": "is_trading_day", "bar_count": "n"})
_checks("check_order_unique", {"backward_bars": "backward", "repeated_bars": "repeated"})
_checks("check_window_grid", {"wrong_date_bars": "wrong_date", "off_grid_bars": "off_grid"})
_checks(
    "check_ohlc",
    {
        "null_bars": "nulls", "nonpositive_bars": "nonpos", "low_above_bars": "lowabove",
        "high_below_bars": "highbelow", "negative_volume_bars": "negvol",
    },
)
_checks("check_missing_slots", {"missing": "array_to_string(missing, '; ')", "tail_collapsed": "tail", "dropped_tail_bars": "dropped"})
_checks("check_zero_volume", {"zero_volume_bars": "zerovol", "bar_count": "n"})


@query("session_verdicts", "h", f"""SELECT {S}, verdict, n AS bar_count, 24 AS expected_bars, zerovol AS zero_volume_bars, missing_slots,
 dropped AS dropped_tail_bars, reasons FROM verd_h""")
def session_verdicts(fx):
    return fx.verdicts.drop("fetched_at")


@query("daily_row_verdicts", "m", f"SELECT {S}, verdict, reasons FROM dayverd_m")
def daily_row_verdicts(fx):
    return quality.daily_row_verdicts(fx.delivered_daily, fx.real_calendar, fx.params)


@query("tier_routing", "h", f"SELECT {S}, verdict, tier FROM tier_h")
def tier_routing(fx):
    return quality.tier_routing(fx.verdicts).select("symbol", "session_date", "verdict", "tier")


def outcomes(fx):
    """Outcomes of every symbol asked for, corrupt sessions counted among the received."""
    expected = fx.real_calendar.where("is_trading_day").select("session_date")
    daily = quality.daily_row_verdicts(
        fx.daily.join(F.broadcast(fx.fetched_at)), fx.real_calendar, fx.params
    )
    return quality.symbol_outcomes(fx.expected_symbols, fx.verdict_stage, daily, expected)


_DAYH = """(SELECT symbol, count(*) AS daily_rows, count(*) FILTER (v = 'CORRUPT') AS daily_corrupt, count(*) FILTER (v = 'SUSPECT') AS daily_suspect FROM (
 SELECT symbol, CASE WHEN NOT is_trading_day OR least(open, high, low, close) <= 0 THEN 'CORRUPT' WHEN open / pc < 0.6 OR open / pc > 1.6 THEN 'SUSPECT' ELSE 'CLEAN' END AS v FROM (
  SELECT d.*, nullif(lag(close) OVER (PARTITION BY symbol ORDER BY session_date), 0) AS pc, c.is_trading_day FROM daily_h d JOIN caldays_h c USING (session_date)
  WHERE session_date <> (SELECT max(session_date) FROM dates_h))) GROUP BY symbol)"""


@query("symbol_outcomes", "h", f"SELECT o.*, coalesce(d.daily_rows, 0) AS daily_rows, coalesce(d.daily_corrupt, 0) AS daily_corrupt, coalesce(d.daily_suspect, 0) AS daily_suspect FROM outc_h o LEFT JOIN {_DAYH} d USING (symbol)")
def symbol_outcomes(fx):
    pairs = F.transform(
        F.map_entries("missing_slot_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return outcomes(fx).withColumns(
        {
            "missing_slot_counts": F.coalesce(F.array_join(pairs, "; "), F.lit("")),
            "missing_dates": F.array_join(F.transform("missing_dates", lambda d: d.cast("string")), "; "),
        }
    )


@query("run_tally", "h", f"""SELECT count(*) AS symbols, sum(expected_sessions)::BIGINT AS attempted, sum(received_sessions)::BIGINT AS received, sum(clean)::BIGINT AS clean,
 sum(tail_collapsed)::BIGINT AS tail_collapsed, sum(partial)::BIGINT AS partial, sum(suspect)::BIGINT AS suspect, sum(corrupt)::BIGINT AS corrupt,
 sum(daily_rows)::BIGINT AS daily_rows, sum(daily_corrupt)::BIGINT AS daily_corrupt, sum(daily_suspect)::BIGINT AS daily_suspect,
 sum(expected_sessions - received_sessions)::BIGINT AS missing, sum(clean + tail_collapsed)::BIGINT AS research FROM outc_h LEFT JOIN {_DAYH} USING (symbol)""")
def run_tally(fx):
    return quality.run_tally(outcomes(fx))


@query("missing_everywhere", "h", """SELECT 'all symbols' AS scope, NULL::VARCHAR AS symbol, session_date::VARCHAR AS session_date FROM lack_h GROUP BY session_date
 HAVING count(*) = (SELECT count(*) FROM asked_h) UNION ALL SELECT 'one symbol', symbol, session_date::VARCHAR FROM lack_h
 WHERE session_date IN (SELECT session_date FROM lack_h GROUP BY session_date HAVING count(*) < (SELECT count(*) FROM asked_h))""")
def missing_everywhere(fx):
    return quality.missing_everywhere(outcomes(fx))


@query("top_missing_slots", "h", """SELECT printf('%02d:00', slot) AS slot, sum(n)::BIGINT AS n FROM slots_h GROUP BY slots_h.slot
 ORDER BY n DESC, slot LIMIT 8""")
def top_missing_slots(fx):
    return quality.top_missing_slots(fx.verdict_stage)


def latest(fx):
    return store.latest_verdict(fx.verdict_log, "60m")


@query("latest_verdict", "h", f"SELECT {S}, 2 AS seq, verdict, n AS bar_count, missing_slots, reasons FROM verd_h")
def latest_verdict(fx):
    return latest(fx).select("symbol", "session_date", "seq", "verdict", "bar_count", "missing_slots", "reasons")


# Every seventh day of the year its daily rows hold a price of zero.
_FAULTY_DAYS = _DAYH.replace(
    "SELECT d.*,", "SELECT d.* REPLACE (CASE WHEN dayofyear(d.session_date) % 7 = 3 THEN 0.0 ELSE d.low END AS low),"
)


@query("integrity_summary", "h", f"""SELECT * FROM (SELECT count(*) AS sessions_validated, count(*) FILTER (verdict = 'CLEAN') AS clean,
 count(*) FILTER (verdict = 'TAIL_COLLAPSED') AS tail_collapsed, count(*) FILTER (verdict = 'PARTIAL') AS partial, count(*) FILTER (verdict = 'SUSPECT') AS suspect,
 count(*) FILTER (verdict = 'CORRUPT') AS corrupt, count(*) FILTER (verdict IN ('CLEAN', 'TAIL_COLLAPSED')) AS research_sessions, count(DISTINCT symbol) AS symbols FROM verd_h),
 (SELECT count(*) AS symbols_with_rejects, coalesce(max(n), 0) AS most_rejects, coalesce(string_agg(symbol || '=' || n, '; ' ORDER BY symbol), '') AS rejected FROM (
  SELECT symbol, count(*) AS n FROM verd_h WHERE verdict NOT IN ('CLEAN', 'TAIL_COLLAPSED') GROUP BY symbol)),
 (SELECT coalesce(sum(daily_rows), 0)::BIGINT AS daily_rows, coalesce(sum(daily_corrupt), 0)::BIGINT AS daily_corrupt FROM {_FAULTY_DAYS}),
 (SELECT ((SELECT max(session_date) FROM dates_h)::TIMESTAMP + INTERVAL 18 HOUR)::VARCHAR AS last_fetch),
 (SELECT sum(expected_sessions)::BIGINT AS last_attempted, sum(received_sessions)::BIGINT AS last_received,
  sum(expected_sessions - received_sessions)::BIGINT AS last_missing FROM outc_h)""")
def integrity_summary(fx):
    """One log of verdicts of both intervals and of two runs, read once; the earlier run found nothing."""
    path = scratch(fx, "integrity")
    append_verdicts(fx.verdict_log.where("interval = '60m'"), path)
    low = F.when(F.dayofyear("session_date") % 7 == 3, F.lit(0.0)).otherwise(F.col("low"))
    daily = quality.daily_row_verdicts(
        fx.daily.withColumn("low", low).join(F.broadcast(fx.fetched_at)), fx.real_calendar, fx.params
    )
    append_verdicts(daily.select(F.lit(3).alias("seq"), F.lit("1d").alias("interval"), "*", F.lit(1).alias("bar_count")), path)
    tally = quality.run_tally(outcomes(fx)).join(F.broadcast(fx.fetched_at))
    empty = tally.withColumns({c: F.lit(0) for c in ("attempted", "received", "missing")})
    for seq, found in ((4, tally), (1, empty)):
        store.append_events(store.fetch_run(found, seq, "60m", F.col("fetched_at")), "fetch_run", path)
    events = store.read_events(fx.spark, path)
    require_none(store.event_violations(events), "event log")
    verdicts = store.events_of(events, "verdict")
    summary = quality.integrity_summary(
        store.latest_verdict(verdicts, "60m"), store.latest_verdict(verdicts, "1d"), store.events_of(events, "fetch_run"), fx.params
    )
    pairs = F.transform(F.map_entries("rejected"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return summary.withColumn("rejected", F.array_join(pairs, "; "))


def append_verdicts(records, path):
    store.append_events(records, "verdict", path)


# ---- sources and sinks -----------------------------------------------------------------

_KEPT = "SELECT k.symbol, k.session_date, k.gs AS slot, k.ts, k.open, k.high, k.low, k.close, k.volume, t.tier FROM kept_h k JOIN tier_h t USING (symbol, session_date)"
_STORED = f"SELECT {S}, slot, ts::VARCHAR AS ts, {OHLC}, volume FROM ({_KEPT}) WHERE "
SEAL = datetime.date(2024, 1, 17)


@query("scan_bars", "h", _STORED + "tier = 'bars'")
def scan_bars(fx):
    return store.scan_bars(fx.spark, fx.store_root, "60m", ZONE)


@query("scan_research_sealed", "h", _STORED + f"tier = 'bars' AND session_date < DATE '{SEAL}'")
def scan_research_sealed(fx):
    return store.scan_research_sealed(fx.spark, fx.store_root, "60m", ZONE, SEAL)


@query("scan_holdout", "h", _STORED + f"tier = 'bars' AND session_date >= DATE '{SEAL}'")
def scan_holdout(fx):
    return store.scan_holdout(fx.spark, fx.store_root, "60m", ZONE, SEAL, unsealed=True)


@query("scan_quarantine", "h", _STORED + "tier = 'quarantine'")
def scan_quarantine(fx):
    return store.scan_quarantine(fx.spark, fx.store_root, "60m", ZONE)


@query("list_symbols", "h", f"SELECT DISTINCT symbol FROM ({_KEPT}) WHERE tier = 'bars'")
def list_symbols(fx):
    return store.list_symbols(store.scan_bars(fx.spark, fx.store_root, "60m", ZONE))


@query("research_sessions", "h", f"SELECT DISTINCT {S} FROM ({_KEPT}) WHERE tier = 'bars'")
def research_sessions(fx):
    return store.research_sessions(store.scan_bars(fx.spark, fx.store_root, "60m", ZONE))


def two_deliveries(fx):
    """A store of clean bars for two thirds of the dates, and new bars for every second date."""
    start = F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("slot"))
    clean = fx.bars.where(F.dayofyear("session_date") % 3 != 0).withColumns(
        {"ts": start, "tier": F.lit("bars")}
    )
    incoming = write_stage(fx.routed.where(F.dayofyear("session_date") % 2 == 0), "incoming")
    return store.stored(clean, "60m", ZONE), incoming


@query("upsert_sessions", "h", f"""SELECT {S}, slot, ts::VARCHAR AS ts, tier, {OHLC}, volume FROM (
 SELECT symbol, session_date, slot, session_date::TIMESTAMP + to_hours(slot) AS ts, open, high, low, close, volume, 'bars' AS tier FROM bars_h b
 WHERE dayofyear(session_date) % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM tier_h t WHERE t.symbol = b.symbol AND t.session_date = b.session_date
  AND dayofyear(t.session_date) % 2 = 0) UNION ALL
 SELECT symbol, session_date, slot, ts, open, high, low, close, volume, tier FROM ({_KEPT}) WHERE dayofyear(session_date) % 2 = 0)""")
def upsert_sessions(fx):
    first, incoming = two_deliveries(fx)
    root = scratch(fx, "upsert")
    store.write_store(first, root)
    existing = fx.spark.read.schema(store.STORE_SCHEMA).parquet(root)
    # Only the months that receive sessions are rewritten.
    store.write_store(store.merged_months(existing, incoming, fx.verdict_stage, ZONE), root)
    tiers = [
        store.scan_bars(fx.spark, root, "60m", ZONE, tier).withColumn("tier", F.lit(tier))
        for tier in ("bars", "quarantine")
    ]
    return tiers[0].unionByName(tiers[1])


@query("upsert_audit", "h", f"""SELECT CASE WHEN p.n IS NULL THEN 'added' ELSE 'replaced' END AS event, '60m' AS "interval", t.symbol, t.session_date::VARCHAR AS session_date,
 t.tier, t.verdict, t.n AS rows, CASE WHEN p.n IS NOT NULL THEN 'bars' END AS previous_tier, p.n AS previous_rows FROM tier_h t LEFT JOIN
 (SELECT symbol, session_date, count(*) AS n FROM bars_h WHERE dayofyear(session_date) % 3 <> 0 GROUP BY ALL) p USING (symbol, session_date)
 WHERE dayofyear(t.session_date) % 2 = 0""")
def upsert_audit(fx):
    first, incoming = two_deliveries(fx)
    return store.upsert_audit(first, incoming, fx.verdict_stage)


@query("event_log", "h", f"""SELECT seq, iv AS "interval", symbol, session_date, verdict, bar_count, reasons FROM (SELECT 1 AS seq, '60m' AS iv, {S}, 'PARTIAL' AS verdict, n AS bar_count, reasons
 FROM verd_h WHERE dayofyear(session_date) % 2 = 0 UNION ALL SELECT 2, '60m', {S}, verdict, n, reasons FROM verd_h UNION ALL
 SELECT 3, '1d', {S}, 'CLEAN', n, reasons FROM verd_h)""")
def event_log(fx):
    path = scratch(fx, "log")
    for seq in (1, 2, 3):
        append_verdicts(fx.verdict_log.where(F.col("seq") == seq), path)
    run = store.fetch_run(quality.run_tally(outcomes(fx)), 4, "60m", F.lit(None).cast("timestamp_ntz"))
    store.append_events(run, "fetch_run", path)
    events = store.read_events(fx.spark, path)
    require_none(store.event_violations(events), "event log")
    return store.events_of(events, "verdict")


@query("scan_universe", "h", "SELECT trim(s_name) AS symbol FROM supplier")
def scan_universe(fx):
    path = scratch(fx, "universe")
    names = fx.table("supplier").select(
        F.explode(F.array(F.concat(F.lit("  "), "s_name", F.lit(" ")), F.lit(""))).alias("value")
    )
    names.write.text(path)
    symbols = reference.scan_universe(fx.spark, path)
    require_none(reference.universe_violations(symbols), "universe")
    return symbols


@query("scan_holidays", "m", "SELECT date::VARCHAR AS date, name FROM holidays_m")
def scan_holidays(fx):
    path = scratch(fx, "holidays")
    fx.holidays.write.option("header", True).csv(path)
    return reference.scan_holidays(fx.spark, path)


@query("scan_expiries", "m", "SELECT DISTINCT date::VARCHAR AS date FROM expiries_m")
def scan_expiries(fx):
    path = scratch(fx, "expiries")
    listed = fx.expiries.select(
        F.explode(F.array(F.col("date").cast("string"), F.col("date").cast("string"), F.lit(" "))).alias("date")
    )
    listed.write.option("header", True).option("ignoreTrailingWhiteSpace", False).option(
        "ignoreLeadingWhiteSpace", False
    ).csv(path)
    return reference.scan_expiries(fx.spark, path)


@query("vendor_to_bars", "h", f"""SELECT symbol, ts::DATE::VARCHAR AS session_date, ts::VARCHAR AS ts, {OHLC}, volume FROM raw_h r
 WHERE ingest_seq = (SELECT max(q.ingest_seq) FROM raw_h q WHERE q.symbol = r.symbol AND q.ts = r.ts)""")
def vendor_to_bars(fx):
    delivered = fx.delivered.withColumnsRenamed(
        {c: c.title() for c in store.BAR_FIELDS}
    )
    raw = delivered.select("symbol", F.col("ts").alias("date"), *[c.title() for c in store.BAR_FIELDS], "ingest_seq")
    return store.vendor_to_bars(raw, ZONE, "date", names="title").drop("ingest_seq")


@query("vendor_to_bars_zoned", "h", f"""SELECT symbol, ts::DATE::VARCHAR AS session_date, ts::VARCHAR AS ts, {OHLC}, volume FROM raw_h r
 WHERE ingest_seq = (SELECT max(q.ingest_seq) FROM raw_h q WHERE q.symbol = r.symbol AND q.ts = r.ts)""")
def vendor_to_bars_zoned(fx):
    """The other layout: lower-case names and instants, here the local times as such in the zone."""
    instant = F.convert_timezone(F.lit(ZONE), F.lit("UTC"), F.col("ts")).cast("timestamp")
    raw = fx.delivered.select("symbol", instant.alias("datetime"), *store.BAR_FIELDS, "ingest_seq")
    return store.vendor_to_bars(raw, ZONE, "datetime").drop("ingest_seq")


@query("vendor_violations", "h", """SELECT symbol, ts::VARCHAR AS ts, 'missing value' AS violation FROM raw_h WHERE open IS NULL OR high IS NULL OR low IS NULL
 OR close IS NULL OR volume IS NULL UNION ALL SELECT symbol, ts::VARCHAR, 'repeated timestamp' FROM raw_h GROUP BY symbol, ts HAVING count(*) > 1""")
def vendor_violations(fx):
    raw = fx.delivered.select("symbol", "ts", *store.BAR_FIELDS, "ingest_seq")
    return store.vendor_violations(store.vendor_to_bars(raw, ZONE, "ts", keep_last=False))


@query("bar_contract_check", "h", """SELECT symbol, violation, rows FROM (SELECT symbol, 'not ascending' AS violation, count(*) FILTER (bk) AS rows FROM (
 SELECT symbol, lag(ts) OVER (PARTITION BY symbol, session_date ORDER BY ingest_seq) > ts AS bk FROM raw_h) GROUP BY symbol UNION ALL
 SELECT symbol, 'duplicate timestamp', count(*) FILTER (rp) FROM (SELECT symbol, lag(ts) OVER (PARTITION BY symbol, session_date ORDER BY ts, ingest_seq) = ts AS rp FROM raw_h)
 GROUP BY symbol) WHERE rows > 0""")
def bar_contract_check(fx):
    return store.contract_violations(fx.delivered)


@query("unresolved_symbols", "h", """SELECT s_suppkey::VARCHAR AS symbol FROM supplier WHERE s_suppkey NOT IN
 (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 5 <> 0)""")
def unresolved_symbols(fx):
    symbols = fx.table("supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    key = F.col("l_suppkey")
    instruments = fx.table("lineitem").select(
        key.cast("string").alias("tradingsymbol"),
        key.alias("instrument_token"),
        F.when(key % 5 != 0, F.lit("EQ")).otherwise(F.lit("FUT")).alias("instrument_type"),
    ).distinct()
    return reference.unresolved_symbols(symbols, instruments)


@query("artifact_sinks", "m", """SELECT symbol, session_date::VARCHAR AS session_date, direction, label, 'features' AS artifact, 2 AS features_version FROM feat_m
 UNION ALL SELECT symbol, session_date::VARCHAR, direction, label, 'breakouts', 2 FROM events_m""")
def artifact_sinks(fx):
    root = scratch(fx, "artifacts")
    made = {"features": fx.features, "breakouts": fx.events}
    for name, df in made.items():
        artifacts.save_artifact(df, root, name, 2)
    back = {name: artifacts.load_artifact(fx.spark, root, name, 2) for name in made}
    told = [
        df.select(*EVENT_KEY, "label", F.lit(name).alias("artifact"), F.lit(artifacts.artifact_version(df)).alias("features_version"))
        for name, df in back.items()
    ]
    return told[0].unionByName(told[1])


@query("stale_artifact_filter", "w", """SELECT setup, CASE WHEN setup = 'failed_orb' THEN 3 ELSE 2 END AS features_version, count(*) AS n FROM sig_$, (SELECT verdict FROM study_$)
 WHERE setup <> 'failed_orb' OR verdict = 'signal' GROUP BY ALL""")
def stale_artifact_filter(fx):
    """Signals of each setup are saved with the version of their features, once too old; versions are read back."""
    root = scratch(fx, "artifacts")
    setups = {"orb": ((1, "breakouts"), (2, "backtest_results")), "failed_orb": ((3, "backtest_summary"),)}
    made = []
    for setup, saved in setups.items():
        for version, name in saved:
            artifacts.save_artifact(fx.signals.where(F.col("setup") == setup), root, name, version)
            back = artifacts.load_artifact(fx.spark, root, name)
            made.append(
                back.groupBy("setup").agg(F.lit(artifacts.artifact_version(back)).alias("features_version"), F.count("*").alias("n"))
            )
    every = made[0].unionByName(made[1]).unionByName(made[2])
    return artifacts.stale_artifact_filter(every, 2, study.study_verdict(fx.feature_stage, fx.params))


# ---- daily universe --------------------------------------------------------------------


def selection_params(fx):
    return fx.params.with_(min_turnover=sql.MIN_TURNOVER, stocks_in_play=sql.IN_PLAY)


def audit_rows(fx):
    return universe.candidate_audit(fx.bars, fx.daily, fx.calendar, selection_params(fx))


_POOL = num("prior_close", "prior_atr", "atr_pct", "prior_turnover", digits=3)


@query("eligible_pool", "m", f"SELECT {S}, {_POOL}, reasons = '' AS eligible, reasons FROM pool_m", digits=3)
def eligible_pool(fx):
    return universe.eligible_pool(universe.candidates(fx.bars), fx.daily, fx.calendar, selection_params(fx))


@query("opening_rvol", "m", f"SELECT {S}, {num('opening_rvol')} FROM orvol_m")
def opening_rvol(fx):
    return universe.opening_rvol(fx.bars, fx.params)


@query("candidate_audit", "m", f"SELECT {S}, {_POOL}, eligible, reasons, {num('opening_rvol', digits=3)} FROM cand_m", digits=3)
def candidate_audit(fx):
    return audit_rows(fx)


@query("stocks_in_play", "m", f"SELECT {S}, rank, {num('opening_rvol')} FROM cand_m WHERE rank <= {sql.IN_PLAY}")
def stocks_in_play(fx):
    return universe.stocks_in_play(audit_rows(fx), selection_params(fx)).select(
        "symbol", "session_date", "rank", "opening_rvol"
    )


@query("selection_report", "m", f"""SELECT session_date::VARCHAR AS session_date, count(*) AS n_considered, count(*) FILTER (eligible) AS n_eligible,
 count(*) FILTER (eligible AND opening_rvol IS NOT NULL) AS n_with_rvol, coalesce(string_agg(symbol, '; ' ORDER BY rank) FILTER (rank <= {sql.IN_PLAY}), '') AS selected,
 coalesce((SELECT string_agg(head || '=' || k, '; ' ORDER BY head) FROM (SELECT split_part(reasons, ' ', 1) AS head, count(*) AS k FROM cand_m q
  WHERE q.session_date = c.session_date AND reasons <> '' GROUP BY 1)), '') AS exclusion_counts FROM cand_m c GROUP BY c.session_date""")
def selection_report(fx):
    pairs = F.transform(
        F.map_entries("exclusion_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    report = universe.selection_report(audit_rows(fx), selection_params(fx))
    return report.withColumn("exclusion_counts", F.coalesce(F.array_join(pairs, "; "), F.lit("")))


# ---- leak audits -----------------------------------------------------------------------

POISON_SLOT = sql._POISON_SLOT


@query("poison_future", "m", f"SELECT {S}, slot, {num('open', 'high', 'low', 'close', digits=4)}, volume FROM poison_m", digits=4)
def poison_future(fx):
    return audit.poison_future(fx.bars.drop("ts"), POISON_SLOT)


@query("frame_diff", "m", f"""SELECT b.symbol, b.session_date::VARCHAR AS session_date, b.slot, f.field, 'differs' AS difference FROM bars_m b JOIN poison_m p
 USING (symbol, session_date, slot), (VALUES ('open'), ('high'), ('low'), ('close'), ('volume')) f(field)
 WHERE CASE f.field WHEN 'open' THEN b.open <> p.open WHEN 'high' THEN b.high <> p.high WHEN 'low' THEN b.low <> p.low WHEN 'close' THEN b.close <> p.close
 ELSE b.volume <> p.volume END""")
def frame_diff(fx):
    bars = fx.bars.drop("ts")
    changed = audit.poison_future(bars, POISON_SLOT)
    return audit.frame_diff(bars, changed, ["symbol", "session_date", "slot"]).drop("left_value", "right_value")


def _decisions_of(fx, decide):
    """Decisions recomputed from bars alone: daily rows come from the same bars, and the index ends where they do."""

    def transform(every):
        bars = every.where(audit.plain_symbol() != INDEX)
        index = every.where(audit.plain_symbol() == INDEX).withColumn("version", audit.version_of())
        events = breakout_context(bars, daily_rows(bars), fx.calendar, fx.params)
        return decide(events.withColumn("version", audit.version_of()), bars, index)

    return transform


def _features_of(fx):
    def features(events, bars, index):
        table = feature_columns(events, bars, index, fx.expiries, fx.params, index_key=("version", "session_date"))
        # Labels and extensions are outcomes, and may look ahead.
        return table.drop("label", "max_extension_atr")

    return _decisions_of(fx, features)


def _signals_of(fx):
    return _decisions_of(fx, lambda events, bars, index: orb_signals(events).unionByName(failed_orb_signals(events)))


def _indicators_of(fx):
    """Every indicator at every bar."""

    def transform(bars):
        inside = session_sigma(session_vwap(bars)).select(*BAR_KEY, "vwap", "sigma")
        return inside.join(rvol_at_time(bars, fx.params), BAR_KEY).join(rvol_bar(bars, fx.params), BAR_KEY)

    return transform


def _detection_of(fx):
    return lambda bars: detect_breakouts(bars, fx.params)


def _universe_of(fx):
    """Candidates at the slot of the nth bar, which decides; without one, at the end of the session."""

    def transform(bars):
        order = W.partitionBy("symbol", "session_date").orderBy("slot")
        nth = (
            bars.withColumn("pos", F.row_number().over(order))
            .where(F.col("pos") == fx.params.opening_range_bars)
            .select("symbol", "session_date", F.col("slot").alias("nth_slot"))
        )
        judged = universe.candidate_audit(bars, daily_rows(bars), fx.calendar, selection_params(fx))
        last = F.lit(fx.params.slots_per_session - 1)
        return judged.join(nth, ["symbol", "session_date"], "left").withColumn("decided_slot", F.coalesce("nth_slot", last)).drop("nth_slot")

    return transform


CUT_SLOTS = (6, 12, 20)
BAR_KEY = ["symbol", "session_date", "slot"]
SIGNAL_KEY = ["setup", "symbol", "session_date", "direction"]
_CUTS = f"""(SELECT symbol, part, d[(len(d) * part + 3) // 4] AS cut, {list(CUT_SLOTS)}[(part - 1) % {len(CUT_SLOTS)} + 1] AS cut_slot
 FROM (SELECT symbol, list_sort(list(DISTINCT session_date)) AS d FROM bars_m GROUP BY symbol), range(1, 5) r(part))"""
_CANDIDATES = """(SELECT c.symbol, c.session_date, coalesce(n.slot, 30) AS slot FROM cand_m c LEFT JOIN (SELECT symbol, session_date, slot,
 row_number() OVER (PARTITION BY symbol, session_date ORDER BY slot) AS pos FROM bars_m) n
 ON n.symbol = c.symbol AND n.session_date = c.session_date AND n.pos = 3)"""


def _truncation_sql(table: str, slot: str) -> str:
    return f"""SELECT 'truncation' AS audit, part, count(t.symbol) AS decisions, 0 AS leaks, NULL::VARCHAR AS first_leaking_field
 FROM {_CUTS} c LEFT JOIN {table} t ON t.symbol = c.symbol AND (t.session_date < cut OR (t.session_date = cut AND t.{slot} <= cut_slot)) GROUP BY part"""


def _poison_sql(table: str, slot: str) -> str:
    return f"""SELECT 'poison' AS audit, count(*) AS decisions, 0 AS leaks, NULL::VARCHAR AS first_leaking_field FROM {table},
 (SELECT max(d) AS start FROM (SELECT max(session_date) AS d FROM bars_m GROUP BY symbol))
 WHERE session_date < start OR (session_date = start AND {slot} < {POISON_SLOT})"""


@query("audit_truncation", "m", _truncation_sql("feat_m", "breakout_slot"))
def audit_truncation(fx):
    cuts = audit.own_cuts(fx.bars, CUT_SLOTS)
    return audit.audit_truncation(_features_of(fx), fx.all_bars, cuts, EVENT_KEY, "breakout_slot", INDEX)


@query("audit_truncation_signals", "m", _truncation_sql("sig_m", "signal_slot"))
def audit_truncation_signals(fx):
    cuts = audit.own_cuts(fx.bars, CUT_SLOTS)
    return audit.audit_truncation(_signals_of(fx), fx.all_bars, cuts, SIGNAL_KEY, "signal_slot", INDEX)


@query("audit_truncation_indicators", "m", _truncation_sql("bars_m", "slot"))
def audit_truncation_indicators(fx):
    return audit.audit_truncation(_indicators_of(fx), fx.bars, audit.own_cuts(fx.bars, CUT_SLOTS), BAR_KEY, "slot")


@query("audit_truncation_detection", "m", _truncation_sql("brk_m", "breakout_slot"))
def audit_truncation_detection(fx):
    return audit.audit_truncation(_detection_of(fx), fx.bars, audit.own_cuts(fx.bars, CUT_SLOTS), EVENT_KEY, "breakout_slot")


@query("audit_truncation_universe", "m", _truncation_sql(_CANDIDATES, "slot"))
def audit_truncation_universe(fx):
    cuts = audit.own_cuts(fx.bars, CUT_SLOTS)
    return audit.audit_truncation(_universe_of(fx), fx.bars, cuts, ["symbol", "session_date"], "decided_slot")


@query("audit_poison", "m", _poison_sql("feat_m", "breakout_slot"))
def audit_poison(fx):
    return audit.audit_poison(_features_of(fx), fx.all_bars, POISON_SLOT, EVENT_KEY, "breakout_slot", INDEX)


@query("audit_poison_signals", "m", _poison_sql("sig_m", "signal_slot"))
def audit_poison_signals(fx):
    return audit.audit_poison(_signals_of(fx), fx.all_bars, POISON_SLOT, SIGNAL_KEY, "signal_slot", INDEX)

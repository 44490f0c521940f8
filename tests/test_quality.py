import datetime

import pytest
from pyspark.sql import functions as F

from rangebreak.functions.frames import InputError, require_none
from rangebreak.operators import calendar as cal
from rangebreak.operators import quality as q
from rangebreak.params import Params
from rangebreak.sources import store
from tests.helpers import DAY, bars, flat_session

P = Params()
LATER = datetime.datetime(2026, 9, 30, 18)


def verdict(spark, rows, fetched=LATER, symbol="AAA", trading=True, order=None):
    table = bars(spark, rows).withColumns(
        {"fetched_at": F.lit(fetched).cast("timestamp_ntz"), "symbol": F.lit(symbol)}
    )
    place = F.col("slot") if order is None else F.when(F.col("slot") == order, 999).otherwise(F.col("slot"))
    table = table.withColumn("ingest_seq", place.cast("bigint")).drop("slot")
    calendar = spark.createDataFrame([(DAY, trading, None)], "session_date date, is_trading_day boolean, prev_trading_day date")
    return q.session_verdicts(table, calendar, P).first()


def changed(slot, **fields):
    names = ("symbol", "session_date", "slot", "ts", "open", "high", "low", "close", "volume")
    rows = [dict(zip(names, r)) for r in flat_session()]
    rows[slot].update(fields)
    return [tuple(r.values()) for r in rows]


def test_clean(spark):
    got = verdict(spark, flat_session())
    assert (got.verdict, got.reasons, got.bar_count, got.missing_slots) == ("CLEAN", [], 75, [])


@pytest.mark.parametrize("slots,expected", [(74, "TAIL_COLLAPSED"), (73, "TAIL_COLLAPSED"), (72, "PARTIAL")])
def test_missing_tail(spark, slots, expected):
    got = verdict(spark, flat_session(slots=slots))
    assert got.verdict == expected and len(got.missing_slots) == 75 - slots


def test_interior_hole_is_partial(spark):
    got = verdict(spark, [r for r in flat_session() if r[2] != 12])
    assert (got.verdict, got.missing_slots) == ("PARTIAL", ["10:15"])


def test_same_day_fetch_drops_the_settling_tail(spark):
    got = verdict(spark, flat_session(), fetched=datetime.datetime(2026, 9, 21, 18))
    assert (got.verdict, got.dropped_tail_bars, got.bar_count) == ("PARTIAL", 2, 73)


@pytest.mark.parametrize(
    "fields,reason",
    [
        ({"close": None}, "missing values"),
        ({"low": 0.0}, "price not positive"),
        ({"low": 100.2}, "low above"),
        ({"high": 99.9}, "high below"),
        ({"volume": -1}, "negative volume"),
        ({"ts": datetime.datetime(2026, 9, 21, 10, 2)}, "off the session grid"),
        ({"ts": datetime.datetime(2026, 9, 22, 9, 45)}, "dated outside"),
    ],
)
def test_each_fault_is_corrupt(spark, fields, reason):
    got = verdict(spark, changed(6, **fields))
    assert got.verdict == "CORRUPT" and any(reason in r for r in got.reasons)


def test_duplicate_order_and_holiday(spark):
    twice = flat_session() + [flat_session()[8]]
    assert any("duplicate" in r for r in verdict(spark, twice).reasons)
    assert any("ascending" in r for r in verdict(spark, flat_session(), order=20).reasons)
    assert verdict(spark, flat_session(), trading=False).verdict == "CORRUPT"


def test_zero_volume_is_suspect_except_for_the_index(spark):
    rows = flat_session(volume=0)
    assert verdict(spark, rows).verdict == "SUSPECT"
    assert verdict(spark, rows, symbol=P.index_symbol).verdict == "CLEAN"


def test_worst_wins_and_reasons_accumulate(spark):
    rows = [r for r in changed(6, volume=-1) if r[2] != 12]
    got = verdict(spark, rows)
    assert got.verdict == "CORRUPT" and len(got.reasons) == 2


def test_daily_rows(spark):
    day = datetime.date(2026, 9, 21)
    rows = [
        ("A", day, 100.0, 101.0, 99.0, 100.0, 1),
        ("A", day + datetime.timedelta(1), 50.0, 51.0, 49.0, 50.0, 1),
        ("A", day + datetime.timedelta(2), 50.0, 51.0, 50.5, 50.0, 1),
        ("A", day + datetime.timedelta(3), 50.0, 51.0, 49.0, None, 1),
        ("A", day + datetime.timedelta(4), 500.0, 501.0, 499.0, 500.0, 1),
        ("A", datetime.date(2026, 9, 30), 1.0, 1.0, 1.0, 1.0, 1),
    ]
    table = spark.createDataFrame(rows, "symbol string, session_date date, open double, high double, low double, close double, volume bigint")
    table = table.withColumn("fetched_at", F.lit(LATER).cast("timestamp_ntz"))
    calendar = table.select("session_date", F.lit(True).alias("is_trading_day"))
    got = [r.verdict for r in q.daily_row_verdicts(table, calendar, P).orderBy("session_date").collect()]
    assert got == ["CLEAN", "SUSPECT", "CORRUPT", "CORRUPT", "CLEAN"]


def test_calendar_rules(spark):
    d = datetime.date
    holidays = spark.createDataFrame([(d(2026, 9, 14), "x"), (d(2026, 10, 2), "y")], "date date, name string")
    dates = spark.createDataFrame([(d(2026, 9, 14),), (d(2026, 9, 15),), (d(2026, 9, 19),), (d(2027, 1, 4),)], "session_date date")
    got = {r.session_date: r.is_trading_day for r in cal.trading_days(dates, holidays).collect()}
    assert got == {d(2026, 9, 14): False, d(2026, 9, 15): True, d(2026, 9, 19): False, d(2027, 1, 4): None}
    with pytest.raises(InputError):
        cal.is_trading_day(dates, holidays)
    span = spark.createDataFrame([(d(2026, 9, 10), d(2026, 9, 16))], "start date, end date")
    assert [r[0].day for r in cal.sessions_between(span, holidays).orderBy("session_date").collect()] == [10, 11, 15, 16]
    table = {r.session_date.day: r.prev_trading_day for r in cal.calendar_table(span, holidays).collect()}
    assert table[15] == d(2026, 9, 11) and table[14] == d(2026, 9, 11)
    bad = spark.createDataFrame([(d(2024, 1, 1), "a"), (d(2024, 1, 1), "b"), (d(2026, 1, 1), "c")], "date date, name string")
    assert cal.holiday_violations(bad).count() == 2
    none = spark.createDataFrame([], "date date")
    assert cal.is_expiry_day(dates, none).where("is_expiry is not null").count() == 0


def test_seal_and_upsert_through_a_store(spark, tmp_path):
    root = str(tmp_path / "bars")
    days = [DAY, DAY + datetime.timedelta(1), DAY + datetime.timedelta(2)]
    first = bars(spark, [r for d in days for r in flat_session(day=d, slots=5)]).withColumn("tier", F.lit("bars"))
    store.write_store(store.stored(first, "5m", P.zone), root)
    sealed = store.scan_research_sealed(spark, root, "5m", P.zone, days[1])
    assert {r.session_date for r in sealed.collect()} == {days[0]}
    assert sealed.orderBy("slot").first().ts == datetime.datetime(2026, 9, 21, 9, 15)
    with pytest.raises(store.HoldoutIsSealed):
        store.scan_holdout(spark, root, "5m", P.zone, days[1])
    assert store.scan_holdout(spark, root, "5m", P.zone, days[1], unsealed=True).count() == 10
    assert store.scan_holdout(spark, root, "5m", P.zone).count() == 0

    new = bars(spark, flat_session(day=days[1], slots=4)).withColumn("tier", F.lit("quarantine"))
    incoming = store.stored(new, "5m", P.zone)
    existing = spark.read.schema(store.STORE_SCHEMA).parquet(root)
    verdicts = spark.createDataFrame([("AAA", days[1], "PARTIAL")], "symbol string, session_date date, verdict string")
    audit = store.upsert_audit(existing, incoming, verdicts).first()
    assert (audit.event, audit.tier, audit.previous_tier, audit.previous_rows, audit["rows"]) == ("replaced", "quarantine", "bars", 5, 4)
    merged = store.merged_months(existing, incoming, verdicts, P.zone)
    # Stopped here, before the write, the store still has the month as it was.
    assert store.scan_bars(spark, root, "5m", P.zone).count() == 15
    assert store.scan_quarantine(spark, root, "5m", P.zone).count() == 0
    with pytest.raises(InputError, match="duplicate session"):
        store.merged_months(existing, incoming, verdicts.unionByName(verdicts), P.zone)
    store.write_store(merged, root)
    assert store.scan_bars(spark, root, "5m", P.zone).count() == 10
    assert store.scan_quarantine(spark, root, "5m", P.zone).count() == 4




VERDICT = "seq int, interval string, symbol string, session_date date, verdict string, bar_count int, reasons array<string>"
TALLY = ", ".join(f"{c} bigint" for c in store.RUN_COUNTS)


def run_record(spark, seq, received):
    tally = spark.createDataFrame([(received,) * len(store.RUN_COUNTS)], TALLY)
    return store.fetch_run(tally, seq, "60m", F.lit(datetime.datetime(2026, 9, 20 + seq, 18)))


def test_one_log_of_verdicts_and_runs(spark, tmp_path):
    """Records of both kinds come back, the last run counts whatever file it lies in, and rejects are told per symbol."""
    path = f"{tmp_path}/log"
    store.append_events(run_record(spark, 5, 7), "fetch_run", path)
    judged = [("B", "PARTIAL"), ("A", "CORRUPT"), ("A", "CLEAN"), ("C", "CLEAN"), ("INDEX", "CORRUPT")]
    rows = [(1, "60m", s, DAY + datetime.timedelta(days=k), v, 3, [f'a "{v}"', "é"]) for k, (s, v) in enumerate(judged)]
    rows += [(2, "60m", "C", DAY + datetime.timedelta(days=3), "SUSPECT", None, None), (3, "1d", "A", DAY, "CORRUPT", 1, [])]
    store.append_events(spark.createDataFrame(rows, VERDICT), "verdict", path)
    store.append_events(run_record(spark, 4, 99), "fetch_run", path)
    spark.createDataFrame([("",), ("  ",)], "value string").write.mode("append").text(path)
    events = store.read_events(spark, path)
    assert store.event_violations(events).count() == 0
    verdicts = store.events_of(events, "verdict")
    assert sorted(map(repr, verdicts.collect())) == sorted(map(repr, spark.createDataFrame(rows, VERDICT).collect()))
    runs = store.events_of(events, "fetch_run")
    summary = q.integrity_summary(
        store.latest_verdict(verdicts, "60m"), store.latest_verdict(verdicts, "1d"), runs, Params(index_symbol="INDEX")
    ).collect()[0]
    assert list(summary.rejected.items()) == [("A", 1), ("B", 1), ("C", 1)]
    assert (summary.sessions_validated, summary.suspect, summary.symbols_with_rejects, summary.daily_corrupt) == (4, 1, 3, 1)
    assert (summary.last_fetch, summary.last_received) == (datetime.datetime(2026, 9, 25, 18), 7)
    nothing = q.integrity_summary(verdicts.limit(0), verdicts.limit(0), runs.limit(0), Params(index_symbol="INDEX")).collect()[0]
    assert (nothing.sessions_validated, nothing.rejected, nothing.last_fetch) == (0, {}, None)


@pytest.mark.parametrize(
    "line, told",
    [('{"event": "holiday", "interval": "1d", "seq": 1}', "unknown kind"), ('{"interval": "1d", "seq": 1}', "unknown kind"),
     ('{"event": "verdict", "seq": 1}', "no interval"), ('{"event": "fetch_run", "interval": "1d"}', "no seq")],
)
def test_log_records_that_stop_a_run(spark, tmp_path, line, told):
    spark.createDataFrame([(line,)], "value string").write.text(f"{tmp_path}/log")
    with pytest.raises(InputError, match=told):
        require_none(store.event_violations(store.read_events(spark, f"{tmp_path}/log")), "event log")


def test_a_broken_log_line_fails_the_read(spark, tmp_path):
    spark.createDataFrame([('{"event": "verd',)], "value string").write.text(f"{tmp_path}/log")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        store.read_events(spark, f"{tmp_path}/log").collect()

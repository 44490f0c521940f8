"""The daily universe on crafted sessions, and signals that read no bar again."""

import datetime
import random

from pyspark.sql import functions as F

from rangebreak.operators.trades import orb_signals
from rangebreak.operators.universe import eligible_pool, opening_rvol, selection_report, stocks_in_play
from rangebreak.params import Params

DAY = datetime.date(2026, 1, 5)
P = Params(
    slots_per_session=6, slot_minutes=60, opening_range_bars=2, bust_cutoff_slot=5, last_entry_slot=4, rvol_lookback=3,
    index_symbol="INDEX", session_start_minute=0,
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_opening_volume_against_plain_python(spark):
    """Gaps in the grid, sessions with one bar or without early ones, and zero volume."""
    rng = random.Random(5)
    rows = [
        (s, DAY + datetime.timedelta(days=d), k, rng.choice([0, 10, 30, 70]))
        for s in "AB"
        for d in range(12)
        for k in sorted(rng.sample(range(6), rng.choice([1, 2, 4, 6])))
    ]
    bars = spark.createDataFrame(rows, "symbol string, session_date date, slot int, volume bigint")
    expected = {}
    for s in "AB":
        days = sorted({d for x, d, _, _ in rows if x == s})
        volumes = {d: {k: v for x, e, k, v in rows if (x, e) == (s, d)} for d in days}
        through = lambda d, slot, of=volumes: sum(v for k, v in of[d].items() if k <= slot)
        for i, d in enumerate(days):
            slots = sorted(volumes[d])
            if len(slots) >= 2:
                base = sum(through(e, slots[1]) for e in days[i - 3 : i]) / 3 if i >= 3 else 0
                expected[s, d] = through(d, slots[1]) / base if base else None
    found = opening_rvol(bars, P)
    assert {(r.symbol, r.session_date): r.opening_rvol for r in found.collect()} == expected
    assert any(v is None for v in expected.values()) and any(v for v in expected.values())
    assert "Join" not in plan_of(found) and "Generate" not in plan_of(found)
    assert opening_rvol(bars.limit(0), P).collect() == []


def test_pool_gives_the_reason_of_the_day_before(spark):
    p = P.with_(min_price=50.0, min_atr_pct=0.0, min_turnover=1000.0, atr_period=1)
    days = [DAY + datetime.timedelta(days=d) for d in range(-1, 3)]
    first = [(s, days[0], 76.0, 78.0, 75.0, 77.0, 1000) for s in ("cheap", "thin", "good")]
    then = [("cheap", 10.0, 1000), ("thin", 100.0, 1), ("good", 100.0, 1000)]
    daily = spark.createDataFrame(
        first + [(s, days[1], c, c + 1, c - 1, c, v) for s, c, v in then],
        "symbol string, session_date date, open double, high double, low double, close double, volume bigint",
    )
    calendar = spark.createDataFrame([(days[k], days[k - 1] if k else None) for k in range(4)], "session_date date, prev_trading_day date")
    sessions = spark.createDataFrame(
        [(s, d) for s in ("cheap", "thin", "good", "new") for d in days[1:]], "symbol string, session_date date"
    )
    rows = {(r.symbol, (r.session_date - DAY).days): r for r in eligible_pool(sessions, daily, calendar, p).collect()}
    # The close of a day is not known on that day itself.
    assert all(rows[s, 0].prior_close == 77.0 for s in ("cheap", "thin", "good"))
    assert rows["new", 0].reasons == rows["new", 2].reasons == ["no prior session"]
    assert rows["cheap", 1].reasons == ["price below 50"] and rows["thin", 1].reasons == ["turnover below 1000"]
    assert rows["good", 1].eligible and rows["good", 1].reasons == [] and rows["good", 1].prior_turnover == 100_000.0
    # The latest close still counts two days later, the true range of exactly the day before is absent.
    assert rows["good", 2].reasons == ["no prior-day ATR"] and rows["good", 2].prior_close == 100.0


def test_heaviest_openings_with_ties_by_symbol(spark):
    p = P.with_(stocks_in_play=2)
    rows = [("B", 2.0, True, []), ("A", 2.0, True, []), ("C", 9.0, False, ["price below 50"]), ("D", None, True, []), ("E", 1.0, True, [])]
    audit = spark.createDataFrame(
        [(s, DAY, r, e, x) for s, r, e, x in rows], "symbol string, session_date date, opening_rvol double, eligible boolean, reasons array<string>"
    )
    assert [(r.symbol, r["rank"]) for r in stocks_in_play(audit, p).orderBy("rank").collect()] == [("A", 1), ("B", 2)]
    report = selection_report(audit, p).first()
    assert (report.n_considered, report.n_eligible, report.n_with_rvol, report.selected) == (5, 4, 3, ["A", "B"])
    assert report.exclusion_counts == {"price": 1}


def test_signals_are_a_projection_of_events(spark):
    events = spark.createDataFrame(
        [("A", DAY, "long", 3, 101.0, 2.0, 100.0), ("A", DAY, "short", 4, 99.0, 2.0, 98.0), ("B", DAY, "short", 2, 97.0, 2.0, 98.0), ("C", DAY, "long", 2, 5.0, 2.0, None)],
        "symbol string, session_date date, direction string, breakout_slot int, breakout_close double, atr double, breakout_vwap double",
    )
    found = orb_signals(events)
    assert sorted((r.symbol, r.direction, r.signal_slot, r.vwap) for r in found.collect()) == [("A", "long", 3, 100.0), ("B", "short", 2, 98.0)]
    assert "Join" not in plan_of(found)
    assert orb_signals(events.where(F.lit(False))).collect() == []

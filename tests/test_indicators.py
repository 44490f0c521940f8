import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangebreak.operators import indicators as ind
from rangebreak.params import Params
from tests.helpers import bars, flat_session

P = Params()


def wilder(daily, n):
    out, value, ranges = [None], None, []
    for (_, h, l, c), (_, _, _, pc) in zip(daily[1:], daily):
        ranges.append(max(h - l, abs(h - pc), abs(l - pc)))
        if len(ranges) == n:
            value = sum(ranges) / n
        elif len(ranges) > n:
            value = (value * (n - 1) + ranges[-1]) / n
        out.append(value)
    return out


@pytest.mark.parametrize("period,rows", [(14, 12_000), (3, 3_000), (1, 40), (2, 2_000)])
def test_atr_equals_the_recursion_on_long_histories(spark, period, rows):
    rng = random.Random(period)
    close, daily = 100.0, []
    for _ in range(rows):
        o = close * (1 + rng.gauss(0, 0.01))
        c = o * (1 + rng.gauss(0, 0.01))
        daily.append((o, max(o, c) * 1.002, min(o, c) * 0.998, c))
        close = c if 5 < c < 5000 else 100.0
    first = datetime.date(1980, 1, 1)
    table = spark.createDataFrame(
        [("A", first + datetime.timedelta(days=i), *row) for i, row in enumerate(daily)],
        "symbol string, session_date date, open double, high double, low double, close double",
    )
    got = [r.atr for r in ind.atr_wilder(table, P.with_(atr_period=period)).orderBy("session_date").collect()]
    want = wilder(daily, period)
    assert [g is None for g in got] == [w is None for w in want]
    worst = max(abs(g / w - 1) for g, w in zip(got, want) if w is not None)
    assert worst < 1e-10


def test_vwap_is_null_without_volume_and_sigma_needs_three_bars(spark):
    rows = flat_session(slots=5, volume=0)
    table = bars(spark, rows)
    assert ind.session_vwap(table).where("vwap is not null").count() == 0
    sigma = [r.sigma for r in ind.session_sigma(table).orderBy("slot").collect()]
    assert sigma[:2] == [None, None] and sigma[2] == 0.0


def test_vwap_and_sigma_by_hand(spark):
    rows = flat_session({0: (10, 12, 9, 11), 1: (11, 13, 10, 12), 2: (12, 14, 11, 10)}, slots=3)
    rows = [(*r[:8], v) for r, v in zip(rows, (100, 200, 300))]
    last = ind.session_vwap(bars(spark, rows)).orderBy(F.desc("slot")).first()
    typical = [(12 + 9 + 11) / 3, (13 + 10 + 12) / 3, (14 + 11 + 10) / 3]
    assert last.vwap == pytest.approx(np.average(typical, weights=[100, 200, 300]))
    sigma = ind.session_sigma(bars(spark, rows)).orderBy(F.desc("slot")).first().sigma
    assert sigma == pytest.approx(np.std([12 / 11 - 1, 10 / 12 - 1], ddof=1))


def history(sessions, missing=()):
    rows = []
    for d in range(sessions):
        day = datetime.date(2026, 1, 1) + datetime.timedelta(days=d)
        for slot in range(6):
            if (d, slot) not in missing:
                rows.append(("A", day, slot, None, 1.0, 1.0, 1.0, 1.0, 100 * (d + 1) + slot))
    return rows


def test_relative_volume_against_a_direct_loop(spark):
    p = P.with_(slots_per_session=6, opening_range_bars=2, bust_cutoff_slot=5, last_entry_slot=4, rvol_lookback=3)
    missing = {(1, 0), (2, 3), (4, 5), (5, 0)}
    rows = history(8, missing)
    table = bars(spark, rows)
    volume = {(r[1], r[2]): r[8] for r in rows}
    days = sorted({r[1] for r in rows})
    at = {(r.session_date, r.slot): r.rvol_at_time for r in ind.rvol_at_time(table, p).collect()}
    bar = {(r.session_date, r.slot): r.rvol_bar for r in ind.rvol_bar(table, p).collect()}
    assert set(at) == set(volume) == set(bar)
    for (day, slot), v in volume.items():
        i = days.index(day)
        if i < 3:
            assert at[day, slot] is None and bar[day, slot] is None
            continue
        past = days[i - 3 : i]
        so_far = sum(volume.get((day, s), 0) for s in range(slot + 1))
        base = sum(volume.get((d, s), 0) for d in past for s in range(slot + 1)) / 3
        assert at[day, slot] == pytest.approx(so_far / base)
        same = sum(volume.get((d, slot), 0) for d in past) / 3
        assert bar[day, slot] == pytest.approx(v / same)


def test_index_state_is_as_of_and_needs_a_complete_range(spark):
    p = P.with_(slots_per_session=8, opening_range_bars=2, bust_cutoff_slot=7, last_entry_slot=6)
    full = flat_session({4: (100, 104, 100, 103)}, slots=8, symbol="I")
    full = [r for r in full if r[2] != 5]
    states = {r.slot: (r.index_up, r.index_down, r.index_close) for r in ind.index_states(bars(spark, full), p).collect()}
    assert states[0][0] is None and states[1] == (0.0, 0.0, 100.0)
    assert states[3][0] == 0.0 and states[4][0] == 1.0
    assert states[5] == (1.0, 0.0, None)  # no bar at that slot, the state still holds
    broken = [r for r in full if r[2] != 1]
    assert ind.index_states(bars(spark, broken), p).where("index_up is not null").count() == 0


def test_gap_and_prior_day_need_the_exact_previous_trading_day(spark):
    days = [datetime.date(2026, 1, 1), datetime.date(2026, 1, 2), datetime.date(2026, 1, 5)]
    rows = [r for d in days for r in flat_session(slots=4, day=d)]
    calendar = spark.createDataFrame(
        [(days[0], True, None), (days[1], True, days[0]), (days[2], True, datetime.date(2026, 1, 3))],
        "session_date date, is_trading_day boolean, prev_trading_day date",
    )
    gaps = {r.session_date: r.gap_pct for r in ind.gap_pct(bars(spark, rows), calendar, P).collect()}
    assert gaps == {days[0]: None, days[1]: 0.0, days[2]: None}

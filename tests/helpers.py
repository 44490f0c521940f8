"""Small crafted inputs."""

from __future__ import annotations

import datetime

DAY = datetime.date(2026, 9, 21)
BAR_SCHEMA = (
    "symbol string, session_date date, slot int, ts timestamp_ntz, open double, high double, "
    "low double, close double, volume bigint"
)


def start_of(day, slot, minutes=5, first=555):
    return datetime.datetime.combine(day, datetime.time()) + datetime.timedelta(minutes=first + slot * minutes)


def flat_session(changes=None, slots=75, day=DAY, symbol="AAA", volume=1000):
    """Opening range [99, 101], flat at 100 after it; ``changes`` maps a slot to (open, high, low, close)."""
    rows = []
    for slot in range(slots):
        o, h, l, c = (100.0, 101.0, 99.0, 100.0) if slot < 3 else (100.0, 100.5, 99.5, 100.0)
        if changes and slot in changes:
            o, h, l, c = changes[slot]
        rows.append((symbol, day, slot, start_of(day, slot), o, h, l, c, volume))
    return rows


def bars(spark, rows):
    real = [(*r[:4], *[None if v is None else float(v) for v in r[4:8]], r[8]) for r in rows]
    return spark.createDataFrame(real, BAR_SCHEMA)

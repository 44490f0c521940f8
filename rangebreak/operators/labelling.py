"""Breakout events and what became of them.

One row per session tells whether any of its closes lies beyond its opening range. Only the bars of
such sessions are sorted: the windows, the paths of both directions and the aggregate to one row per
event run on them and keep their distribution; everything else that moves has one row per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import by_session, in_session, whole_session
from rangebreak.functions.scalars import count_when, direction_sign, ratio
from rangebreak.operators.indicators import atr_prior_day, in_range, session_facts
from rangebreak.params import OUTCOMES, Params

EVENT = ["symbol", "session_date", "direction"]


def mark_first_breaks(bars: DataFrame, p: Params) -> DataFrame:
    """Add the opening range, the slot of the first close beyond it on each side, and the running VWAP.

    All windows share one distribution and order, so the running sums move and sort nothing more.
    """
    whole, so_far = whole_session(), in_session()
    opening = in_range(p)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    ranged = bars.withColumns(
        {
            "pos": F.row_number().over(W.partitionBy("symbol", "session_date").orderBy("slot")) - 1,
            "or_bars": count_when(opening).over(whole),
            "or_high": F.max(F.when(opening, F.col("high"))).over(whole),
            "or_low": F.min(F.when(opening, F.col("low"))).over(whole),
            "vwap": ratio(F.sum(typical * F.col("volume")).over(so_far), F.sum("volume").over(so_far)),
        }
    )
    can_break = (F.col("slot") >= p.opening_range_bars) & (F.col("or_bars") == p.opening_range_bars)

    def first(beyond: Column) -> Column:
        return F.min(F.when(can_break & beyond, F.col("slot"))).over(whole)

    return ranged.withColumns(
        {
            "long_slot": first(F.col("close") > F.col("or_high")),
            "short_slot": first(F.col("close") < F.col("or_low")),
        }
    )


def detect_breakouts(bars: DataFrame, p: Params) -> DataFrame:
    """First close beyond the opening range, per direction and session. A touch is not a break."""
    opening = in_range(p)
    marked = bars.withColumns(
        {
            "or_bars": count_when(opening).over(whole_session()),
            "or_high": F.max(F.when(opening, F.col("high"))).over(whole_session()),
            "or_low": F.min(F.when(opening, F.col("low"))).over(whole_session()),
        }
    )
    after = F.col("slot") >= p.opening_range_bars
    first = marked.where(f"or_bars = {p.opening_range_bars}").groupBy("symbol", "session_date").agg(
        F.first("or_high").alias("or_high"),
        F.first("or_low").alias("or_low"),
        F.min(F.when(after & (F.col("close") > F.col("or_high")), F.col("slot"))).alias("long"),
        F.min(F.when(after & (F.col("close") < F.col("or_low")), F.col("slot"))).alias("short"),
    )
    sides = F.array(
        *[F.struct(F.lit(d).alias("direction"), F.col(d).alias("breakout_slot")) for d in ("long", "short")]
    )
    return (
        first.select("symbol", "session_date", "or_high", "or_low", F.inline(sides))
        .where("breakout_slot is not null")
    )


def settle(path: DataFrame, p: Params, carry: tuple[str, ...] = ()) -> DataFrame:
    """Resolve events from their paths: one row per event and bar from the breakout bar on.

    A path holds ``slot, high, low, close`` next to the event's ``direction, breakout_slot, or_high,
    or_low, atr`` and the columns to carry. The bar of the breakout itself gives the bar columns.
    """
    long = F.col("direction") == "long"
    sign = direction_sign(F.col("direction"))
    boundary = F.when(long, F.col("or_high")).otherwise(F.col("or_low"))
    far_side = F.when(long, F.col("or_low")).otherwise(F.col("or_high"))
    extreme = F.when(long, F.col("high")).otherwise(F.col("low"))
    running = W.partitionBy(*EVENT).orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    walked = path.withColumn(
        "ext", F.max(F.greatest(sign * (extreme - boundary), F.lit(0.0))).over(running)
    )
    sustained = F.col("ext") >= p.sustain_atr * F.col("atr")
    busted = (
        (sign * (F.col("close") - far_side) < 0)
        & (F.col("slot") < p.bust_cutoff_slot)
        & (F.col("ext") < p.bust_atr * F.col("atr"))
    )
    here = F.col("slot") == F.col("breakout_slot")
    settled = walked.groupBy(*EVENT).agg(
        *[F.max(c).alias(c) for c in ("breakout_slot", "or_high", "or_low", "atr")],
        F.min(F.when(sustained, F.col("slot"))).alias("sustain_slot"),
        F.min(F.when(busted, F.col("slot"))).alias("bust_slot"),
        F.max("ext").alias("max_ext"),
        *[F.max(F.when(here, F.col(c))).alias(c) for c in carry],
    )
    # The extension is looked at before the close of the same bar.
    first = F.col("sustain_slot").isNotNull() & (
        F.col("bust_slot").isNull() | (F.col("sustain_slot") <= F.col("bust_slot"))
    )
    return settled.withColumns(
        {
            "label": F.when(first, F.lit("SUSTAINED"))
            .when(F.col("bust_slot").isNotNull(), F.lit("BUSTED"))
            .otherwise(F.lit("NEITHER")),
            "resolved_slot": F.when(first, F.col("sustain_slot")).otherwise(F.col("bust_slot")),
            "max_extension_atr": F.col("max_ext") / F.col("atr"),
        }
    ).drop("sustain_slot", "bust_slot", "max_ext")


def session_table(bars: DataFrame, daily: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """One row per session: its facts, the day before, and where it starts in its symbol's history.

    Partial aggregation shrinks the bars to sessions before anything is shuffled; the windows over a
    symbol then run on one row per session. ``breaks`` tells whether a close after a whole opening range
    lies beyond it.
    """
    later = F.when(F.col("slot") >= p.opening_range_bars, F.col("close"))
    closes = (F.max(later).alias("highest_close"), F.min(later).alias("lowest_close"))
    facts = atr_prior_day(session_facts(bars, p, *closes), daily, calendar, p)
    earlier = by_session().rowsBetween(W.unboundedPreceding, -1)
    beyond = (F.col("highest_close") > F.col("or_high")) | (F.col("lowest_close") < F.col("or_low"))
    return facts.withColumns(
        {
            "session_start": F.coalesce(F.sum("n_bars").over(earlier), F.lit(0)).cast("bigint"),
            "breaks": F.coalesce(F.col("or_valid") & beyond, F.lit(False)),
        }
    ).drop("highest_close", "lowest_close")


def breaking_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with a breakout that can be labelled: those without a prior-day ATR are left out."""
    return sessions.where("breaks and atr is not null")


_BAR = ("pos", "ts", "open", "high", "low", "close", "volume", "vwap", "session_start")


def breakout_events(bars: DataFrame, sessions: DataFrame, p: Params) -> DataFrame:
    """One labelled row per breakout. Sessions without a prior-day ATR are left out."""
    sides = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("slot") >= F.col(f"{d}_slot"),
                    F.struct(F.lit(d).alias("direction"), F.col(f"{d}_slot").alias("breakout_slot")),
                )
                for d in ("long", "short")
            ]
        )
    )
    # Whole sessions without a breakout end before the windows. The few others are the side to hash, so the
    # bars are not sorted for the join.
    known = breaking_sessions(sessions).select("symbol", "session_date", "atr", "session_start")
    kept = bars.join(known.hint("shuffle_hash"), ["symbol", "session_date"])
    # Bars before a session's first breakout end here.
    path = mark_first_breaks(kept, p).select(
        "symbol",
        "session_date",
        "slot",
        "pos",
        "ts",
        "open",
        "high",
        "low",
        "close",
        "volume",
        "vwap",
        "or_high",
        "or_low",
        "atr",
        "session_start",
        F.inline(sides),
    )
    settled = settle(path, p, _BAR)
    return settled.select(
        *EVENT,
        "breakout_slot",
        (F.col("session_start") + F.col("pos")).alias("breakout_index"),
        F.col("ts").alias("breakout_time"),
        (F.col("breakout_slot") * p.slot_minutes).alias("minutes_since_open"),
        "or_high",
        "or_low",
        (F.col("or_high") - F.col("or_low")).alias("or_width"),
        F.col("close").alias("breakout_close"),
        "atr",
        "label",
        "resolved_slot",
        "max_extension_atr",
        F.col("open").alias("breakout_open"),
        F.col("high").alias("breakout_high"),
        F.col("low").alias("breakout_low"),
        F.col("volume").alias("breakout_volume"),
        F.col("vwap").alias("breakout_vwap"),
    )


EVENT_COLUMNS = (
    "symbol",
    "session_date",
    "direction",
    "breakout_slot",
    "breakout_index",
    "breakout_time",
    "minutes_since_open",
    "or_high",
    "or_low",
    "or_width",
    "breakout_close",
    "atr",
    "label",
    "resolved_slot",
    "max_extension_atr",
)


def label_sessions(bars: DataFrame, daily: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """The breakout event table. The index is looked at but never traded."""
    traded = bars.where(F.col("symbol") != p.index_symbol)
    sessions = session_table(traded, daily, calendar, p)
    return breakout_events(traded, sessions, p).select(*EVENT_COLUMNS)


def label_violations(events: DataFrame) -> DataFrame:
    """Events that no label may be given: a range without width or an ATR that is not positive."""
    return events.where((F.col("or_width") <= 0) | (F.col("atr") <= 0)).select(
        "symbol", "session_date", "direction", "or_width", "atr"
    )


def resolve_breakouts(events: DataFrame, bars: DataFrame, p: Params) -> DataFrame:
    """Walk given events forward over their session's bars.

    ``events`` needs keys, ``breakout_slot``, ``or_high``, ``or_low`` and ``atr``. The join is an
    equi-join on the session with the slot order as a residual, so it never becomes a nested loop.
    """
    e, b = events.alias("e"), bars.alias("b")
    path = e.join(
        b,
        (F.col("e.symbol") == F.col("b.symbol"))
        & (F.col("e.session_date") == F.col("b.session_date"))
        & (F.col("b.slot") >= F.col("e.breakout_slot")),
    ).select(
        *[f"e.{c}" for c in (*EVENT, "breakout_slot", "or_high", "or_low", "atr")],
        *[f"b.{c}" for c in ("slot", "high", "low", "close")],
    )
    return settle(path, p).select(*EVENT, "breakout_slot", "label", "resolved_slot", "max_extension_atr")


def skipped_sessions(bars: DataFrame, daily: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """Sessions without a prior-day ATR, counted per symbol, never given a default."""
    sessions = bars.where(F.col("symbol") != p.index_symbol).select("symbol", "session_date").distinct()
    return (
        atr_prior_day(sessions, daily, calendar, p)
        .groupBy("symbol")
        .agg(count_when(F.col("atr").isNull()).alias("skipped_sessions"))
        .where("skipped_sessions > 0")
    )


def base_rates(events: DataFrame) -> DataFrame:
    """Counts and percentages of the three outcomes, overall and by month."""
    months = events.select(F.date_format("session_date", "yyyy-MM").alias("month"), "label")
    counted = months.groupingSets([["month"], []], "month").agg(
        F.grouping("month").alias("overall"),
        *[count_when(F.col("label") == o).alias(o.lower()) for o in OUTCOMES],
        F.count("*").alias("n"),
    )
    return counted.where("n > 0").select(
        F.when(F.col("overall") == 1, F.lit("all")).otherwise(F.col("month")).alias("month"),
        *[F.col(o.lower()) for o in OUTCOMES],
        "n",
        # Half-even rounding to one place, as in the published tables.
        *[F.bround(F.col(o.lower()) / F.col("n") * 100, 1).alias(f"{o.lower()}_pct") for o in OUTCOMES],
    )

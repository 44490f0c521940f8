"""The twelve columns known at the close of the breakout bar.

Session-level values (gap, opening volume, prior-day ATR) are computed on one row per session and
ride along with the event; only the same-slot volume and the index need joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangebreak.functions.frames import by_session, write_stage
from rangebreak.functions.scalars import direction_sign, ratio
from rangebreak.operators.calendar import is_expiry_day
from rangebreak.operators.indicators import (
    gap_column,
    index_session_open,
    index_states,
    rvol_open_column,
)
from rangebreak.operators.labelling import breakout_events, breaking_sessions, session_table
from rangebreak.params import ALL_FEATURES, Params

EVENT_KEY = ["symbol", "session_date", "direction"]


def breakout_context(bars: DataFrame, daily: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """Labelled breakouts with the session-level facts that the features are made from.

    The sessions that break out are written: the windows over all sessions then run once, and a join meets the
    few rows by their known size.
    """
    traded = bars.where(F.col("symbol") != p.index_symbol)
    sessions = session_table(traded, daily, calendar, p)
    trailing = by_session().rowsBetween(-p.rvol_lookback, -1)
    facts = sessions.select(
        "symbol",
        "session_date",
        "atr",
        "session_start",
        "breaks",
        "session_open",
        "prev_open",
        "prev_close",
        rvol_open_column(p).alias("rvol_open_15m"),
        gap_column().alias("gap_pct"),
        F.collect_list("session_date").over(trailing).alias("earlier_sessions"),
    )
    breaking = write_stage(breaking_sessions(facts), "breaking-sessions", reuse=True)
    return breakout_events(traded, breaking, p).join(
        breaking.drop("atr", "session_start", "breaks"), ["symbol", "session_date"]
    )


def _same_slot_volume(events: DataFrame, bars: DataFrame, p: Params) -> DataFrame:
    """Volume of the breakout bar against the same slot of the trailing sessions.

    Each event asks for a fixed number of earlier bars by key, which moves far less than a window
    over every bar of every symbol and slot would.
    """
    wanted = events.where(F.size("earlier_sessions") == p.rvol_lookback).select(
        *EVENT_KEY,
        F.col("breakout_slot").alias("slot"),
        F.explode("earlier_sessions").alias("earlier"),
    )
    volumes = bars.select("symbol", F.col("session_date").alias("earlier"), "slot", "volume")
    base = (
        wanted.hint("shuffle_hash").join(volumes, ["symbol", "earlier", "slot"])
        .groupBy(*EVENT_KEY)
        .agg((F.sum("volume") / p.rvol_lookback).alias("slot_base"))
    )
    return events.join(base, EVENT_KEY, "left").withColumn(
        "rvol_breakout_bar", ratio(F.col("breakout_volume"), F.col("slot_base"))
    )


def feature_columns(
    events: DataFrame,
    bars: DataFrame,
    index_bars: DataFrame,
    expiries: DataFrame,
    p: Params,
    only: tuple[str, ...] = ALL_FEATURES,
    index_key: tuple[str, ...] = ("session_date",),
) -> DataFrame:
    """Breakout keys, outcome and the requested features; joins nothing that is not asked for.

    ``index_key`` names the columns of events and index that tell index sessions apart.
    """
    rows = events
    sign = direction_sign(F.col("direction"))
    long = F.col("direction") == "long"
    close = F.col("breakout_close")
    atr = F.when(F.col("atr") > 0, F.col("atr"))
    spread = F.col("breakout_high") - F.col("breakout_low")
    start = F.col("session_open")
    boundary = F.when(long, F.col("or_high")).otherwise(F.col("or_low"))
    if "rvol_breakout_bar" in only:
        rows = _same_slot_volume(rows, bars, p)
    if {"rel_strength_vs_index", "index_or_agrees"} & set(only):
        at = index_states(index_bars, p, index_key).withColumnRenamed("slot", "breakout_slot")
        rows = rows.join(at, [*index_key, "breakout_slot"], "left")
    if "rel_strength_vs_index" in only:
        rows = rows.join(index_session_open(index_bars, index_key), list(index_key), "left")
    if "is_expiry_day" in only:
        rows = is_expiry_day(rows, expiries)
    # The gap in price is derived from the gap in percent, so there is one previous close.
    gap_price = start - start / (1 + F.col("gap_pct") / 100)
    definitions = {
        "rvol_open_15m": lambda: F.col("rvol_open_15m"),
        "rvol_breakout_bar": lambda: F.col("rvol_breakout_bar"),
        "bar_body_ratio": lambda: ratio(F.abs(close - F.col("breakout_open")), spread),
        "rel_strength_vs_index": lambda: F.when(
            (F.col("index_open") > 0) & (start > 0),
            sign * ((close / start - 1) - (F.col("index_close") / F.col("index_open") - 1)) * 100,
        ),
        "index_or_agrees": lambda: F.when(long, F.col("index_up")).otherwise(F.col("index_down")),
        "gap_atr_signed": lambda: sign * gap_price / atr,
        "prior_day_return_atr_signed": lambda: sign * (F.col("prev_close") - F.col("prev_open")) / atr,
        "is_expiry_day": lambda: F.col("is_expiry").cast("int").cast("double"),
        "or_width_atr": lambda: F.col("or_width") / atr,
        "minutes_since_open": lambda: F.col("minutes_since_open").cast("double"),
        "day_of_week": lambda: F.weekday("session_date").cast("double"),
        "breakout_depth_atr": lambda: F.abs(close - boundary) / atr,
    }
    return rows.select(
        *EVENT_KEY,
        "breakout_slot",
        "breakout_index",
        "breakout_time",
        "label",
        "max_extension_atr",
        *[definitions[name]().alias(name) for name in ALL_FEATURES if name in only],
    )


def feature_table(
    events: DataFrame, bars: DataFrame, index_bars: DataFrame, expiries: DataFrame, p: Params
) -> DataFrame:
    return feature_columns(events, bars, index_bars, expiries, p)


def feature_violations(events: DataFrame, bars: DataFrame, index_bars: DataFrame, p: Params) -> DataFrame:
    """Events whose bar is gone, or whose time or minutes disagree with it; and an absent index."""
    at = bars.select(
        "symbol", "session_date", F.col("slot").alias("breakout_slot"), F.col("ts").alias("bar_time")
    )
    moved = (
        events.hint("shuffle_hash").join(at, ["symbol", "session_date", "breakout_slot"], "left")
        .where(
            ~F.col("bar_time").eqNullSafe(F.col("breakout_time"))
            | (F.col("minutes_since_open") != F.col("breakout_slot") * p.slot_minutes)
        )
        .select(F.concat_ws(" ", *EVENT_KEY, F.lit("no longer points at its bar")).alias("violation"))
    )
    absent = index_bars.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit("the index has no bars").alias("violation")
    )
    return moved.unionByName(absent)

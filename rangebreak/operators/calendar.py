"""Trading calendars, expiry calendars and the session grid.

A calendar is a table ``session_date, is_trading_day, prev_trading_day`` with one row per date, so
its size is bounded by the number of dates it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import require_none
from rangebreak.functions.scalars import clock
from rangebreak.params import Params


def coverage(holidays: DataFrame) -> DataFrame:
    """First and last calendar year the holiday table speaks for, in one row."""
    return holidays.agg(
        F.min(F.year("date")).alias("first_year"),
        F.max(F.year("date")).alias("last_year"),
        F.count_distinct(F.year("date")).alias("years"),
    )


def holiday_violations(holidays: DataFrame) -> DataFrame:
    """Duplicate holiday dates, gaps between covered years, and an empty table."""
    duplicates = (
        holidays.groupBy("date").count().where("count > 1").select(
            F.concat(F.lit("duplicate holiday "), F.col("date").cast("string")).alias("violation")
        )
    )
    years = coverage(holidays)
    gaps = years.where("last_year - first_year + 1 <> years").select(
        F.lit("holiday years are not contiguous").alias("violation")
    )
    empty = years.where("years = 0").select(F.lit("holiday calendar is empty").alias("violation"))
    return duplicates.unionByName(gaps).unionByName(empty)


def trading_days(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """Mark each date: weekday and not a holiday; NULL outside the covered years."""
    named = holidays.select(F.col("date").alias("session_date"), F.col("name").alias("holiday_name"))
    inside = F.year("session_date").between(F.col("first_year"), F.col("last_year"))
    return (
        dates.join(named, "session_date", "left")
        .join(F.broadcast(coverage(holidays)))  # one row
        .select(
            *dates.columns,
            F.when(inside, (F.weekday("session_date") < 5) & F.col("holiday_name").isNull()).alias(
                "is_trading_day"
            ),
            F.when(inside, F.col("holiday_name")).alias("holiday_name"),
        )
    )


def is_trading_day(dates: DataFrame, holidays: DataFrame, strict: bool = True) -> DataFrame:
    """As ``trading_days``; with ``strict`` a date outside coverage is an error."""
    marked = trading_days(dates, holidays)
    if strict:
        require_none(
            marked.where("is_trading_day is null"), "date outside the holiday calendar coverage"
        )
    return marked


def date_range(bounds: DataFrame) -> DataFrame:
    """One row per date between ``start`` and ``end`` of a one-row table, both included."""
    return bounds.where("start <= end").select(
        F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("session_date")
    )


def sessions_between(bounds: DataFrame, holidays: DataFrame, strict: bool = False) -> DataFrame:
    if strict:
        require_none(bounds.where("start > end"), "start is after end")
    return (
        is_trading_day(date_range(bounds), holidays, strict).where("is_trading_day").select("session_date")
    )


def calendar_table(bounds: DataFrame, holidays: DataFrame) -> DataFrame:
    """The calendar for every date of a range, with the trading day strictly before each."""
    # A window over dates alone: the table holds one row per calendar date.
    earlier = W.orderBy("session_date").rowsBetween(W.unboundedPreceding, -1)
    return trading_days(date_range(bounds), holidays).select(
        "session_date",
        "is_trading_day",
        F.last(F.when(F.col("is_trading_day"), F.col("session_date")), ignorenulls=True)
        .over(earlier)
        .alias("prev_trading_day"),
    )


def is_expiry_day(dates: DataFrame, expiries: DataFrame) -> DataFrame:
    """True or false between the first and last listed expiry, NULL elsewhere."""
    listed = expiries.select(F.col("date").alias("session_date"), F.lit(True).alias("listed")).distinct()
    span = expiries.agg(F.min("date").alias("first_expiry"), F.max("date").alias("last_expiry"))
    return (
        dates.join(listed, "session_date", "left")
        .join(F.broadcast(span))  # one row
        .select(
            *dates.columns,
            F.when(
                F.col("session_date").between(F.col("first_expiry"), F.col("last_expiry")),
                F.col("listed").isNotNull(),
            ).alias("is_expiry"),
        )
    )


def slot_grid(sessions: DataFrame, p: Params) -> DataFrame:
    """Expected bars of each session: every slot with its start time of day."""
    return sessions.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(p.slots_per_session - 1))).alias("slot")
    ).withColumn("slot_time", clock(F.col("slot"), p.session_start_minute, p.slot_minutes))


def sessionize(bars: DataFrame) -> DataFrame:
    """Position of each bar in its session and in its symbol's whole history.

    The history position is the size of the earlier sessions plus the position in this one, so the
    window over a symbol runs on one row per session and never on all its bars.
    """
    sizes = bars.groupBy("symbol", "session_date").agg(F.count("*").alias("n_bars"))
    earlier = W.partitionBy("symbol").orderBy("session_date").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "symbol",
        "session_date",
        "n_bars",
        F.coalesce(F.sum("n_bars").over(earlier), F.lit(0)).alias("session_start"),
    )
    order = W.partitionBy("symbol", "session_date").orderBy("slot")
    return (
        bars.withColumn("pos", (F.row_number().over(order) - 1).cast("bigint"))
        .join(starts, ["symbol", "session_date"])
        .withColumn("bar_index", F.col("session_start") + F.col("pos"))
    )


def time_buckets(bars: DataFrame, p: Params) -> DataFrame:
    """Minutes since the open, weekday from Monday = 0, half hour and month of each bar."""
    minute = F.lit(p.session_start_minute) + F.col("slot") * p.slot_minutes
    half_hour = (F.floor(minute / 30) * 30).cast("int")
    return bars.select(
        *bars.columns,
        (F.col("slot") * p.slot_minutes).alias("minutes_since_open"),
        F.weekday("session_date").alias("day_of_week"),
        half_hour_text(half_hour).alias("half_hour"),
        F.date_format("session_date", "yyyy-MM").alias("month"),
    )


def half_hour_text(minute):
    return F.format_string(
        "%02d:%02d", F.floor(minute / 60).cast("int"), F.pmod(minute, F.lit(60)).cast("int")
    )

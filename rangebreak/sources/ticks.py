"""Roll trades up to bars, and bars up to an index or to daily rows.

Every aggregate buffer is a fixed-width primitive, so Spark uses hash aggregation with a map-side
combine: a bar that receives a third of all trades still shuffles one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ticks_to_bars(ticks: DataFrame) -> DataFrame:
    """``ticks``: symbol, session_date, slot, ts, price, quantity and a unique ordering ``seq``."""
    return ticks.groupBy("symbol", "session_date", "slot").agg(
        F.min("ts").alias("ts"),
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("quantity").cast("bigint").alias("volume"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def pooled_index(bars: DataFrame, symbol: str) -> DataFrame:
    """All symbols pooled into one series without volume, from their bars rather than their trades."""
    return bars.groupBy("session_date", "slot").agg(
        F.lit(symbol).alias("symbol"),
        F.min("ts").alias("ts"),
        F.min_by("open", "first_seq").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_seq").alias("close"),
        F.lit(0).cast("bigint").alias("volume"),
    )


def daily_rows(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "session_date").agg(
        F.min_by("open", "slot").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "slot").alias("close"),
        F.sum("volume").alias("volume"),
    )

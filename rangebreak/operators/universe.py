"""Which symbols to trade, chosen anew for each session from what was known by then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.scalars import count_when, ratio
from rangebreak.operators.indicators import atr_prior_day
from rangebreak.params import Params

SESSION = ["symbol", "session_date"]


def last_before(sessions: DataFrame, rows: DataFrame, values: list[str]) -> DataFrame:
    """As-of join: the latest row of the same symbol strictly before each session date.

    Both sides have one row per symbol and date, so the window is bounded by the calendar.
    """
    payload = F.struct("session_date", *values)
    known = rows.select(*SESSION, payload.alias("known"), F.lit(False).alias("asks"))
    asks = sessions.select(*SESSION, F.lit(None).cast(known.schema["known"].dataType).alias("known"), F.lit(True).alias("asks"))
    # Rows of the same date sort after the question, so they are not seen by it.
    seen = (
        W.partitionBy("symbol")
        .orderBy("session_date", F.desc("asks"))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        known.unionByName(asks)
        .withColumn("known", F.last("known", ignorenulls=True).over(seen))
        .where("asks")
        .select(*SESSION, *[F.col(f"known.{v}").alias(v) for v in values])
    )


def candidates(bars: DataFrame) -> DataFrame:
    """Every symbol on every session date: all of them are considered each day."""
    dates = bars.agg(F.collect_set("session_date").alias("dates"))  # bounded by the calendar
    return (
        bars.select("symbol")
        .distinct()
        .join(F.broadcast(dates))
        .select("symbol", F.explode("dates").alias("session_date"))
    )


def eligible_pool(sessions: DataFrame, daily: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """Price, volatility and turnover of the day before, and why a symbol is out."""
    prior = last_before(
        sessions,
        daily.select(*SESSION, F.col("close").alias("prior_close"), F.col("volume").alias("prior_volume")),
        ["prior_close", "prior_volume"],
    )
    # The ATR is calendar-exact even though the close is the latest one available.
    rows = atr_prior_day(prior, daily, calendar, p).withColumn(
        "prior_turnover", F.col("prior_close") * F.col("prior_volume")
    )
    atr_pct = F.when(F.col("prior_close") > 0, F.col("atr") / F.col("prior_close") * 100)
    known = F.col("prior_close").isNotNull()
    usable_atr = F.coalesce(F.col("atr") > 0, F.lit(False))
    reasons = F.when(
        known,
        F.array_compact(
            F.array(
                F.when(F.col("prior_close") < p.min_price, F.lit(f"price below {p.min_price:g}")),
                F.when(~usable_atr, F.lit("no prior-day ATR")).when(
                    F.col("atr") / F.col("prior_close") * 100 < p.min_atr_pct,
                    F.lit(f"ATR below {p.min_atr_pct:g}%"),
                ),
                F.when(
                    F.col("prior_turnover") < p.min_turnover,
                    F.lit(f"turnover below {p.min_turnover:g}"),
                ),
            )
        ),
    ).otherwise(F.array(F.lit("no prior session")))
    return rows.withColumn("reasons", reasons).select(
        *SESSION,
        "prior_close",
        F.when(known, F.col("atr")).alias("prior_atr"),
        F.when(known, atr_pct).alias("atr_pct"),
        "prior_turnover",
        (F.size("reasons") == 0).alias("eligible"),
        "reasons",
    )


def opening_rvol(bars: DataFrame, p: Params) -> DataFrame:
    """Relative volume at the nth bar of each session; absent while there is no nth bar.

    One row per session holds its volumes by slot, at most as many as the grid has. The base adds up those of
    the sessions before it through the same slot, so no bar is moved or windowed beyond its own session.
    """
    bar = F.struct("slot", "volume")
    sessions = bars.groupBy(*SESSION).agg(F.array_sort(F.collect_list(bar)).alias("profile"))
    trailing = W.partitionBy("symbol").orderBy("session_date").rowsBetween(-p.rvol_lookback, -1)
    nth = F.get("profile", p.opening_range_bars - 1)["slot"]

    def through(profile: Column) -> Column:
        return F.aggregate(
            profile, F.lit(0).cast("bigint"), lambda total, b: total + F.when(b["slot"] <= F.col("slot"), b["volume"]).otherwise(0)
        )

    base = F.aggregate("earlier", F.lit(0).cast("bigint"), lambda total, profile: total + through(profile)) / p.rvol_lookback
    return (
        sessions.withColumns({"slot": nth, "earlier": F.collect_list("profile").over(trailing)})
        .where(F.col("slot").isNotNull())
        .select(
            *SESSION,
            F.when(F.size("earlier") == p.rvol_lookback, ratio(through(F.col("profile")), base)).alias("opening_rvol"),
        )
    )


def candidate_audit(bars: DataFrame, daily: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """Every candidate with its numbers; symbols without any daily row are marked as such."""
    everyone = candidates(bars)
    with_daily = daily.select("symbol").distinct()
    judged = eligible_pool(everyone.join(with_daily, "symbol", "left_semi"), daily, calendar, p)
    unknown = everyone.join(with_daily, "symbol", "left_anti").select(
        *SESSION, F.lit(False).alias("eligible"), F.array(F.lit("no daily bars")).alias("reasons")
    )
    return judged.unionByName(unknown, allowMissingColumns=True).join(
        opening_rvol(bars, p), SESSION, "left"
    )


def _ranked(audit: DataFrame) -> DataFrame:
    order = W.partitionBy("session_date").orderBy(F.desc("opening_rvol"), "symbol")
    usable = audit.where(F.col("eligible") & F.col("opening_rvol").isNotNull())
    return usable.withColumn("rank", F.row_number().over(order))


def stocks_in_play(audit: DataFrame, p: Params) -> DataFrame:
    """The heaviest openings of each session, up to the day's size.

    The rank filter lets Spark keep only the top rows of each map task before the shuffle.
    """
    return _ranked(audit).where(F.col("rank") <= p.stocks_in_play)


def exclusion_head(reasons: Column) -> Column:
    first = F.element_at(reasons, 1)
    return F.when(first == "no daily bars", first).otherwise(F.element_at(F.split(first, " "), 1))


def selection_report(audit: DataFrame, p: Params) -> DataFrame:
    """Per session: how many were considered, eligible and usable, who was chosen, and why others not."""
    usable = F.col("eligible") & F.col("opening_rvol").isNotNull()
    sizes = audit.groupBy("session_date").agg(
        F.count("*").alias("n_considered"),
        count_when(F.col("eligible")).alias("n_eligible"),
        count_when(usable).alias("n_with_rvol"),
    )
    chosen = (
        stocks_in_play(audit, p)
        .groupBy("session_date")
        # At most `stocks_in_play` entries.
        .agg(F.array_sort(F.collect_list(F.struct("rank", "symbol"))).alias("picks"))
        .select("session_date", F.transform("picks", lambda x: x["symbol"]).alias("selected"))
    )
    excluded = (
        audit.where(F.size("reasons") > 0)
        .withColumn("head", exclusion_head(F.col("reasons")))
        .groupBy("session_date", "head")
        .agg(F.count("*").alias("n"))
        .groupBy("session_date")
        # A handful of kinds of reason.
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("head", "n")))).alias(
                "exclusion_counts"
            )
        )
    )
    return (
        sizes.join(chosen, "session_date", "left")
        .join(excluded, "session_date", "left")
        .withColumn("selected", F.coalesce("selected", F.array().cast("array<string>")))
    )

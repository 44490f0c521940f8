"""Session and daily-row verdicts, tier routing and the tallies over them.

Input bars are as delivered: ``symbol, session_date, ts, open, high, low, close, volume,
ingest_seq, fetched_at``, where ``session_date`` is the session a bar is filed under. One exchange by
(symbol, session_date) serves every check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import by_session
from rangebreak.functions.scalars import clock, count_when
from rangebreak.params import RESEARCH_VERDICTS, VERDICTS, Params

SESSION = ["symbol", "session_date"]
PRICES = ("open", "high", "low", "close")


def grid_slot(ts: Column, p: Params) -> Column:
    """Slot of a bar start, NULL when the time of day is not on the session grid."""
    offset = F.hour(ts) * 60 + F.minute(ts) - p.session_start_minute
    exact = (F.second(ts) == 0) & (F.pmod(offset, F.lit(p.slot_minutes)) == 0)
    inside = (offset >= 0) & (offset < p.slot_minutes * p.slots_per_session)
    return F.when(exact & inside, F.floor(offset / p.slot_minutes).cast("int"))


def drop_settling_tail(bars: DataFrame, p: Params) -> DataFrame:
    """Drop the last bars of a session fetched on its own date; ``dropped_tail_bars`` says how many."""
    session = W.partitionBy(*SESSION)
    same_day = F.col("session_date") == F.to_date("fetched_at")
    marked = bars.withColumns(
        {
            "from_end": F.row_number().over(session.orderBy(F.desc("ts"), F.desc("ingest_seq"))),
            "delivered": F.count("*").over(session),
        }
    )
    dropped = F.when(same_day, F.least(F.lit(p.settling_tail_bars), F.col("delivered"))).otherwise(0)
    return (
        marked.withColumn("dropped_tail_bars", dropped.cast("int"))
        .where(F.col("from_end") > F.col("dropped_tail_bars"))
        .drop("from_end", "delivered")
    )


def session_checks(bars: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """Every check of every session in one row, before they are combined."""
    session = W.partitionBy(*SESSION)
    delivered = session.orderBy("ingest_seq")
    in_time = session.orderBy("ts", "ingest_seq")
    slot = grid_slot(F.col("ts"), p)
    kept = drop_settling_tail(bars, p).withColumns(
        {
            "grid_slot": slot,
            "backward": F.lag("ts").over(delivered) > F.col("ts"),
            "repeated": F.lag("ts").over(in_time) == F.col("ts"),
        }
    )
    any_null = F.greatest(
        *[F.col(c).isNull().cast("int") for c in (*PRICES, "volume")]
    ) == F.lit(1)
    lowest = F.least(*PRICES)
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    checks = kept.groupBy(*SESSION).agg(
        F.count("*").alias("bar_count"),
        F.max("dropped_tail_bars").alias("dropped_tail_bars"),
        F.max("fetched_at").alias("fetched_at"),
        count_when(F.col("backward")).alias("backward_bars"),
        count_when(F.col("repeated")).alias("repeated_bars"),
        count_when(F.to_date("ts") != F.col("session_date")).alias("wrong_date_bars"),
        count_when(F.col("grid_slot").isNull()).alias("off_grid_bars"),
        count_when(any_null).alias("null_bars"),
        count_when(lowest <= 0).alias("nonpositive_bars"),
        count_when(F.col("low") > bottom).alias("low_above_bars"),
        count_when(F.col("high") < top).alias("high_below_bars"),
        count_when(F.col("volume") < 0).alias("negative_volume_bars"),
        count_when(F.col("volume") == 0).alias("zero_volume_bars"),
        # At most one entry per slot of the grid.
        F.collect_set("grid_slot").alias("present"),
    )
    grid = F.sequence(F.lit(0), F.lit(p.slots_per_session - 1))
    missing = F.array_except(grid, F.col("present"))
    tail = (
        (F.col("dropped_tail_bars") == 0)
        & (F.size("missing") <= p.collapsed_tail_slots)
        & (F.element_at("missing", 1) == p.slots_per_session - F.size("missing"))
    )
    return (
        checks.withColumn("missing", missing)
        .join(calendar.select("session_date", "is_trading_day"), "session_date", "left")
        .select(
            *SESSION,
            *[c for c in checks.columns if c not in (*SESSION, "present")],
            "is_trading_day",
            "missing",
            F.when(F.size("missing") > 0, tail).alias("tail_collapsed"),
        )
    )


def _reasons(p: Params) -> list[tuple[str, Column, str]]:
    """Severity, condition and text of every rule, in the order they are reported."""
    values_known = F.col("null_bars") == 0
    expected_volume = F.col("symbol") != p.index_symbol
    return [
        ("CORRUPT", ~F.col("is_trading_day"), "not a trading day"),
        ("CORRUPT", F.col("backward_bars") > 0, "timestamps not ascending"),
        ("CORRUPT", F.col("repeated_bars") > 0, "duplicate timestamp"),
        ("CORRUPT", F.col("wrong_date_bars") > 0, "bars dated outside the session"),
        ("CORRUPT", F.col("off_grid_bars") > 0, "bars off the session grid"),
        ("CORRUPT", ~values_known, "missing values"),
        ("CORRUPT", values_known & (F.col("nonpositive_bars") > 0), "price not positive"),
        ("CORRUPT", values_known & (F.col("low_above_bars") > 0), "low above open or close"),
        ("CORRUPT", values_known & (F.col("high_below_bars") > 0), "high below open or close"),
        ("CORRUPT", values_known & (F.col("negative_volume_bars") > 0), "negative volume"),
        ("TAIL_COLLAPSED", F.col("tail_collapsed"), "last slots folded away"),
        ("PARTIAL", ~F.col("tail_collapsed"), "slots missing"),
        (
            "SUSPECT",
            expected_volume & (F.col("zero_volume_bars") > p.zero_volume_share * F.col("bar_count")),
            "mostly zero volume",
        ),
    ]


def _worst(rules: list[tuple[str, Column, str]]) -> Column:
    severity = F.greatest(
        F.lit(0), *[F.when(condition, F.lit(VERDICTS.index(v))).otherwise(0) for v, condition, _ in rules]
    )
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), severity + 1)


def _texts(rules: list[tuple[str, Column, str]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(condition, F.lit(f"{v}: {text}")) for v, condition, text in rules])
    )


def session_verdicts(bars: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """The verdict of each session: the worst failing rule, with every reason kept."""
    rules = _reasons(p)
    return session_checks(bars, calendar, p).select(
        *SESSION,
        _worst(rules).alias("verdict"),
        F.col("bar_count").cast("int").alias("bar_count"),
        F.lit(p.slots_per_session).alias("expected_bars"),
        F.col("zero_volume_bars").cast("int").alias("zero_volume_bars"),
        F.transform(
            "missing", lambda s: clock(s, p.session_start_minute, p.slot_minutes)
        ).alias("missing_slots"),
        "dropped_tail_bars",
        _texts(rules).alias("reasons"),
        "fetched_at",
    )


def calendar_violations(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Session dates the calendar says nothing about: never assumed to be trading days."""
    known = calendar.where("is_trading_day is not null").select("session_date")
    return bars.select("session_date").distinct().join(known, "session_date", "left_anti")


def daily_row_verdicts(daily: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """Verdict of each daily row; rows fetched on their own date are in progress and left out."""
    settled = daily.where(F.col("session_date") != F.to_date("fetched_at"))
    # The previous row counts whatever its own verdict.
    previous = settled.withColumn("previous_close", F.lag("close").over(by_session())).join(
        calendar.select("session_date", "is_trading_day"), "session_date", "left"
    )
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in (*PRICES, "volume")]) == F.lit(1)
    shape = (
        F.when(missing, F.lit("CORRUPT: missing values"))
        .when(F.least(*PRICES) <= 0, F.lit("CORRUPT: price not positive"))
        .when(
            (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")),
            F.lit("CORRUPT: prices inconsistent"),
        )
        .when(F.col("volume") < 0, F.lit("CORRUPT: negative volume"))
    )
    low, high = p.split_ratio
    ratio = F.col("open") / F.when(F.col("previous_close") > 0, F.col("previous_close"))
    jumped = F.when((ratio < low) | (ratio > high), F.lit("SUSPECT: possible corporate action"))
    closed = F.when(~F.col("is_trading_day"), F.lit("CORRUPT: not a trading day"))
    corrupt = F.array_compact(F.array(closed, shape))
    return previous.withColumn("corrupt", corrupt).select(
        *SESSION,
        F.when(F.size("corrupt") > 0, F.lit("CORRUPT"))
        .when(jumped.isNotNull(), F.lit("SUSPECT"))
        .otherwise(F.lit("CLEAN"))
        .alias("verdict"),
        F.when(F.size("corrupt") > 0, F.col("corrupt"))
        .otherwise(F.array_compact(F.array(jumped)))
        .alias("reasons"),
    )


def tier_routing(verdicts: DataFrame) -> DataFrame:
    """Send research-grade sessions to ``bars`` and the rest to ``quarantine``."""
    research = F.col("verdict").isin(*RESEARCH_VERDICTS)
    return verdicts.withColumn(
        "tier", F.when(research, F.lit("bars")).otherwise(F.lit("quarantine"))
    )


def _verdict_counts() -> list[Column]:
    return [count_when(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS]


def _missing_dates(universe: DataFrame, verdicts: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected dates each symbol lacks. Date arrays are bounded by the calendar."""
    dates = expected.agg(F.collect_set("session_date").alias("expected_dates"))
    received = verdicts.groupBy("symbol").agg(F.collect_set("session_date").alias("received_dates"))
    none = F.array().cast("array<date>")
    return (
        universe.join(received, "symbol", "left")
        .join(F.broadcast(dates))  # one row
        .select(
            "symbol",
            F.size("expected_dates").alias("expected_sessions"),
            F.coalesce(F.size("received_dates"), F.lit(0)).alias("received_sessions"),
            F.array_sort(
                F.array_except("expected_dates", F.coalesce("received_dates", none))
            ).alias("missing_dates"),
        )
    )


def symbol_outcomes(
    universe: DataFrame, verdicts: DataFrame, daily_verdicts: DataFrame, expected: DataFrame
) -> DataFrame:
    """One row per symbol of the universe: sessions, verdicts, missing dates and slots, daily rows."""
    counts = verdicts.groupBy("symbol").agg(*_verdict_counts())
    slots = (
        verdicts.where(F.col("verdict").isin("PARTIAL", "TAIL_COLLAPSED"))
        .select("symbol", F.explode("missing_slots").alias("slot"))
        .groupBy("symbol", "slot")
        .agg(F.count("*").alias("n"))
        .groupBy("symbol")
        # At most one entry per slot of the grid.
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("slot", "n")))).alias(
                "missing_slot_counts"
            )
        )
    )
    daily = daily_verdicts.groupBy("symbol").agg(
        F.count("*").alias("daily_rows"),
        count_when(F.col("verdict") == "CORRUPT").alias("daily_corrupt"),
        count_when(F.col("verdict") == "SUSPECT").alias("daily_suspect"),
    )
    filled = [v.lower() for v in VERDICTS] + ["daily_rows", "daily_corrupt", "daily_suspect"]
    return (
        _missing_dates(universe, verdicts, expected)
        .join(counts, "symbol", "left")
        .join(slots, "symbol", "left")
        .join(daily, "symbol", "left")
        .na.fill(0, filled)
    )


def run_tally(outcomes: DataFrame) -> DataFrame:
    """Totals of a run in one row."""
    total = {c: F.sum(c) for c in [v.lower() for v in VERDICTS]}
    return outcomes.agg(
        F.count("*").alias("symbols"),
        F.sum("expected_sessions").alias("attempted"),
        F.sum("received_sessions").alias("received"),
        *[column.alias(c) for c, column in total.items()],
        *[F.sum(c).alias(c) for c in ("daily_rows", "daily_corrupt", "daily_suspect")],
    ).select(
        "*",
        (F.col("attempted") - F.col("received")).alias("missing"),
        (F.col("clean") + F.col("tail_collapsed")).alias("research"),
    )


def missing_everywhere(outcomes: DataFrame) -> DataFrame:
    """Dates that every symbol lacks, once each, and dates a symbol lacks that others have."""
    lacking = outcomes.select("symbol", F.explode("missing_dates").alias("session_date"))
    symbols = outcomes.agg(F.count("*").alias("symbols"))
    common = (
        lacking.groupBy("session_date")
        .agg(F.count("*").alias("lacking"))
        .join(F.broadcast(symbols))  # one row
        .where("lacking = symbols")
        .select("session_date")
    )
    own = lacking.join(common, "session_date", "left_anti")
    return common.select(
        F.lit("all symbols").alias("scope"), F.lit(None).cast("string").alias("symbol"), "session_date"
    ).unionByName(own.select(F.lit("one symbol").alias("scope"), "symbol", "session_date"))


def top_missing_slots(verdicts: DataFrame, top: int = 8) -> DataFrame:
    """The slots most often missing from partial or collapsed sessions."""
    return (
        verdicts.where(F.col("verdict").isin("PARTIAL", "TAIL_COLLAPSED"))
        .select(F.explode("missing_slots").alias("slot"))
        .groupBy("slot")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "slot")
        .limit(top)
    )


def rejected_by_symbol(latest: DataFrame, p: Params) -> DataFrame:
    """Sessions outside the research set, per equity."""
    return (
        latest.where(
            (F.col("symbol") != p.index_symbol) & ~F.col("verdict").isin(*RESEARCH_VERDICTS)
        )
        .groupBy("symbol")
        .agg(F.count("*").alias("rejected_sessions"))
    )


def integrity_summary(
    latest: DataFrame, daily_latest: DataFrame, runs: DataFrame, p: Params
) -> DataFrame:
    """What the verdict logs say about the equities, and what the last fetch of the log found.

    ``rejected`` maps each equity with rejects to their number, in order of the symbols; ``runs`` holds the
    ``fetch_run`` records, of which the last appended one counts.
    """
    totals = latest.where(F.col("symbol") != p.index_symbol).agg(
        F.count("*").alias("sessions_validated"),
        *_verdict_counts(),
        count_when(F.col("verdict").isin(*RESEARCH_VERDICTS)).alias("research_sessions"),
        F.count_distinct("symbol").alias("symbols"),
    )
    entry = F.struct("symbol", "rejected_sessions")
    worst = rejected_by_symbol(latest, p).agg(
        F.count("*").alias("symbols_with_rejects"),
        F.coalesce(F.max("rejected_sessions"), F.lit(0)).alias("most_rejects"),
        # One entry per symbol of the universe.
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("rejected"),
    )
    daily = daily_latest.agg(
        F.count("*").alias("daily_rows"), count_when(F.col("verdict") == "CORRUPT").alias("daily_corrupt")
    )
    told = ("ts", "attempted", "received", "missing")
    last = runs.agg(F.max_by(F.struct(*told), "seq").alias("run")).select(
        F.col("run.ts").alias("last_fetch"), *[F.col(f"run.{c}").alias(f"last_{c}") for c in told[1:]]
    )
    # Four tables of one row each.
    return totals.join(F.broadcast(worst)).join(F.broadcast(daily)).join(F.broadcast(last))

"""Point-in-time indicators as windows, aggregates and equi-joins.

Every value at a bar uses that bar and earlier ones only; an undefined value is NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import by_session, in_session
from rangebreak.functions.scalars import count_when, ratio
from rangebreak.params import Params


# ---- inside one session ----------------------------------------------------------------


def session_vwap(bars: DataFrame) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    w = in_session()
    return bars.withColumn(
        "vwap", ratio(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w))
    )


def session_sigma(bars: DataFrame) -> DataFrame:
    """Sample deviation of close-to-close returns; NULL before the third bar."""
    order = W.partitionBy("symbol", "session_date").orderBy("slot")
    returns = F.col("close") / F.lag("close").over(order) - 1
    return (
        bars.withColumn("bar_return", returns)
        .withColumn(
            "sigma",
            F.when(F.row_number().over(order) >= 3, F.stddev_samp("bar_return").over(in_session())),
        )
        .drop("bar_return")
    )


def in_range(p: Params) -> Column:
    return F.col("slot") < p.opening_range_bars


def session_facts(bars: DataFrame, p: Params, *more: Column) -> DataFrame:
    """One row per session: size, first open, last close, opening range and its volume, and ``more`` aggregates."""
    opening = in_range(p)
    facts = bars.groupBy("symbol", "session_date").agg(
        F.count("*").alias("n_bars"),
        F.min_by("open", "slot").alias("session_open"),
        F.max_by("close", "slot").alias("session_close"),
        count_when(opening).alias("or_bars"),
        F.max(F.when(opening, F.col("high"))).alias("or_high"),
        F.min(F.when(opening, F.col("low"))).alias("or_low"),
        F.coalesce(F.sum(F.when(opening, F.col("volume"))), F.lit(0)).alias("or_volume"),
        *more,
    )
    # Slots are unique, so n bars below slot n means exactly slots 0..n-1 are present.
    return facts.withColumn("or_valid", F.col("or_bars") == p.opening_range_bars)


def opening_range(bars: DataFrame, p: Params) -> DataFrame:
    """High, low and width of the opening range; NULL unless all its slots are present."""
    facts = session_facts(bars, p)
    valid = F.col("or_valid")
    return facts.select(
        "symbol",
        "session_date",
        valid,
        F.when(valid, F.col("or_high")).alias("or_high"),
        F.when(valid, F.col("or_low")).alias("or_low"),
        F.when(valid, F.col("or_high") - F.col("or_low")).alias("or_width"),
    )


# ---- across sessions -------------------------------------------------------------------


def session_ordinals(bars: DataFrame) -> DataFrame:
    """Number the sessions of each symbol. The window sees one row per session."""
    sessions = bars.select("symbol", "session_date").distinct()
    return sessions.withColumn("session_ordinal", F.row_number().over(by_session()))


def _trailing(p: Params):
    return (
        W.partitionBy("symbol", "slot")
        .orderBy("session_ordinal")
        .rangeBetween(-p.rvol_lookback, -1)
    )


def rvol_at_time(bars: DataFrame, p: Params) -> DataFrame:
    """Cumulative session volume against the trailing mean through the same slot.

    Every session is laid on the full grid with zero volume in absent slots, so a session with no
    bar yet still counts as zero. The grid has a fixed number of slots.
    """
    grid = session_ordinals(bars).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(p.slots_per_session - 1)))
    )
    filled = grid.join(
        bars.select("symbol", "session_date", "slot", "volume"), ["symbol", "session_date", "slot"], "left"
    )
    through = filled.withColumn(
        "cum_volume", F.sum(F.coalesce("volume", F.lit(0))).over(in_session())
    )
    base = F.sum("cum_volume").over(_trailing(p)) / p.rvol_lookback
    return (
        through.withColumn("base", base)
        .where(F.col("volume").isNotNull())
        .select(
            "symbol",
            "session_date",
            "slot",
            F.when(
                F.col("session_ordinal") > p.rvol_lookback, ratio(F.col("cum_volume"), F.col("base"))
            ).alias("rvol_at_time"),
        )
    )


def rvol_bar(bars: DataFrame, p: Params) -> DataFrame:
    """Bar volume against the trailing mean of the same slot; an absent slot counts as zero."""
    numbered = bars.select("symbol", "session_date", "slot", "volume").join(
        session_ordinals(bars), ["symbol", "session_date"]
    )
    base = F.sum("volume").over(_trailing(p)) / p.rvol_lookback
    return numbered.withColumn("base", base).select(
        "symbol",
        "session_date",
        "slot",
        F.when(F.col("session_ordinal") > p.rvol_lookback, ratio(F.col("volume"), F.col("base"))).alias(
            "rvol_bar"
        ),
    )


def rvol_open_column(p: Params) -> Column:
    """Opening-range volume against the trailing mean, over one row per session."""
    trailing = by_session().rowsBetween(-p.rvol_lookback, -1)
    base = F.sum("or_volume").over(trailing) / p.rvol_lookback
    enough = F.count("*").over(trailing) == p.rvol_lookback
    return F.when(enough, ratio(F.col("or_volume"), base))


def gap_column() -> Column:
    """Percent gap from the previous session's close, if that session is the previous trading day."""
    w = by_session()
    prev_close = F.lag("session_close").over(w)
    adjacent = F.lag("session_date").over(w) == F.col("prev_trading_day")
    return F.when(adjacent, (F.col("session_open") - prev_close) / prev_close * 100)


def gap_pct(bars: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    facts = session_facts(bars, p).join(
        calendar.select("session_date", "prev_trading_day"), "session_date", "left"
    )
    return facts.select("symbol", "session_date", gap_column().alias("gap_pct"))


# ---- daily rows ------------------------------------------------------------------------


def true_range(daily: DataFrame) -> DataFrame:
    """True range from the second daily row of each symbol on, with the row number."""
    w = by_session()
    prev = F.lag("close").over(w)
    return daily.select(
        "*",
        (F.row_number().over(w) - 1).alias("k"),
        F.when(
            prev.isNotNull(),
            F.greatest(
                F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
            ),
        ).alias("true_range"),
    )


def atr_wilder(daily: DataFrame, p: Params) -> DataFrame:
    """Wilder's smoothed average true range at every daily row, without a row-by-row loop.

    Unrolled, the recursion weighs each true range by a power of ``beta = (n-1)/n``. Powers relative
    to the first row would overflow on long histories, so rows are cut into blocks: the value is the
    block's own decayed sum plus the decayed sum of the block before. A block is long enough that
    anything older weighs less than one part in 1e200.
    """
    n = p.atr_period
    ranges = true_range(daily)
    if n == 1:
        return ranges.withColumn("atr", F.col("true_range")).drop("k", "true_range")
    beta = (n - 1) / n
    length = max(int(460 / -math.log(beta)), 1)
    k = F.col("k")
    # Row n carries the seed, the plain mean of the first n true ranges.
    seed = F.sum("true_range").over(by_session().rowsBetween(W.unboundedPreceding, W.currentRow)) / n
    term = F.when(k == n, seed).when(k > n, F.col("true_range") / n).otherwise(F.lit(0.0))
    step = F.when(k >= n, F.pmod(k - n, F.lit(length))).otherwise(F.lit(0))
    block = F.when(k >= n, F.floor((k - n) / length)).otherwise(F.lit(-1))
    within = (
        W.partitionBy("symbol", "block").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    before = W.partitionBy("symbol").orderBy("block").rangeBetween(-1, -1)
    decay = F.lit(beta)
    own = F.sum(F.col("term") * F.pow(decay, -F.col("step"))).over(within) * F.pow(decay, F.col("step"))
    carried = F.coalesce(
        F.sum(F.col("term") * F.pow(decay, F.lit(length - 1) - F.col("step"))).over(before), F.lit(0.0)
    ) * F.pow(decay, F.col("step") + 1)
    return (
        ranges.withColumns({"term": term, "step": step, "block": block})
        .withColumn("atr", F.when(k >= n, own + carried))
        .drop("k", "true_range", "term", "step", "block")
    )


def prior_day(daily: DataFrame, p: Params) -> DataFrame:
    """Daily rows renamed as what is known on the next trading day."""
    return atr_wilder(daily, p).select(
        "symbol",
        F.col("session_date").alias("prev_trading_day"),
        "atr",
        F.col("open").alias("prev_open"),
        F.col("close").alias("prev_close"),
    )


def atr_prior_day(sessions: DataFrame, daily: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """ATR of the calendar's previous trading day; NULL if that exact daily row is absent."""
    return (
        sessions.join(calendar.select("session_date", "prev_trading_day"), "session_date", "left")
        .join(prior_day(daily, p), ["symbol", "prev_trading_day"], "left")
        .select(*sessions.columns, "prev_trading_day", "atr", "prev_open", "prev_close")
    )


# ---- the index -------------------------------------------------------------------------


def index_bar_at(bars: DataFrame, index_bars: DataFrame) -> DataFrame:
    """The index bar with exactly the same start as each bar, else NULL."""
    at = index_bars.select("session_date", "slot", F.col("close").alias("index_close"))
    return bars.join(at, ["session_date", "slot"], "left")


def index_session_open(index_bars: DataFrame, key: tuple[str, ...] = ("session_date",)) -> DataFrame:
    return index_bars.groupBy(*key).agg(F.min_by("open", "slot").alias("index_open"))


def index_states(index_bars: DataFrame, p: Params, key: tuple[str, ...] = ("session_date",)) -> DataFrame:
    """For every slot of every index session: has the index closed beyond its own range by then?

    Backward as-of values laid on the fixed grid, so a stock bar finds its state with an equi-join.
    Size: index sessions times slots, whatever the number of stocks. ``key`` tells index sessions apart.
    """
    day = W.partitionBy(*key).orderBy("slot")
    so_far = day.rowsBetween(W.unboundedPreceding, W.currentRow)
    opening = in_range(p)
    n = p.opening_range_bars
    grid = (
        index_bars.select(*key)
        .distinct()
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(p.slots_per_session - 1))))
    )
    laid = grid.join(
        index_bars.select(*key, "slot", "high", "low", "close"), [*key, "slot"], "left"
    )
    ranged = laid.select(
        *key,
        "slot",
        F.col("close").alias("index_close"),
        F.col("close"),
        F.count("close").over(so_far).alias("seen"),
        count_when(opening & F.col("close").isNotNull()).over(so_far).alias("or_seen"),
        F.max(F.when(opening, F.col("high"))).over(so_far).alias("or_high"),
        F.min(F.when(opening, F.col("low"))).over(so_far).alias("or_low"),
    )
    after = F.col("slot") >= n
    complete = (F.col("or_seen") == n) & (F.col("seen") >= n)

    def state(beyond: Column) -> Column:
        hit = F.max(F.when(after & beyond, F.lit(1.0)).otherwise(F.lit(0.0))).over(so_far)
        return F.when(complete, hit)

    return ranged.select(
        *key,
        "slot",
        "index_close",
        state(F.col("close") > F.col("or_high")).alias("index_up"),
        state(F.col("close") < F.col("or_low")).alias("index_down"),
    )


def index_breakout_state(bars: DataFrame, index_bars: DataFrame, p: Params) -> DataFrame:
    return bars.join(
        index_states(index_bars, p).drop("index_close"), ["session_date", "slot"], "left"
    )

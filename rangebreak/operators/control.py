"""A random control matched trade by trade, and the edge over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.scalars import count_when, direction_sign, hash_pick
from rangebreak.operators.indicators import atr_prior_day
from rangebreak.operators.stats import number_within, session_bootstrap
from rangebreak.params import Params

TWIN = ["trade_id", "symbol", "session_date"]
LEVEL = ["setup", "variant", "slippage_bps"]


def with_trade_id(trades: DataFrame) -> DataFrame:
    key = ("setup", "variant", "symbol", "session_date", "direction")
    return trades.withColumn("trade_id", F.concat_ws("|", *key))


def eligible_sessions(bars: DataFrame, daily: DataFrame, calendar: DataFrame, p: Params) -> DataFrame:
    """Sessions a twin may trade: a positive prior-day ATR, with the span of its entry window."""
    traded = bars.where(F.col("symbol") != p.index_symbol)
    sessions = traded.groupBy("symbol", "session_date").agg(
        F.count("*").alias("n_bars"),
        # Positions follow slots, so the window is a run of positions found by counting.
        count_when(F.col("slot") < p.first_entry_slot).alias("first_pos"),
        (count_when(F.col("slot") <= p.last_entry_slot) - 1).alias("last_pos"),
    )
    known = atr_prior_day(sessions, daily, calendar, p)
    return known.where("atr > 0").select(
        "symbol", "session_date", "n_bars", "first_pos", "last_pos", "atr"
    )


def matched_random(trades: DataFrame, eligible: DataFrame, bars: DataFrame, p: Params) -> DataFrame:
    """One random twin per trade: same day, same holding time, same stop multiple of its own ATR.

    The symbol is picked by number: trades never meet all symbols of their day, only the one drawn.
    Slippage plays no part in the draw, so a twin is the same at every level.
    """
    seed = F.lit(str(p.seed))

    def draw(what: str, modulus: Column) -> Column:
        return hash_pick([seed, F.col("trade_id"), F.lit(what)], modulus)

    numbered = number_within(eligible, ["session_date"], F.col("symbol"))
    days = eligible.groupBy("session_date").agg(F.count("*").alias("candidates"))
    asked = (
        trades.select("trade_id", "setup", "variant", "session_date", "duration_bars")
        .join(days, "session_date")
        .withColumn("number", draw("symbol", F.col("candidates")))
    )
    drawn = asked.join(numbered.drop("m"), ["session_date", "number"]).where("last_pos >= first_pos")
    room = F.least(F.col("last_pos"), F.col("n_bars") - 1 - F.col("duration_bars")) - F.col("first_pos") + 1
    twins = drawn.select(
        *TWIN,
        F.col("setup").alias("matched_setup"),
        "variant",
        "duration_bars",
        "n_bars",
        "atr",
        F.when(draw("direction", F.lit(2)) == 0, F.lit("long")).otherwise(F.lit("short")).alias("direction"),
        (F.col("first_pos") + F.when(room > 0, draw("entry", F.greatest(room, F.lit(1)))).otherwise(0)).alias(
            "entry_pos"
        ),
    )
    t = twins.alias("t")
    b = bars.withColumn(
        "pos", F.row_number().over(W.partitionBy("symbol", "session_date").orderBy("slot")) - 1
    ).alias("b")
    path = t.join(
        b,
        (F.col("t.symbol") == F.col("b.symbol"))
        & (F.col("t.session_date") == F.col("b.session_date"))
        & (F.col("b.pos") >= F.col("t.entry_pos"))
        & (F.col("b.pos") <= F.col("t.entry_pos") + F.col("t.duration_bars")),
    ).select("t.*", "b.pos", "b.slot", "b.ts", "b.open", "b.high", "b.low", "b.close")
    return _capped_exit(path, p)


def _capped_exit(path: DataFrame, p: Params) -> DataFrame:
    """Stop or the last bar of the matched holding time, whichever comes first."""
    whole = W.partitionBy(*TWIN)
    entered = path.withColumn(
        "entry_price", F.max(F.when(F.col("pos") == F.col("entry_pos"), F.col("open"))).over(whole)
    )
    sign = direction_sign(F.col("direction"))
    long = F.col("direction") == "long"
    leveled = entered.withColumns(
        {
            "stop_price": F.col("entry_price") - sign * p.stop_atr * F.col("atr"),
            "best": F.when(long, F.col("high")).otherwise(F.col("low")),
            "worst": F.when(long, F.col("low")).otherwise(F.col("high")),
        }
    )
    hit = sign * (F.col("worst") - F.col("stop_price")) <= 0
    staged = leveled.withColumns(
        {
            "stop_pos": F.min(F.when(hit, F.col("pos"))).over(whole),
            "cap_pos": F.max("pos").over(whole),
        }
    )
    exit_pos = F.coalesce("stop_pos", "cap_pos")
    gapped = sign * (F.col("open") - F.col("stop_price")) <= 0
    price = (
        F.when(F.col("stop_pos").isNull(), F.col("close"))
        .when(gapped, F.col("open"))
        .otherwise(F.col("stop_price"))
    )
    here = F.col("pos") == exit_pos
    first = F.col("pos") == F.col("entry_pos")
    return (
        staged.groupBy(
            *TWIN, "matched_setup", "variant", "direction", "n_bars", "atr", "entry_pos", "entry_price", "stop_price"
        )
        .agg(
            F.max(F.when(first, F.col("slot"))).alias("entry_slot"),
            F.max(F.when(first, F.col("ts"))).alias("entry_time"),
            F.max(F.when(here, F.col("slot"))).alias("exit_slot"),
            F.max(F.when(here, F.col("ts"))).alias("exit_time"),
            F.max(F.when(here, price)).alias("exit_price"),
            F.max(exit_pos).alias("exit_pos"),
            F.max("stop_pos").alias("stop_pos"),
            F.max(F.when(F.col("pos") <= exit_pos, sign * F.col("best"))).alias("best_signed"),
        )
        .select(
            *TWIN,
            F.lit("random").alias("setup"),
            "matched_setup",
            "variant",
            "direction",
            "atr",
            F.lit(p.stop_atr).alias("stop_atr_multiple"),
            "entry_slot",
            "entry_time",
            "entry_price",
            "stop_price",
            "exit_slot",
            "exit_time",
            "exit_price",
            F.when(F.col("stop_pos").isNotNull(), F.lit("stop"))
            .when(F.col("exit_pos") == F.col("n_bars") - 1, F.lit("eod"))
            .otherwise(F.lit("time"))
            .alias("exit_reason"),
            (F.col("exit_pos") - F.col("entry_pos")).alias("duration_bars"),
            (sign * F.col("best_signed")).alias("mfe_price"),
        )
    )


def pairing_violations(strategy: DataFrame, random: DataFrame) -> DataFrame:
    """Results on either side without a partner at the same slippage level."""
    key = ["trade_id", "slippage_bps"]
    alone = strategy.join(random, key, "left_anti").select(*key, F.lit("no twin").alias("violation"))
    extra = random.join(strategy, key, "left_anti").select(*key, F.lit("no trade").alias("violation"))
    return alone.unionByName(extra)


def edge_vs_random(strategy: DataFrame, random: DataFrame, p: Params) -> DataFrame:
    """Paired net-R difference per setup, variant and slippage level, resampled by session."""
    twin = random.select("trade_id", "slippage_bps", F.col("r_net").alias("r_random"))
    pairs = strategy.select(
        *LEVEL, "trade_id", "session_date", F.col("r_net").alias("r_strategy")
    ).join(twin, ["trade_id", "slippage_bps"])
    pairs = pairs.withColumn("difference", F.col("r_strategy") - F.col("r_random"))
    means = pairs.groupBy(*LEVEL).agg(
        F.count("*").alias("n"),
        F.avg("r_strategy").alias("mean_strategy_r"),
        F.avg("r_random").alias("mean_random_r"),
        F.avg("difference").alias("edge_r"),
    )
    interval = session_bootstrap(pairs, LEVEL, F.col("difference"), F.lit(1), p)
    return means.join(interval, LEVEL).select(
        *LEVEL,
        "n",
        "mean_strategy_r",
        "mean_random_r",
        "edge_r",
        "ci_low",
        "ci_high",
        ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)).alias("flat"),
    )

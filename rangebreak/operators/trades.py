"""Signals, entries, exits, costs and results.

A trade's path is the join of its signal with the later bars of the same session: an equi-join on
(symbol, session_date) with the slot order as a residual. First-touch exits are conditional minima
over that path, so no bar-by-bar loop is needed. A path is at most one session long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.scalars import direction_sign, opposite, ratio
from rangebreak.params import ALL_FEATURES, VARIANTS, Params

TRADE = ["setup", "symbol", "session_date", "direction"]

# Fee schedule per order, as fractions of turnover.
BROKERAGE_CAP = 20.0
BROKERAGE_RATE = 0.0003
STT_RATE_SELL = 0.00025
EXCHANGE_RATE = 0.0000297
STAMP_RATE_BUY = 0.00003
SEBI_RATE = 0.000001
GST_RATE = 0.18
IMPACT_BPS = 10.0
MAX_PARTICIPATION = 1.0


# ---- signals ---------------------------------------------------------------------------


def orb_signals(events: DataFrame) -> DataFrame:
    """Breakouts that close on their own side of the session VWAP at that bar, which the events carry."""
    sign = direction_sign(F.col("direction"))
    return events.where(sign * (F.col("breakout_close") - F.col("breakout_vwap")) > 0).select(
        F.lit("orb").alias("setup"),
        "symbol",
        "session_date",
        "direction",
        F.col("direction").alias("feature_direction"),
        F.col("breakout_slot").alias("signal_slot"),
        "atr",
        F.col("breakout_vwap").alias("vwap"),
    )


def failed_orb_signals(events: DataFrame) -> DataFrame:
    """The reverse of every breakout that busts, on the bar that completes the bust."""
    return events.where("label = 'BUSTED'").select(
        F.lit("failed_orb").alias("setup"),
        "symbol",
        "session_date",
        opposite(F.col("direction")).alias("direction"),
        F.col("direction").alias("feature_direction"),
        F.col("resolved_slot").alias("signal_slot"),
        "atr",
        F.lit(None).cast("double").alias("vwap"),
    )


def setup_gate(signals: DataFrame, verdict: DataFrame) -> DataFrame:
    """Keep a gated setup only if the one-row study verdict is a signal."""
    opened = verdict.where("verdict = 'signal'").select(F.lit(True).alias("gate_open")).limit(1)
    return signals.join(F.broadcast(opened)).drop("gate_open")


def gate_setups(results: DataFrame, verdict: DataFrame, gated: tuple[str, ...] = ("failed_orb",)) -> DataFrame:
    """Rows of any table by setup, those of gated setups only if the one-row study verdict is a signal."""
    opened = verdict.agg(F.coalesce(F.bool_or(F.col("verdict") == "signal"), F.lit(False)).alias("gate_open"))
    return results.join(F.broadcast(opened)).where(~F.col("setup").isin(*gated) | F.col("gate_open")).drop("gate_open")


# ---- paths and exits -------------------------------------------------------------------


def trade_paths(signals: DataFrame, bars: DataFrame, keys: list[str] = TRADE) -> DataFrame:
    """Bars after each signal; the first one present is the entry, bought at its open."""
    s, b = signals.alias("s"), bars.alias("b")
    later = s.join(
        b,
        (F.col("s.symbol") == F.col("b.symbol"))
        & (F.col("s.session_date") == F.col("b.session_date"))
        & (F.col("b.slot") > F.col("s.signal_slot")),
    ).select("s.*", "b.slot", "b.ts", "b.open", "b.high", "b.low", "b.close")
    order = W.partitionBy(*keys).orderBy("slot")
    return later.withColumns(
        {
            "k": F.row_number().over(order) - 1,
            "entry_slot": F.first("slot").over(order),
            "entry_time": F.first("ts").over(order),
            "entry_price": F.first("open").over(order),
        }
    )


def entry_rule(signals: DataFrame, bars: DataFrame, p: Params) -> DataFrame:
    """The entry bar of each signal, if it exists and is not too late."""
    return (
        trade_paths(signals, bars)
        .where((F.col("k") == 0) & (F.col("entry_slot") <= p.last_entry_slot))
        .select(
            *TRADE,
            "feature_direction",
            "signal_slot",
            "atr",
            "entry_slot",
            "entry_time",
            "entry_price",
        )
    )


def entry_violations(entries: DataFrame, features: DataFrame) -> DataFrame:
    """Entries whose breakout has no feature row."""
    known = features.select("symbol", "session_date", F.col("direction").alias("feature_direction"))
    return entries.join(known, ["symbol", "session_date", "feature_direction"], "left_anti").select(*TRADE)


def _levels(p: Params) -> dict[str, Column]:
    sign = direction_sign(F.col("direction"))
    long = F.col("direction") == "long"
    return {
        "sign": sign,
        "stop_price": F.col("entry_price") - sign * p.stop_atr * F.col("atr"),
        "best": F.when(long, F.col("high")).otherwise(F.col("low")),
        "worst": F.when(long, F.col("low")).otherwise(F.col("high")),
    }


def _touched(level: str) -> Column:
    return F.col("sign") * (F.col("worst") - F.col(level)) <= 0


def _fill(level: str) -> Column:
    """A bar that opens beyond the stop fills at its open, else the stop itself trades."""
    gapped = F.col("sign") * (F.col("open") - F.col(level)) <= 0
    return F.when(gapped, F.col("open")).otherwise(F.col(level))


def simulate_exits(paths: DataFrame, p: Params, keys: list[str] = TRADE) -> DataFrame:
    """Both exit variants of every trade from one pass over its path.

    Stop before target within a bar; after half is taken off at one risk unit the stop moves to the
    entry price from the next bar on.
    """
    whole = W.partitionBy(*keys)
    at = F.col("k")
    target = F.col("entry_price") + F.col("sign") * (
        F.col("sign") * (F.col("entry_price") - F.col("stop_price"))
    )
    leveled = paths.withColumns(_levels(p)).withColumns(
        {
            "target": target,
            "last_k": F.max("k").over(whole),
            "k_stop": F.min(F.when(_touched("stop_price"), at)).over(whole),
        }
    )
    reached = F.col("sign") * (F.col("best") - F.col("target")) >= 0
    before_stop = F.col("k_stop").isNull() | (at < F.col("k_stop"))
    staged = leveled.withColumn("k_target", F.min(F.when(reached & before_stop, at)).over(whole)).withColumn(
        "k_even",
        F.min(F.when((at > F.col("k_target")) & _touched("entry_price"), at)).over(whole),
    )
    k_base = F.coalesce(F.col("k_stop"), F.col("last_k"))
    k_part = F.when(F.col("k_target").isNull(), k_base).otherwise(
        F.coalesce(F.col("k_even"), F.col("last_k"))
    )
    base_price = F.when(at == F.col("k_stop"), _fill("stop_price")).otherwise(F.col("close"))
    rest_price = F.when(at == F.col("k_even"), _fill("entry_price")).otherwise(F.col("close"))
    part_price = F.when(F.col("k_target").isNull(), base_price).otherwise(
        0.5 * F.col("target") + 0.5 * rest_price
    )

    def outcome(exit_k: Column, price: Column) -> list[Column]:
        here = at == exit_k
        return [
            F.max(exit_k).alias("duration_bars"),
            F.max(F.when(here, F.col("slot"))).alias("exit_slot"),
            F.max(F.when(here, F.col("ts"))).alias("exit_time"),
            F.max(F.when(here, price)).alias("exit_price"),
            F.max(F.when(at <= exit_k, F.col("sign") * F.col("best"))).alias("best_signed"),
        ]

    names = ("duration_bars", "exit_slot", "exit_time", "exit_price", "best_signed")
    carried = [
        c
        for c in paths.columns
        if c not in {*keys, "k", "slot", "ts", "open", "high", "low", "close"}
    ] + ["sign", "stop_price", "k_stop", "k_target", "k_even"]
    per_trade = staged.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried],
        *[c.alias(f"base_{n}") for n, c in zip(names, outcome(k_base, base_price))],
        *[c.alias(f"part_{n}") for n, c in zip(names, outcome(k_part, part_price))],
    )
    base_reason = F.when(F.col("k_stop").isNotNull(), F.lit("stop")).otherwise(F.lit("eod"))
    part_reason = (
        F.when(F.col("k_target").isNull(), base_reason)
        .when(F.col("k_even").isNotNull(), F.lit("stop"))
        .otherwise(F.lit("target"))
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(variant).alias("variant"),
                *[F.col(f"{prefix}_{n}").alias(n) for n in names],
                reason.alias("exit_reason"),
            )
            for variant, prefix, reason in zip(VARIANTS, ("base", "part"), (base_reason, part_reason))
        ]
    )
    kept = [c for c in carried if c not in ("sign", "k_stop", "k_target", "k_even")]
    return per_trade.select(*keys, "sign", *kept, F.inline(rows)).select(
        *keys,
        *kept,
        "variant",
        "exit_slot",
        "exit_time",
        "exit_price",
        "exit_reason",
        "duration_bars",
        # The best price starts at the entry price.
        (F.col("sign") * F.greatest(F.col("best_signed"), F.col("sign") * F.col("entry_price"))).alias(
            "mfe_price"
        ),
    )


def build_trades(signals: DataFrame, bars: DataFrame, p: Params) -> DataFrame:
    """Two rows per admissible signal, one for each exit variant."""
    admissible = trade_paths(signals, bars).where(F.col("entry_slot") <= p.last_entry_slot)
    return simulate_exits(admissible, p).withColumn("stop_atr_multiple", F.lit(p.stop_atr))


def exit_variant(signals: DataFrame, bars: DataFrame, p: Params, variant: str) -> DataFrame:
    return build_trades(signals, bars, p).where(F.col("variant") == variant)


def exit_base(signals: DataFrame, bars: DataFrame, p: Params) -> DataFrame:
    return exit_variant(signals, bars, p, "base")


def exit_partial_1r(signals: DataFrame, bars: DataFrame, p: Params) -> DataFrame:
    return exit_variant(signals, bars, p, "partial_1r")


def setup_run_counts(
    sessions: DataFrame, signals: DataFrame, entries: DataFrame
) -> DataFrame:
    """Sessions seen and without ATR, signals, and signals whose entry came too late, in one row.

    ``sessions`` has one row per session with its prior-day ``atr``.
    """
    seen = sessions.agg(
        F.count("*").alias("sessions_seen"),
        F.count(F.when(F.col("atr").isNull(), 1)).alias("sessions_without_atr"),
    )
    asked = signals.agg(F.count("*").alias("n_signals"))
    entered = entries.agg(F.count("*").alias("n_entries"))
    return (
        seen.join(F.broadcast(asked))
        .join(F.broadcast(entered))
        .select(
            "sessions_seen",
            "sessions_without_atr",
            "n_entries",
            (F.col("n_signals") - F.col("n_entries")).alias("skipped_late_entries"),
        )
    )


# ---- costs and results -----------------------------------------------------------------


def cost_columns(buy: Column, sell: Column, bps: Column) -> dict[str, Column]:
    """Itemised round-trip costs in the order of the schedule above."""
    brokerage_buy = F.least(F.lit(BROKERAGE_CAP), BROKERAGE_RATE * buy)
    brokerage_sell = F.least(F.lit(BROKERAGE_CAP), BROKERAGE_RATE * sell)
    exchange_buy, exchange_sell = EXCHANGE_RATE * buy, EXCHANGE_RATE * sell
    return {
        "brokerage_buy": brokerage_buy,
        "brokerage_sell": brokerage_sell,
        "stt": STT_RATE_SELL * sell,
        "exchange_buy": exchange_buy,
        "exchange_sell": exchange_sell,
        "stamp": STAMP_RATE_BUY * buy,
        "sebi_buy": SEBI_RATE * buy,
        "sebi_sell": SEBI_RATE * sell,
        "gst": GST_RATE
        * (brokerage_buy + brokerage_sell + exchange_buy + exchange_sell + SEBI_RATE * (buy + sell)),
        "slippage_buy": bps / 10_000 * buy,
        "slippage_sell": bps / 10_000 * sell,
    }


_STATUTORY = (
    "brokerage_buy",
    "brokerage_sell",
    "stt",
    "exchange_buy",
    "exchange_sell",
    "stamp",
    "sebi_buy",
    "sebi_sell",
    "gst",
)


def trade_costs(legs: DataFrame) -> DataFrame:
    """Add a ``costs`` struct to rows with ``buy_turnover``, ``sell_turnover``, ``slippage_bps``."""
    items = cost_columns(F.col("buy_turnover"), F.col("sell_turnover"), F.col("slippage_bps"))
    itemised = legs.withColumn("costs", F.struct(*[c.alias(n) for n, c in items.items()]))

    def total(names) -> Column:
        out = F.col(f"costs.{names[0]}")
        for name in names[1:]:
            out = out + F.col(f"costs.{name}")
        return out

    slippage = total(("slippage_buy", "slippage_sell"))
    statutory = total(_STATUTORY)
    return (
        itemised.withColumn("costs", F.col("costs").withField("statutory", statutory))
        .withColumn("costs", F.col("costs").withField("slippage", slippage))
        .withColumn("costs", F.col("costs").withField("total", statutory + slippage))
    )


def cost_violations(legs: DataFrame) -> DataFrame:
    return legs.where(
        (F.col("buy_turnover") <= 0) | (F.col("sell_turnover") <= 0) | (F.col("slippage_bps") < 0)
    )


def participation_slippage(orders: DataFrame) -> DataFrame:
    """Slippage widened by the order's share of its bar's traded value (square-root impact).

    Without a bar value the flat figure stays as it is.
    """
    share = F.least(F.col("order_value") / F.col("bar_value"), F.lit(MAX_PARTICIPATION))
    return orders.withColumn(
        "slippage_bps",
        F.when(F.col("bar_value") > 0, F.col("base_bps") + IMPACT_BPS * F.sqrt(share)).otherwise(
            F.col("base_bps")
        ),
    )


def participation_violations(orders: DataFrame) -> DataFrame:
    return orders.where((F.col("base_bps") < 0) | (F.col("order_value") <= 0))


def evaluate_trades(trades: DataFrame, p: Params) -> DataFrame:
    """Every trade at every slippage level: quantity, P&L, costs and R multiples."""
    sign = direction_sign(F.col("direction"))
    long = F.col("direction") == "long"
    levels = F.explode(F.array(*[F.lit(b) for b in p.slippage_bps]))
    at_entry = F.col("quantity") * F.col("entry_price")
    at_exit = F.col("quantity") * F.col("exit_price")
    legs = (
        trades.withColumn("slippage_bps", levels)
        .withColumn("quantity", F.floor(F.lit(p.position) / F.col("entry_price")))
        .withColumns(
            {
                "risk": F.col("quantity") * (sign * (F.col("entry_price") - F.col("stop_price"))),
                "buy_turnover": F.when(long, at_entry).otherwise(at_exit),
                "sell_turnover": F.when(long, at_exit).otherwise(at_entry),
                "gross_pnl": sign * (F.col("exit_price") - F.col("entry_price")) * F.col("quantity"),
            }
        )
    )
    mfe = sign * (F.col("mfe_price") - F.col("entry_price")) * F.col("quantity")
    risk = F.when(F.col("risk") > 0, F.col("risk"))
    return (
        trade_costs(legs)
        .withColumn("net_pnl", F.col("gross_pnl") - F.col("costs.total"))
        .withColumns(
            {
                "r_gross": F.col("gross_pnl") / risk,
                "r_net": F.col("net_pnl") / risk,
                "mfe_r": mfe / risk,
            }
        )
    )


def evaluation_violations(results: DataFrame) -> DataFrame:
    """Trades that buy no share, sit on the wrong side of their stop, or end before they start."""
    return results.where(
        (F.col("entry_price") <= 0)
        | (F.col("quantity") < 1)
        | (F.col("risk") <= 0)
        | (F.col("duration_bars") < 0)
        | F.col("r_net").isNull()
    ).select("symbol", "session_date", "direction", "entry_price", "quantity", "risk")


RESULT_COLUMNS = (
    "setup",
    "variant",
    "symbol",
    "session_date",
    "direction",
    "entry_slot",
    "entry_time",
    "exit_slot",
    "exit_time",
    "entry_price",
    "exit_price",
    "stop_price",
    "exit_reason",
    "atr",
    "stop_atr_multiple",
    "slippage_bps",
    "quantity",
    "risk",
    "gross_pnl",
    "cost_total",
    "cost_slippage",
    "net_pnl",
    "r_gross",
    "r_net",
    "mfe_r",
    "duration_bars",
)


def flat_results(results: DataFrame) -> DataFrame:
    return results.withColumns(
        {"cost_total": F.col("costs.total"), "cost_slippage": F.col("costs.slippage")}
    )


def results_table(results: DataFrame, features: DataFrame) -> DataFrame:
    """One flat row per trade and slippage level, with the features of the breakout behind it."""
    known = features.select(
        "symbol", "session_date", F.col("direction").alias("feature_direction"), *ALL_FEATURES
    )
    return (
        flat_results(results)
        .join(known, ["symbol", "session_date", "feature_direction"], "left")
        .select(*RESULT_COLUMNS, *ALL_FEATURES)
    )

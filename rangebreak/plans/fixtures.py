"""Bar tables derived from the given tables, the inputs of every registered query.

Three grids: months of days and weeks of days over line items, days of hours over events, and
months of days by supplier, whose number of symbols grows with the data.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import require_none, stage_root, write_stage
from rangebreak.operators.calendar import calendar_table
from rangebreak.operators.features import breakout_context, feature_table, feature_violations
from rangebreak.operators.control import (
    LEVEL,
    edge_vs_random,
    eligible_sessions,
    matched_random,
    pairing_violations,
    with_trade_id,
)
from rangebreak.operators.forecast import compare_combinations
from rangebreak.operators.labelling import label_violations
from rangebreak.operators.quality import (
    calendar_violations,
    drop_settling_tail,
    grid_slot,
    session_verdicts,
)
from rangebreak.operators.study import study_violations
from rangebreak.operators.summary import expectancy, expectancy_violations, segment_keys
from rangebreak.operators.trades import (
    build_trades,
    entry_violations,
    evaluate_trades,
    failed_orb_signals,
    flat_results,
    orb_signals,
)
from rangebreak.params import Params
from rangebreak.sources import store
from rangebreak.sources.ticks import daily_rows, pooled_index, ticks_to_bars

INDEX = "INDEX"
ZONE = "Asia/Kolkata"
# A large position, because some derived prices exceed the default one.
POSITION = 10_000_000.0

_COMMON = dict(index_symbol=INDEX, position=POSITION, session_start_minute=0)
MONTHS = Params(
    slots_per_session=31, slot_minutes=1440, opening_range_bars=3, bust_cutoff_slot=26,
    last_entry_slot=20, **_COMMON,
)
WEEKS = Params(
    slots_per_session=7, slot_minutes=1440, opening_range_bars=2, bust_cutoff_slot=6,
    last_entry_slot=5, **_COMMON,
)
HOURS = Params(
    slots_per_session=24, slot_minutes=60, opening_range_bars=3, bust_cutoff_slot=22,
    last_entry_slot=20, **_COMMON,
)

PARAMS = {"m": MONTHS, "w": WEEKS, "h": HOURS, "s": MONTHS}

# First date of the grid step that a date lies in, the step, and the step back.
_STEP = {
    "m": ("trunc(first, 'month')", "interval 1 month"),
    "w": ("cast(date_trunc('week', first) as date)", "interval 7 day"),
    "h": ("first", "interval 1 day"),
}
_STEP_BACK = {
    "m": "add_months(session_date, -1)",
    "w": "date_sub(session_date, 7)",
    "h": "date_sub(session_date, 1)",
}


@dataclass
class Fixture:
    spark: SparkSession
    sf_dir: str
    grid: str
    stage_bars: bool = False

    @property
    def params(self) -> Params:
        return PARAMS[self.grid]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        if self.grid == "h":
            return self.table("events").select(
                F.col("event_type").alias("symbol"),
                F.to_date("ts").alias("session_date"),
                F.hour("ts").alias("slot"),
                "ts",
                F.col("value").alias("price"),
                F.lit(1).alias("quantity"),
                F.col("event_id").alias("seq"),
            )
        day = F.to_date("l_shipdate")
        if self.grid == "w":
            session = F.date_trunc("week", F.col("l_shipdate")).cast("date")
            slot = F.weekday(day)
        else:
            session = F.trunc(day, "month")
            slot = F.dayofmonth(day) - 1
        symbol = (
            F.col("l_suppkey").cast("string")
            if self.grid == "s"
            else F.concat("l_returnflag", "l_linestatus")
        )
        # Order within a bar: order and line number first, then the other columns of the row,
        # because line items repeat (order, line). One BIGINT keeps the aggregation hash-based.
        rest = F.pmod(
            F.col("l_partkey") * 7919
            + F.col("l_suppkey") * 104729
            + F.floor(F.col("l_extendedprice") * 100 + 0.5),
            F.lit(1048576),
        )
        return self.table("lineitem").select(
            symbol.alias("symbol"),
            session.alias("session_date"),
            slot.alias("slot"),
            F.col("l_shipdate").alias("ts"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("quantity"),
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + rest).alias("seq"),
        )

    @cached_property
    def traded(self) -> DataFrame:
        """Bars with the span of their trades.

        A plan that reads bars on several branches takes them from a written stage, as it would take
        them from the bar store: the raw table is then read once, and each branch reads its columns.

        By supplier a bar has about one trade, so adding up before the move would shrink nothing: the trades
        of a session, one month of one supplier, move together. Its bars then lie in one file, and what later
        adds up sessions moves one row for each.
        """
        ticks = self.ticks.repartition("symbol", "session_date") if self.grid == "s" else self.ticks
        bars = ticks_to_bars(ticks)
        return write_stage(bars, f"bars-{self.grid}", reuse=True) if self.stage_bars else bars

    @cached_property
    def bars(self) -> DataFrame:
        return self.traded.drop("first_seq", "last_seq")

    @cached_property
    def index_bars(self) -> DataFrame:
        return pooled_index(self.traded, INDEX)

    @cached_property
    def all_bars(self) -> DataFrame:
        return self.bars.unionByName(self.index_bars)

    @cached_property
    def daily(self) -> DataFrame:
        return daily_rows(self.bars)

    @cached_property
    def calendar(self) -> DataFrame:
        """Every grid step from that of the table's first date to that of its last one."""
        first, step = _STEP["m" if self.grid == "s" else self.grid]
        span = self.dates.agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"))
        return span.where("first is not null").select(
            F.expr(f"explode(sequence({first}, last, {step}))").alias("session_date")
        ).select(
            "session_date",
            F.lit(True).alias("is_trading_day"),
            F.expr(_STEP_BACK["m" if self.grid == "s" else self.grid]).alias("prev_trading_day"),
        )

    @cached_property
    def dates(self) -> DataFrame:
        """Every calendar date on which the underlying table has a row."""
        return (
            self.table("events").select(F.to_date("ts").alias("session_date"))
            if self.grid == "h"
            else self.table("lineitem").select(F.to_date("l_shipdate").alias("session_date"))
        ).distinct()

    @cached_property
    def holidays(self) -> DataFrame:
        """Dates of the table on every 29th day of the year, named after their day number."""
        return self.dates.where(F.dayofyear("session_date") % 29 == 0).select(
            F.col("session_date").alias("date"),
            F.concat(F.lit("holiday "), F.dayofyear("session_date").cast("string")).alias("name"),
        )

    @cached_property
    def expiries(self) -> DataFrame:
        """Session dates of the index in months divisible by three (grid m), else every fourth date."""
        sessions = self.bars.select(F.col("session_date").alias("date")).distinct()
        rule = F.month("date") % 3 == 0 if self.grid in ("m", "s") else F.dayofyear("date") % 4 == 0
        return sessions.where(rule)

    # ---- shared stages ------------------------------------------------------------------

    @cached_property
    def context(self) -> DataFrame:
        """Labelled breakouts with their session facts, not yet written."""
        return breakout_context(self.bars, self.daily, self.calendar, self.params)

    @cached_property
    def events(self) -> DataFrame:
        """The breakout table as a written stage, for plans that read it more than once."""
        require_none(calendar_violations(self.bars, self.calendar), "session date outside the calendar")
        events = write_stage(self.context, f"breakouts-{self.grid}", reuse=True)
        require_none(label_violations(events), "breakout that no label may be given")
        return events

    @cached_property
    def features(self) -> DataFrame:
        return feature_table(self.events, self.bars, self.index_bars, self.expiries, self.params)

    @cached_property
    def feature_stage(self) -> DataFrame:
        require_none(
            feature_violations(self.events, self.bars, self.index_bars, self.params), "breakout at odds with its bar"
        )
        features = write_stage(self.features, f"features-{self.grid}", reuse=True)
        require_none(study_violations(features), "label that is no outcome")
        return features

    @cached_property
    def signals(self) -> DataFrame:
        return orb_signals(self.events).unionByName(failed_orb_signals(self.events))

    @cached_property
    def trades(self) -> DataFrame:
        return build_trades(self.signals, self.bars, self.params)

    @cached_property
    def predictions(self) -> DataFrame:
        """Walk-forward predictions with both combinations, as a written stage."""
        return write_stage(
            compare_combinations(self.feature_stage, self.params), f"predictions-{self.grid}", reuse=True
        )

    @cached_property
    def trade_stage(self) -> DataFrame:
        trades = write_stage(with_trade_id(self.trades), f"trades-{self.grid}", reuse=True)
        require_none(entry_violations(trades, self.features), "entry without a feature row")
        return trades

    @cached_property
    def eligible(self) -> DataFrame:
        return eligible_sessions(self.bars, self.daily, self.calendar, self.params)

    @cached_property
    def twins(self) -> DataFrame:
        twins = write_stage(
            matched_random(self.trade_stage, self.eligible, self.bars, self.params), f"twins-{self.grid}", reuse=True
        )
        require_none(
            self.trade_stage.join(twins, "trade_id", "left_anti").select("trade_id"), "trade without a random twin"
        )
        return twins

    @cached_property
    def strategy_results(self) -> DataFrame:
        return flat_results(evaluate_trades(self.trade_stage, self.params))

    @cached_property
    def random_results(self) -> DataFrame:
        return flat_results(evaluate_trades(self.twins, self.params))

    @cached_property
    def edges(self) -> DataFrame:
        require_none(pairing_violations(self.strategy_results, self.random_results), "result without a partner")
        return edge_vs_random(self.strategy_results, self.random_results, self.params)

    @cached_property
    def overall(self) -> DataFrame:
        require_none(expectancy_violations(self.strategy_results), "trade without a net multiple")
        return expectancy(self.strategy_results, LEVEL, self.params)

    @cached_property
    def segmented(self) -> DataFrame:
        widths = self.features.select(
            "symbol",
            "session_date",
            F.col("direction").alias("feature_direction"),
            "rvol_breakout_bar",
            "or_width_atr",
        )
        keyed = self.strategy_results.join(
            widths, ["symbol", "session_date", "feature_direction"], "left"
        )
        return segment_keys(keyed, self.params)

    # ---- delivered bars with faults ------------------------------------------------------

    @cached_property
    def fetched_at(self) -> DataFrame:
        """Evening of the last date, in one row."""
        return self.dates.agg(
            (F.max("session_date").cast("timestamp_ntz") + F.expr("interval 18 hours")).alias("fetched_at")
        )

    @cached_property
    def expected_symbols(self) -> DataFrame:
        """Symbols that bars are asked for: those with bars, and regions, which deliver nothing."""
        regions = self.table("region").select(F.col("r_name").alias("symbol"))
        return self.bars.select("symbol").unionByName(regions).distinct()

    @cached_property
    def delivered(self) -> DataFrame:
        """Hourly bars as delivered, with faults chosen by the first event of the bar or session."""
        session = W.partitionBy("symbol", "session_date")
        bar, slot = F.col("first_seq"), F.col("slot")
        marked = self.traded.withColumn("sid", F.min("first_seq").over(session))
        sid = F.col("sid")
        start = F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(hours=slot)
        kept = marked.where(~((sid % 7 == 0) & (slot >= 22)) & ~((sid % 7 == 1) & (slot == 10)))
        swapped = bar % 97 == 1
        faulty = kept.select(
            "symbol",
            "session_date",
            F.when((sid % 11 == 3) & (slot == 12), start + F.expr("interval 30 minutes"))
            .when((sid % 13 == 4) & (slot == 23), start + F.expr("interval 1 hour"))
            .otherwise(start)
            .alias("ts"),
            "open",
            F.when(swapped, F.col("low")).otherwise(F.col("high")).alias("high"),
            F.when(swapped, F.col("high")).otherwise(F.col("low")).alias("low"),
            F.when(bar % 79 != 4, F.col("close")).alias("close"),
            F.when(bar % 89 == 2, -F.col("volume"))
            .when((sid % 5 == 2) & (slot % 3 != 0), F.lit(0))
            .otherwise(F.col("volume"))
            .cast("bigint")
            .alias("volume"),
            F.when((sid % 17 == 5) & (slot == 5), F.lit(900)).otherwise(slot * 10).alias("place"),
            (bar % 83 == 3).alias("repeat"),
        )
        copies = F.explode(F.when(F.col("repeat"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        return (
            faulty.withColumn("copy", copies)
            .withColumn("ingest_seq", (F.col("place") + F.col("copy")).cast("bigint"))
            .drop("place", "repeat", "copy")
            .join(F.broadcast(self.fetched_at))
        )

    @cached_property
    def real_calendar(self) -> DataFrame:
        """Weekdays that are not holidays, over the dates of the table."""
        span = self.dates.agg(F.min("session_date").alias("start"), F.max("session_date").alias("end"))
        return calendar_table(span, self.holidays)

    @cached_property
    def verdicts(self) -> DataFrame:
        return session_verdicts(self.delivered, self.real_calendar, self.params)

    @cached_property
    def verdict_stage(self) -> DataFrame:
        return write_stage(self.verdicts, f"verdicts-{self.grid}", reuse=True)

    @cached_property
    def delivered_daily(self) -> DataFrame:
        """Daily rows of the line items with faults chosen by the first row of the day."""
        bar = F.col("first_seq")
        swapped = bar % 97 == 1
        return self.traded.select(
            "symbol",
            F.to_date("ts").alias("session_date"),
            F.when(bar % 83 == 3, F.lit(0.0)).otherwise(F.col("open")).alias("open"),
            F.when(swapped, F.col("low")).otherwise(F.col("high")).alias("high"),
            F.when(swapped, F.col("high")).otherwise(F.col("low")).alias("low"),
            F.when(bar % 79 != 4, F.col("close")).alias("close"),
            F.when(bar % 89 == 2, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        ).join(F.broadcast(self.fetched_at))

    @cached_property
    def verdict_log(self) -> DataFrame:
        """An append-only log: some sessions first judged partial, all judged, and another interval."""
        final = self.verdict_stage.drop("fetched_at")
        first = final.where(F.dayofyear("session_date") % 2 == 0)
        return (
            first.withColumn("verdict", F.lit("PARTIAL")).select(F.lit(1).alias("seq"), F.lit("60m").alias("interval"), "*")
            .unionByName(final.select(F.lit(2).alias("seq"), F.lit("60m").alias("interval"), "*"))
            .unionByName(
                final.withColumn("verdict", F.lit("CLEAN")).select(F.lit(3).alias("seq"), F.lit("1d").alias("interval"), "*")
            )
        )

    @cached_property
    def routed(self) -> DataFrame:
        """Delivered bars, without the settling tail, under the tier of their verdict, as stored."""
        kept = drop_settling_tail(self.delivered, self.params)
        kept = kept.withColumn("slot", grid_slot(F.col("ts"), self.params))
        return store.stored(store.route(kept, self.verdict_stage), "60m", ZONE)

    @cached_property
    def store_root(self) -> str:
        root = f"{stage_root(self.spark)}/store-{uuid.uuid4().hex}"
        store.write_store(self.routed, root)
        return root

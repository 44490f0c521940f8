"""Does anything look past its decision bar? Truncation, poisoning and table comparison.

An audit runs a transform once over many versions of the bars: the whole history, and one version per cut,
in which the bars after the cut are gone or poisoned. The version is part of the symbol, so whatever works
symbol by symbol needs no change; what joins across symbols must join on ``version_of`` as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangebreak.functions.frames import write_stage
from rangebreak.operators.stats import exact_quantiles

# Fixed values of the poisoned tail: its ramp, its shape around the close, its volume.
RAMP_FIRST, RAMP_LAST, RAMP_SIZE = 0.2, 1.0, 0.5
OPEN_SHARE, HIGH_SHARE, LOW_SHARE = 0.995, 1.01, 0.99
VOLUME_MULTIPLE = 50

Transform = Callable[[DataFrame], DataFrame]


def _bar_order():
    """One number that orders bars by session date and slot."""
    return F.datediff("session_date", F.lit("1970-01-01")) * 10_000 + F.col("slot")


def poison_future(bars: DataFrame, from_slot: int) -> DataFrame:
    """Replace the end of every symbol's last session, from ``from_slot`` on, by a steep rise."""
    last = bars.groupBy("symbol").agg(F.max("session_date").alias("last_date"))
    marked = bars.join(last, "symbol").withColumn(
        "poisoned",
        (F.col("session_date") == F.col("last_date")) & (F.col("slot") >= from_slot),
    )
    return _with_poison(marked, bars.columns)


def _with_poison(marked: DataFrame, columns: list[str]) -> DataFrame:
    honest = marked.where(~F.col("poisoned"))
    median = exact_quantiles(
        honest.select("symbol", F.col("volume").cast("double").alias("value")), ["symbol"], (0.5,)
    ).select("symbol", F.col("q0").alias("median_volume"))
    ends = honest.groupBy("symbol").agg(F.max_by("close", _bar_order()).alias("honest_close"))
    tail = marked.where("poisoned").groupBy("symbol").agg(
        F.size(F.collect_set("slot")).alias("tail_bars"), F.sort_array(F.collect_set("slot")).alias("tail_slots")
    )  # at most the slots of the grid
    step = F.when(F.col("tail_bars") > 1, (RAMP_LAST - RAMP_FIRST) / (F.col("tail_bars") - 1)).otherwise(0.0)
    place = F.array_position("tail_slots", F.col("slot")) - 1
    ramp = F.col("honest_close") * (1 + RAMP_SIZE * (RAMP_FIRST + place * step))
    facts = marked.join(ends, "symbol", "left").join(tail, "symbol", "left").join(median, "symbol", "left")
    swapped = F.col("poisoned") & F.col("honest_close").isNotNull()

    def put(name: str, value) -> dict:
        return {name: F.when(swapped, value).otherwise(F.col(name))}

    return (
        facts.withColumn("ramp", ramp)
        .withColumns(
            {
                **put("open", F.col("ramp") * OPEN_SHARE),
                **put("high", F.col("ramp") * HIGH_SHARE),
                **put("low", F.col("ramp") * LOW_SHARE),
                **put("close", F.col("ramp")),
                **put("volume", (F.col("median_volume") * VOLUME_MULTIPLE).cast("bigint")),
            }
        )
        .select(*columns)
    )


def poison_violations(bars: DataFrame, from_slot: int) -> DataFrame:
    """Symbols with nothing to poison, or nothing honest left."""
    last = bars.groupBy("symbol").agg(F.max("session_date").alias("last_date"))
    tail = (F.col("session_date") == F.col("last_date")) & (F.col("slot") >= from_slot)
    return (
        bars.join(last, "symbol")
        .groupBy("symbol")
        .agg(F.count(F.when(tail, 1)).alias("tail"), F.count("*").alias("n"))
        .where("tail = 0 or tail = n")
    )


def _cells(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    fields = [c for c in df.columns if c not in keys]
    cells = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(side)) for c in fields]
    )
    return df.select(*keys, F.inline(cells))


def frame_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Fields whose values differ, NULL equal to NULL; a row on one side only differs in every field."""
    a = _cells(left, keys, "left_value").withColumn("in_left", F.lit(True))
    b = _cells(right, keys, "right_value").withColumn("in_right", F.lit(True))
    one_side = F.col("in_left").isNull() | F.col("in_right").isNull()
    return (
        a.join(b, [*keys, "field"], "full")
        .where(one_side | ~F.col("left_value").eqNullSafe(F.col("right_value")))
        .select(
            *keys,
            "field",
            "left_value",
            "right_value",
            F.when(F.col("in_right").isNull(), F.lit("left only"))
            .when(F.col("in_left").isNull(), F.lit("right only"))
            .otherwise(F.lit("differs"))
            .alias("difference"),
        )
    )


# ---- versions of the bars --------------------------------------------------------------

WHOLE = "whole"
_MARK = "|"


def version_of(symbol: str = "symbol") -> Column:
    """Version of a symbol as the transforms of an audit see it."""
    return F.substring_index(symbol, _MARK, 1)


def plain_symbol(symbol: str = "symbol") -> Column:
    """Symbol without its version; it may hold the mark itself."""
    return F.expr(f"substring({symbol}, instr({symbol}, '{_MARK}') + 1)")


def _named(cuts: DataFrame) -> DataFrame:
    return cuts.withColumn("version", F.concat_ws("/", "part", "cut_date", "cut_slot"))


def own_cuts(bars: DataFrame, slots: tuple[int, ...], parts: int = 4) -> DataFrame:
    """``symbol, part, cut_date, cut_slot, version``: cuts that part each symbol's own sessions evenly.

    The last part ends in the symbol's last session. The slots take turns.
    """
    part = F.col("part")
    dates = bars.groupBy("symbol").agg(F.sort_array(F.collect_set("session_date")).alias("dates"))  # bounded by the calendar
    place = F.floor((F.size("dates") * part + parts - 1) / parts).cast("int")
    slot = F.element_at(F.array(*map(F.lit, slots)), (part - 1) % len(slots) + 1)
    return _named(
        dates.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts)))).select(
            "symbol", "part", F.element_at("dates", place).alias("cut_date"), slot.alias("cut_slot")
        )
    )


def common_cuts(bars: DataFrame, slot: int) -> DataFrame:
    """Cuts of all symbols at once: one at each date on which the history of a symbol ends."""
    last = bars.groupBy("symbol").agg(F.max("session_date").alias("cut_date"))
    # One row, bounded by the calendar.
    dates = last.agg(F.sort_array(F.collect_set("cut_date")).alias("dates"))
    every = last.select("symbol").join(F.broadcast(dates)).select("symbol", F.explode("dates").alias("cut_date"))
    return _named(every.withColumns({"part": F.lit(1), "cut_slot": F.lit(slot)}))


def with_index(cuts: DataFrame, index_symbol: str) -> DataFrame:
    """The cuts, and each of them for an index that all symbols share."""
    shared = cuts.drop("symbol").distinct().withColumn("symbol", F.lit(index_symbol))
    return cuts.unionByName(shared)


def _up_to_cut(slot_column: str) -> Column:
    date, cut = F.col("session_date"), F.col("cut_date")
    return (date < cut) | ((date == cut) & (F.col(slot_column) <= F.col("cut_slot")))


def _into(version: Column) -> Column:
    return F.concat(version, F.lit(_MARK), F.col("symbol"))


def _truncated(bars: DataFrame, cuts: DataFrame) -> DataFrame:
    kept = bars.join(cuts, "symbol").where(_up_to_cut("slot"))
    return kept.withColumn("symbol", _into(F.col("version"))).select(*bars.columns)


def _poisoned(bars: DataFrame, cuts: DataFrame) -> DataFrame:
    marked = bars.join(cuts, "symbol").withColumn("poisoned", ~_up_to_cut("slot"))
    return _with_poison(marked.withColumn("symbol", _into(F.col("version"))), bars.columns)


# ---- audits ----------------------------------------------------------------------------


def _digests(df: DataFrame, group: list[str]) -> DataFrame:
    """Per group the number of rows and two sums of their hashes, which merge in any order."""
    # A hash leaves NULLs out, so each field says whether it is one.
    value = F.xxhash64(*[c for f in df.columns for c in (F.col(f), F.col(f).isNull())])
    return df.groupBy(*group).agg(
        F.struct(F.count("*"), F.bit_xor(value), F.sum(F.shiftright(value, 16))).alias("digest")
    )


def differing_groups(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Groups of rows that are not the same on both sides, by digests of 64 bits and more."""
    a = _digests(left, group).withColumnRenamed("digest", "left_digest")
    b = _digests(right, group).withColumnRenamed("digest", "right_digest")
    return a.join(b, group, "full").where(~F.col("left_digest").eqNullSafe(F.col("right_digest"))).select(*group)


def _reports(
    transform: Transform, bars: DataFrame, cuts: DataFrame, changed: DataFrame, keys: list[str], slot_column: str
) -> DataFrame:
    """``version, part, decisions, leaks, first_leaking_field`` per version of the bars.

    The transform runs once, over the whole history and all versions together, whatever their number. Rows are
    compared in sessions whose digests differ; all others are equal and move no more than a digest.
    """
    whole = bars.withColumn("symbol", _into(F.lit(WHOLE)))
    decided = write_stage(transform(whole.unionByName(changed)), "audited")
    in_whole = version_of() == WHOLE
    fields = decided.columns
    versioned = cuts.withColumn("symbol", _into(F.col("version")))
    full = (
        decided.where(in_whole)
        .withColumn("symbol", plain_symbol())
        .join(cuts, "symbol")
        .where(_up_to_cut(slot_column))
        .withColumn("symbol", _into(F.col("version")))
    )
    other = decided.where(~in_whole).join(versioned, "symbol").where(_up_to_cut(slot_column)).select(*fields)
    session = ["symbol", "session_date"]
    open_sessions = differing_groups(full.select(*fields), other, session)
    found = frame_diff(
        full.select(*fields).join(open_sessions, session, "left_semi"), other.join(open_sessions, session, "left_semi"), keys
    )
    leaks = found.groupBy(version_of().alias("version")).agg(
        F.count("*").alias("leaks"), F.min("field").alias("first_leaking_field")
    )
    decisions = full.groupBy("version").agg(F.count("*").alias("decisions"))
    return (
        cuts.select("version", "part")
        .distinct()
        .join(decisions, "version", "left")
        .join(leaks, "version", "left")
        .fillna(0, ["decisions", "leaks"])
    )


def audit_truncation(
    transform: Transform, bars: DataFrame, cuts: DataFrame, keys: list[str], slot_column: str, index_symbol: str | None = None
) -> DataFrame:
    """Recompute on bars that end at each cut: every decision up to it must come out the same. One row per part.

    One cut tests all decisions of its symbol before it at once. ``transform`` derives daily rows and all else
    from the bars it is given, so these end at the cut too. ``index_symbol`` names an index among the bars, which is
    cut with each symbol and makes no decisions of its own.
    """
    every = with_index(cuts, index_symbol) if index_symbol else cuts
    reports = _reports(transform, bars, cuts, _truncated(bars, every), keys, slot_column)
    return reports.groupBy("part").agg(
        F.lit("truncation").alias("audit"),
        F.sum("decisions").alias("decisions"),
        F.sum("leaks").alias("leaks"),
        F.min("first_leaking_field").alias("first_leaking_field"),
    )


def audit_poison(
    transform: Transform, bars: DataFrame, from_slot: int, keys: list[str], slot_column: str, index_symbol: str | None = None
) -> DataFrame:
    """Poison all symbols from one (date, slot) on: earlier decisions must not move, whatever their symbol.

    Symbols meet in the index, so it must be clean before the poison of any of them. The dates are the last
    sessions of the symbols, each one version, so a symbol that ends early is poisoned as well. Decisions
    are those before the latest date, leaks those at all dates.
    """
    symbols = bars.where(F.col("symbol") != index_symbol) if index_symbol else bars
    cuts = common_cuts(symbols, from_slot - 1)
    every = with_index(cuts, index_symbol) if index_symbol else cuts
    reports = _reports(transform, bars, cuts, _poisoned(bars, every), keys, slot_column)
    return reports.agg(
        F.lit("poison").alias("audit"),
        F.coalesce(F.max("decisions"), F.lit(0)).alias("decisions"),
        F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks"),
        F.min("first_leaking_field").alias("first_leaking_field"),
    )

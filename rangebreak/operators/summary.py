"""Expectancy, segments and the tables a report is written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.scalars import count_when
from rangebreak.operators.calendar import half_hour_text
from rangebreak.operators.control import LEVEL
from rangebreak.operators.stats import exact_quantiles, session_bootstrap
from rangebreak.params import OUTCOMES, TESTED_FEATURES, Params

SEGMENTS = ("seg_rvol", "seg_or_width", "seg_half_hour")


def expectancy(results: DataFrame, groups: list[str], p: Params) -> DataFrame:
    """Expectancy per group with its interval; below the sample floor only the count is given."""
    r, m = F.col("r_net"), F.col("mfe_r")
    base = results.groupBy(*groups).agg(
        F.count("*").alias("n"),
        count_when(r > 0).alias("wins"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win_r"),
        F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_loss_r"),
        count_when(m < p.breakeven_r).alias("short_of_breakeven"),
    )
    interval = session_bootstrap(results, groups, r, F.lit(1), p)
    win_rate = F.col("wins") / F.col("n")
    measures = {
        "win_rate": win_rate,
        "avg_win_r": F.col("avg_win_r"),
        "avg_loss_r": F.col("avg_loss_r"),
        "expectancy_r": win_rate * F.col("avg_win_r") - (1 - win_rate) * F.abs(F.col("avg_loss_r")),
        "ci_low": F.col("ci_low"),
        "ci_high": F.col("ci_high"),
        "flat": (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0),
        "breakeven_failure_rate": F.col("short_of_breakeven") / F.col("n"),
    }
    enough = F.col("n") >= p.min_sample
    return base.join(interval, groups).select(
        *groups,
        "n",
        enough.alias("computed"),
        *[F.when(enough, c).alias(name) for name, c in measures.items()],
    )


def expectancy_violations(results: DataFrame) -> DataFrame:
    return results.where(F.col("r_net").isNull() | F.col("mfe_r").isNull())


def rvol_bucket(value: Column, threshold: float) -> Column:
    label = f"{threshold:g}"
    return (
        F.when(value.isNull(), F.lit("rvol n/a"))
        .when(value < 1.0, F.lit("rvol <1.0"))
        .when(value < threshold, F.lit(f"rvol 1.0-{label}"))
        .otherwise(F.lit(f"rvol >={label}"))
    )


def segment_keys(results: DataFrame, p: Params) -> DataFrame:
    """Add relative-volume bucket, opening-range-width quartile and entry half hour.

    Quartiles are taken over the trades of one setup, variant and slippage level; ties between
    edges merge their buckets.
    """
    width = F.col("or_width_atr")
    quartiles = exact_quantiles(
        results.where(width.isNotNull()).select(*LEVEL, width.alias("value")), LEVEL, (0.25, 0.5, 0.75)
    ).select(*LEVEL, F.col("n").alias("widths"), "lowest", "highest", "q0", "q1", "q2")
    edges = F.filter(
        F.array_distinct(F.array("q0", "q1", "q2")), lambda e: e > F.col("lowest")
    )
    quartile = F.size(F.filter(edges, lambda e: e < width)) + 1
    sized = width.isNotNull() & (F.col("widths") >= 4) & (F.col("lowest") < F.col("highest"))
    minute = F.hour("entry_time") * 60 + F.minute("entry_time")
    return (
        results.join(quartiles, LEVEL, "left")
        .withColumns(
            {
                "seg_rvol": rvol_bucket(F.col("rvol_breakout_bar"), p.rvol_threshold),
                "seg_or_width": F.when(
                    sized, F.concat(F.lit("or_width Q"), quartile.cast("string"))
                ).otherwise(F.lit("or_width n/a")),
                "seg_half_hour": half_hour_text((F.floor(minute / 30) * 30).cast("int")),
            }
        )
        .drop("widths", "lowest", "highest", "q0", "q1", "q2")
    )


def segmented_expectancy(segmented: DataFrame, p: Params) -> DataFrame:
    """Expectancy per segment value at each level, the three segmentations stacked."""
    stacked = segmented.select(
        *LEVEL,
        "session_date",
        "r_net",
        "mfe_r",
        F.inline(
            F.array(
                *[F.struct(F.lit(s).alias("segment"), F.col(s).alias("segment_value")) for s in SEGMENTS]
            )
        ),
    )
    return expectancy(stacked, [*LEVEL, "segment", "segment_value"], p)


def results_by_role(strategy: DataFrame, random: DataFrame) -> DataFrame:
    """Both result tables in one, told apart by ``role``; twins keep the setup they were matched to."""
    return strategy.withColumn("role", F.lit("strategy")).unionByName(
        random.withColumn("setup", F.col("matched_setup")).withColumn("role", F.lit("random")),
        allowMissingColumns=True,
    )


def backtest_summary(edges: DataFrame, overall: DataFrame) -> DataFrame:
    """Edge and expectancy side by side per setup, variant and slippage level."""
    mine = overall.select(
        *LEVEL,
        F.col("computed").alias("has_expectancy"),
        "win_rate",
        "avg_win_r",
        "avg_loss_r",
        "expectancy_r",
        F.col("ci_low").alias("expectancy_ci_low"),
        F.col("ci_high").alias("expectancy_ci_high"),
        "breakeven_failure_rate",
    )
    return edges.join(mine, LEVEL)


def setup_verdict(summary: DataFrame) -> DataFrame:
    """Verdict on each setup from its base variant at every slippage level; NULL where an interval is."""
    beats = (F.col("ci_low") > 0) & (F.col("expectancy_ci_low") > 0)
    known = F.col("ci_low").isNotNull() & F.col("expectancy_ci_low").isNotNull()
    return (
        summary.where("variant = 'base'")
        .groupBy("setup")
        .agg(F.bool_and("has_expectancy").alias("complete"), F.bool_and(known).alias("known"), F.bool_and(beats).alias("beats"))
        .select(
            "setup",
            F.when(~F.col("complete"), F.lit("insufficient sample"))
            .when(~F.col("known"), F.lit(None))
            .when(F.col("beats"), F.lit("edge detected"))
            .otherwise(F.lit("no edge"))
            .alias("setup_verdict"),
        )
    )


def money_summary(by_role: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean and total net result of the base variant per slippage level; the middle level in detail."""
    base = by_role.where("variant = 'base'")
    mine = F.col("role") == "strategy"
    levels = base.groupBy("setup", "slippage_bps").agg(
        count_when(mine).alias("n_trades"),
        F.avg(F.when(mine, F.col("net_pnl"))).alias("per_trade"),
        F.sum(F.when(mine, F.col("net_pnl"))).alias("total"),
        F.avg(F.when(mine, (F.col("net_pnl") > 0).cast("double"))).alias("win_share"),
        F.avg(F.when(mine, F.col("cost_total"))).alias("cost"),
        F.coalesce(F.avg(F.when(~mine, F.col("net_pnl"))), F.lit(0.0)).alias("random"),
    )
    of_setup = W.partitionBy("setup")  # one row per slippage level
    middle = F.row_number().over(of_setup.orderBy("slippage_bps")) - 1 == F.floor(
        F.count("*").over(of_setup) / 2
    )
    flat = edges.where("variant = 'base'").select("setup", "slippage_bps", "flat")
    detailed = levels.withColumn("is_middle", middle).join(flat, ["setup", "slippage_bps"], "left")
    at_middle = F.col("is_middle")
    return detailed.select(
        "setup",
        "slippage_bps",
        "n_trades",
        "per_trade",
        "total",
        "is_middle",
        F.when(at_middle, F.bround(F.col("win_share") * 10, 0)).alias("wins_in_ten"),
        F.when(at_middle, F.col("cost")).alias("cost"),
        F.when(at_middle, F.col("random")).alias("random_mean"),
        F.when(at_middle, F.coalesce(F.col("flat"), F.lit(False))).alias("same_as_random"),
    )


def report_facts(events: DataFrame, findings: DataFrame, thinnest: int = 4) -> DataFrame:
    """Headline numbers in one row: span, outcomes, the best testable feature and the thinnest ones."""
    span = events.agg(
        F.count("*").alias("n_breakouts"),
        F.count_distinct("session_date").alias("n_sessions"),
        F.min("session_date").alias("first_date"),
        F.max("session_date").alias("last_date"),
        *[
            F.bround(count_when(F.col("label") == o) / F.count("*") * 100, 1).alias(f"{o.lower()}_pct")
            for o in OUTCOMES
        ],
    )
    fewest = F.least(F.coalesce("failures_first", F.lit(0)), F.coalesce("failures_second", F.lit(0)))
    # One row per feature: the list has a fixed length.
    place = F.array_position(F.array(*[F.lit(f) for f in TESTED_FEATURES]), F.col("feature"))
    ranked = F.array_sort(
        F.collect_list(F.struct(fewest.alias("fewest"), place.alias("place"), F.col("feature")))
    )
    leading = F.when(F.col("testable"), F.struct(F.col("gap_all"), -place))
    facts = findings.agg(
        F.max_by("feature", leading).alias("best_feature"),
        F.max(F.when(F.col("testable"), F.col("gap_all"))).alias("best_gap"),
        F.transform(F.slice(ranked, 1, thinnest), lambda x: x["feature"]).alias("thinnest"),
    )
    return span.join(F.broadcast(facts))

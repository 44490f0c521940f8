"""Does a feature separate failed breakouts? Thirds in two date halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import unpivot_features
from rangebreak.functions.scalars import count_when
from rangebreak.operators.stats import exact_quantiles
from rangebreak.params import OUTCOMES, TESTED_FEATURES, TWO_SIDED_FEATURES, Params

SCOPES = ("all", "first half", "second half")


def split_date(rows: DataFrame, p: Params) -> DataFrame:
    """First date of the second half, in one row; NULL when there is none."""
    # Windows over dates alone: one row per session date.
    through = W.orderBy("session_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    days = rows.groupBy("session_date").agg(F.count("*").alias("n"))
    shared = days.select(
        "session_date",
        F.row_number().over(W.orderBy("session_date")).alias("number"),
        (F.sum("n").over(through) / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("share"),
    )
    # The first half always keeps its first date.
    later = (F.col("number") > 1) & (F.col("share") >= p.train_fraction)
    return shared.agg(F.min(F.when(later, F.col("session_date"))).alias("split_date"))


def scoped_values(features: DataFrame, p: Params, names=TESTED_FEATURES) -> DataFrame:
    """Long form of the tested features, each row once per scope it belongs to."""
    halves = features.join(F.broadcast(split_date(features, p)))  # one row
    half = F.when(F.col("session_date") < F.col("split_date"), F.lit("first half")).when(
        F.col("session_date") >= F.col("split_date"), F.lit("second half")
    )
    scoped = halves.withColumn(
        "scope", F.explode(F.array_compact(F.array(F.lit("all"), half)))
    )
    return unpivot_features(scoped, names, ["scope", "label"])


def layouts(values: DataFrame, keys: list[str]) -> DataFrame:
    """How each key's values are cut: by distinct value when there are two or three, else by thirds.

    Adds ``edge0`` and ``edge1``, the inclusive upper ends of all buckets but the last. Keys that
    cannot be cut are left out.
    """
    quantiles = exact_quantiles(values, keys, (1 / 3, 2 / 3))
    distinct = values.groupBy(*keys, "value").agg(F.lit(1).alias("one"))
    kinds = (
        distinct.join(quantiles.select(*keys, "lowest"), keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("kinds"),
            F.min(F.when(F.col("value") > F.col("lowest"), F.col("value"))).alias("second"),
        )
    )
    few = F.col("kinds") <= 3
    return (
        quantiles.join(kinds, keys)
        .where((F.col("n") >= 3) & (F.col("kinds") >= 2) & (few | (F.col("q0") != F.col("q1"))))
        .select(
            *keys,
            "n",
            few.alias("by_value"),
            "lowest",
            "highest",
            F.when(few, F.col("lowest")).otherwise(F.col("q0")).alias("edge0"),
            F.when(F.col("kinds") == 3, F.col("second"))
            .when(F.col("kinds") > 3, F.col("q1"))
            .alias("edge1"),
        )
    )


def third_of(value: Column) -> Column:
    return (
        F.when(value <= F.col("edge0"), F.lit("low"))
        .when(value <= F.col("edge1"), F.lit("mid"))
        .otherwise(F.lit("high"))
    )


def bucket_bounds() -> dict[str, Column]:
    """Displayed bounds of a bucket, and the half-open interval that decides membership."""
    third = F.col("third")
    last_edge = F.coalesce("edge1", "edge0")
    by_value = F.col("by_value")
    return {
        "lower": F.when(third == "low", F.col("lowest"))
        .when(by_value & (third == "mid"), F.col("edge1"))
        .when(by_value, F.col("highest"))
        .when(third == "mid", F.col("edge0"))
        .otherwise(F.col("edge1")),
        "upper": F.when(third == "low", F.col("edge0"))
        .when(third == "mid", F.col("edge1"))
        .otherwise(F.col("highest")),
        "above": F.when(third == "mid", F.col("edge0")).when(third == "high", last_edge),
        "through": F.when(third == "low", F.col("edge0")).when(third == "mid", F.col("edge1")),
    }


def bucket_counts(values: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome counts per bucket. Only the layout, one row per key, is joined to the values.

    A key with an empty bucket, as when its upper edge is also its largest value, is left out whole.
    """
    cut = layouts(values, keys)
    of_key = W.partitionBy(*keys)  # at most three buckets
    expected = F.when(F.col("edge1").isNull(), 2).otherwise(3)
    return (
        values.join(cut, keys)
        .withColumn("third", third_of(F.col("value")))
        .groupBy(*keys, "third", "by_value", "lowest", "highest", "edge0", "edge1")
        .agg(
            F.count("*").alias("n"),
            *[count_when(F.col("label") == o).alias(o.lower()) for o in OUTCOMES],
        )
        .withColumn("filled", F.count("*").over(of_key))
        .where(F.col("filled") == expected)
        .withColumns(bucket_bounds())
        .drop("by_value", "lowest", "highest", "edge0", "edge1", "filled")
    )


def feature_buckets(features: DataFrame, p: Params) -> DataFrame:
    """The cut of every tested feature in every scope."""
    return bucket_counts(scoped_values(features, p), ["feature", "scope"]).select(
        "feature", "scope", "third", "lower", "upper", "n"
    )


def bust_rate_by_third(features: DataFrame, p: Params) -> DataFrame:
    """Failure rate per bucket with the totals of its table."""
    counts = bucket_counts(scoped_values(features, p), ["feature", "scope"])
    table = W.partitionBy("feature", "scope")  # at most three buckets
    return counts.select(
        "feature",
        "scope",
        "third",
        "lower",
        "upper",
        "n",
        F.col("busted").alias("failures"),
        (F.col("busted") / F.col("n") * 100).alias("failure_pct"),
        F.sum("n").over(table).alias("table_n"),
        F.sum("busted").over(table).alias("table_failures"),
        (F.sum("busted").over(table) / F.sum("n").over(table) * 100).alias("base_pct"),
    )


def feature_findings(features: DataFrame, p: Params) -> DataFrame:
    """Per feature: the low-minus-high gap overall and in each half, and whether it holds."""
    return findings_from(bust_rate_by_third(features, p), p, features.sparkSession)


def findings_from(thirds: DataFrame, p: Params, spark) -> DataFrame:
    def pick(scope: str, third: str, column: str) -> Column:
        return F.max(F.when((F.col("scope") == scope) & (F.col("third") == third), F.col(column)))

    measures = []
    for scope, short in zip(SCOPES, ("all", "first", "second")):
        measures += [
            (pick(scope, "low", "failure_pct") - pick(scope, "high", "failure_pct")).alias(f"gap_{short}"),
            F.max(F.when(F.col("scope") == scope, F.col("table_failures"))).alias(f"failures_{short}"),
        ]
    wide = thirds.groupBy("feature").agg(*measures)
    names = spark.createDataFrame(
        [(f, f in TWO_SIDED_FEATURES) for f in TESTED_FEATURES], "feature string, two_sided boolean"
    )
    measured = F.col("gap_all").isNotNull()
    testable = (
        measured
        & F.col("gap_first").isNotNull()
        & F.col("gap_second").isNotNull()
        & (F.least("failures_first", "failures_second") >= p.min_sample)
    )
    holds = (
        testable
        & ~F.col("two_sided")
        & (F.col("gap_first") >= p.min_gap_points)
        & (F.col("gap_second") >= p.min_gap_points)
    )
    return (
        names.join(wide, "feature", "left")
        .withColumns(
            {
                "measurable": measured,
                "testable": F.coalesce(testable, F.lit(False)),
                "holds": F.coalesce(holds, F.lit(False)),
            }
        )
        .select(
            "feature",
            "two_sided",
            "measurable",
            F.when(measured, F.col("gap_all")).alias("gap_all"),
            F.when(measured, F.col("gap_first")).alias("gap_first"),
            F.when(measured, F.col("gap_second")).alias("gap_second"),
            F.when(measured, F.col("failures_first")).alias("failures_first"),
            F.when(measured, F.col("failures_second")).alias("failures_second"),
            "testable",
            "holds",
        )
    )


def study_violations(features: DataFrame) -> DataFrame:
    """Rows whose label is not one of the three outcomes."""
    return features.where(~F.col("label").isin(*OUTCOMES) | F.col("label").isNull()).select("label").distinct()


def check_study_columns(features: DataFrame) -> None:
    absent = [c for c in (*TESTED_FEATURES, "label", "session_date") if c not in features.columns]
    if absent:
        raise ValueError(f"feature table lacks {absent}")


def family_error(n_tests: Column, p: Params) -> Column:
    """Chance that at least one of n independent tests passes by luck."""
    return 1 - F.pow(F.lit(1 - p.family_error_rate), n_tests)


def study_verdict(features: DataFrame, p: Params) -> DataFrame:
    """The study in one row."""
    check_study_columns(features)
    found = feature_findings(features, p).agg(
        F.max(F.col("testable") & ~F.col("two_sided")).alias("any_testable"),
        F.max("holds").alias("any_holds"),
        F.count("*").cast("bigint").alias("n_tested"),
        count_when(~F.col("two_sided")).alias("n_directional"),
        count_when(F.col("testable")).alias("n_testable"),
        count_when(F.col("holds")).alias("n_holding"),
    )
    busted = F.col("label") == "BUSTED"
    totals = (
        features.join(F.broadcast(split_date(features, p)))
        .agg(
            F.count("*").alias("n_breakouts"),
            (F.avg(busted.cast("double")) * 100).alias("base_rate_pct"),
            F.max("split_date").alias("split_date"),
            count_when(busted & (F.col("session_date") >= F.col("split_date"))).alias("second_half_failures"),
        )
    )
    return totals.join(F.broadcast(found)).select(
        "n_breakouts",
        "base_rate_pct",
        "split_date",
        "second_half_failures",
        "n_tested",
        "n_directional",
        "n_testable",
        "n_holding",
        family_error(F.col("n_directional"), p).alias("family_error"),
        F.when(~F.col("any_testable"), F.lit("insufficient_sample"))
        .when(F.col("any_holds"), F.lit("signal"))
        .otherwise(F.lit("no_signal"))
        .alias("verdict"),
    )



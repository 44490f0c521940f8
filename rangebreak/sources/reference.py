"""Small reference files: universe, holidays, expiries, instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_universe(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line, trimmed; blank lines are dropped."""
    return (
        spark.read.text(path)
        .select(F.trim("value").alias("symbol"))
        .where(F.length("symbol") > 0)
    )


def universe_violations(symbols: DataFrame) -> DataFrame:
    repeated = symbols.groupBy("symbol").count().where("count > 1").select(
        F.concat(F.lit("duplicate symbol "), "symbol").alias("violation")
    )
    empty = symbols.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit("the universe is empty").alias("violation")
    )
    return repeated.unionByName(empty)


def scan_holidays(spark: SparkSession, path: str) -> DataFrame:
    """``date, name[, source]`` with a header; a date that does not parse fails the read."""
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(F.trim("date").cast("date").alias("date"), "name")


def scan_expiries(spark: SparkSession, path: str) -> DataFrame:
    """A ``date`` column; blanks are skipped and repeats merged."""
    rows = spark.read.option("header", True).csv(path)
    return (
        rows.where(F.length(F.trim("date")) > 0)
        .select(F.trim("date").cast("date").alias("date"))
        .distinct()
    )


def unresolved_symbols(universe: DataFrame, instruments: DataFrame) -> DataFrame:
    """Universe symbols without an equity instrument: reported, never substituted."""
    listed = instruments.where("instrument_type = 'EQ'").select(F.col("tradingsymbol").alias("symbol"))
    return universe.join(listed, "symbol", "left_anti")

"""Window specifications and small table-shaped helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SESSION = ["symbol", "session_date"]


def in_session():
    """Bars of one session up to the current one."""
    return W.partitionBy(*SESSION).orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)


def whole_session():
    return W.partitionBy(*SESSION).orderBy("slot").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )


def by_session():
    """One row per session of a symbol, in date order. Its length is bounded by the calendar."""
    return W.partitionBy("symbol").orderBy("session_date")


class InputError(ValueError):
    """A table breaks a rule under which results would be wrong."""


def require_none(violations: DataFrame, message: str) -> None:
    """Raise if a violations table holds any row. Reads at most one row to the driver."""
    found = violations.limit(1).collect()
    if found:
        raise InputError(f"{message}: {found[0].asDict()}")


def stage_root(spark: SparkSession) -> str:
    """Shared folder for written stages: the one that the session names."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return configured


#: Per Spark application and stage name: the plans written, their input files and where they are.
_written: dict[tuple[str, str], list[tuple[DataFrame, frozenset[str], str]]] = {}


def write_stage(df: DataFrame, name: str, reuse: bool = False) -> DataFrame:
    """Write an intermediate table that several later branches read, and read it back.

    Columnar files in shared storage survive lost executors and let each branch prune columns.
    With ``reuse`` an equal plan over the same input files, written earlier by this application under this
    name, is read again in place of a second copy.
    """
    spark = df.sparkSession
    kept = _written.setdefault((spark.sparkContext.applicationId, name), [])
    files = frozenset(df.inputFiles()) if reuse else frozenset()
    for plan, read, path in kept if reuse else ():
        if read == files and plan.sameSemantics(df):
            return spark.read.schema(df.schema).parquet(path)
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if reuse:
        kept.append((df, files, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, name: str) -> Iterator[DataFrame]:
    """As ``write_stage``, in buckets of ``key``: joins on it inside the block move the other side only.

    The table is gone at the end of the block, from the catalog and from the shared folder, so what is
    read from it must be written by then.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = f"stage_{uuid.uuid4().hex}"
    spark.sql(f"create database {base} location '{stage_root(spark)}/{base}'")
    try:
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).saveAsTable(f"{base}.{name}")
        yield spark.table(f"{base}.{name}")
    finally:
        spark.sql(f"drop database {base} cascade")


def unpivot_features(df: DataFrame, features, keys) -> DataFrame:
    """Long form ``keys, feature, value`` with missing values left out."""
    cells = [
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features
    ]
    return (
        df.select(*keys, F.explode(F.array(*cells)).alias("cell"))
        .select(*keys, "cell.feature", "cell.value")
        .where(F.col("value").isNotNull())
    )

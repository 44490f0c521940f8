"""Persisted stage results and the rule against stale ones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIFACTS = (
    "breakouts",
    "features",
    "predictions",
    "predictions_average",
    "backtest_results",
    "backtest_summary",
    "study",
)


def artifact_path(root: str, name: str) -> str:
    if name not in ARTIFACTS:
        raise ValueError(f"unknown artifact {name!r}")
    return f"{root}/{name}"


class StaleArtifact(RuntimeError):
    """An artifact was made from older features than the current ones."""


_VERSION = "features_version"


def save_artifact(df: DataFrame, root: str, name: str, version: int) -> None:
    """Write a result, nested columns included, with the version of the features it was made from in its schema."""
    first = df.schema.fields[0]
    marked = df.withMetadata(first.name, {**first.metadata, _VERSION: version})
    marked.write.mode("overwrite").parquet(artifact_path(root, name))


def artifact_version(df: DataFrame) -> int | None:
    """The version in the schema of a loaded artifact; None if it was written without one."""
    found = [f.metadata[_VERSION] for f in df.schema.fields if _VERSION in f.metadata]
    return found[0] if found else None


def load_artifact(spark: SparkSession, root: str, name: str, current_version: int | None = None) -> DataFrame:
    """Read a result back. An absent one raises, and so does one of older features where a version is asked for."""
    try:
        df = spark.read.parquet(artifact_path(root, name))
    except AnalysisException as exc:
        raise FileNotFoundError(f"no {name} under {root}; run the stage that writes it first") from exc
    version = artifact_version(df)
    if current_version is not None and (version is None or version < current_version):
        raise StaleArtifact(f"{name} was made from features {version}, the current ones are {current_version}")
    return df


def stale_artifact_filter(
    artifacts: DataFrame, current_version: int, verdict: DataFrame, gated: tuple[str, ...] = ("failed_orb",)
) -> DataFrame:
    """Artifacts of the current features; a gated setup also needs an open gate.

    ``artifacts`` carries ``setup`` and ``features_version``; ``verdict`` is the study. The gate is open if
    there is a verdict and each one says so.
    """
    opened = verdict.agg(F.coalesce(F.bool_and(F.coalesce(F.col("verdict") == "signal", F.lit(False))), F.lit(False)).alias("gate_open"))
    return (
        artifacts.where(F.col(_VERSION) >= current_version)
        .join(F.broadcast(opened))  # one row
        .where(~F.col("setup").isin(*gated) | F.col("gate_open"))
        .drop("gate_open")
    )

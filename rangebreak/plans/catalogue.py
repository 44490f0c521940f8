"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rangebreak.plans.fixtures import Fixture
from rangebreak.plans.present import present
from rangebreak.plans.sql.compose import statement

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SQL: dict[str, tuple[str, str]] = {}


def query(key: str, grid: str, sql: str | None = None, digits: int = 6, stage: bool = False):
    """Register a function of a fixture under ``key``, with the SQL that must agree with it.

    ``stage`` writes the bars first, for plans that read them on more than one branch.
    """

    def register(build: Callable[[Fixture], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(build(Fixture(spark, sf_dir, grid, stage)), digits)

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            _SQL[key] = (sql, grid)
        return build

    return register


def sql_statements() -> dict[str, str]:
    """Every registered SQL text as a standalone statement."""
    return {key: statement(sql, grid) for key, (sql, grid) in _SQL.items()}

"""Every registered query, imported for its side effect of registration."""

from rangebreak.plans import delivery, market, outcome, research, trading  # noqa: F401
from rangebreak.plans.catalogue import QUERIES, sql_statements

__all__ = ["QUERIES", "sql_statements"]

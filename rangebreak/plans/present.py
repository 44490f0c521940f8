"""Shape results for comparison: text dates and times, rounded doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    columns = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind in ("date", "timestamp", "timestamp_ntz"):
            column = column.cast("string")
        elif kind == "double":
            # Half-up by floor arithmetic; adding zero turns a negative zero into a plain one.
            scale = F.lit(float(10**digits))
            column = F.floor(column * scale + 0.5) / scale + F.lit(0.0)
        elif kind in ("tinyint", "smallint", "int"):
            column = column.cast("bigint")
        elif kind == "array<string>":
            column = F.array_join(column, "; ")
        columns.append(column.alias(name))
    return df.select(*columns)

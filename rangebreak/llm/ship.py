"""Send this package's code to the executors' Python, which may not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SENT = "_rangebreak_code"


def ship_code(spark: SparkSession) -> None:
    """Once per Spark context; the driver serves the archive, so no shared folder is needed."""
    context = spark.sparkContext
    if getattr(context, _SENT, None):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-code-"), "rangebreak_code.zip")
    top = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, top))
    context.addPyFile(path)
    setattr(context, _SENT, path)

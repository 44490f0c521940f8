"""A local session for tests and the benchmark. A cluster brings its own session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, name: str = "rangebreak") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    name_shared_folder(spark)
    return spark


def name_shared_folder(spark: SparkSession) -> None:
    """Name a folder for written stages where none is named and the driver is the whole cluster.

    It is removed when the process ends. On a cluster the setting is the cluster's to make.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="spark-stages-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)

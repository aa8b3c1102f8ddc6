"""Session for local runs, and the package for the workers of any session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", name: str = "jobweave", memory: str = "12g") -> SparkSession:
    threads = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, as `--py-files` would.

    Page parsing and vector blocks run functions of this package inside the tasks.
    """
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="jobweave-"), "jobweave")
        parent, name = os.path.split(package)
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root_dir=parent, base_dir=name))
        _SHIPPED.add(application)

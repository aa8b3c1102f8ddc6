"""Where jobs keep checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one the session names; only a local session may fall back to a scratch folder."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="jobweave-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows written to the shared folder, computed once, with a short lineage."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def stored(rows: DataFrame, path: str) -> DataFrame:
    """The rows written to a folder as Parquet and read back, for tables that are read many times or with others."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

"""Settings that the library needs from a session."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder it lies in, wherever they were started."""
    root, here = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in here.get("PYTHONPATH", "").split(":"):
        here["PYTHONPATH"] = ":".join(filter(None, [root, here.get("PYTHONPATH")]))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, with its lineage cut.

    The folder is the one in ``spark.checkpoint.dir``. Only where that is unset, and the session runs in one process, a
    folder of this machine is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)

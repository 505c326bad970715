"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamlens.session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data set in ``sf_dir`` (one file or a folder of part files)."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Versions of the index as Parquet folders, with a pointer to the current one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loamlens.operators.catalog import incremental_changes, upserted


class SnapshotStore:
    """A table kept as numbered folders below ``root``; a one-row table ``pointer`` names the version that readers see.

    A version is written whole before the pointer is, so a job that fails leaves the version before it in force.
    """

    def __init__(self, spark: SparkSession, root: str, *, key: Sequence[str] = ("repo", "path")):
        self.spark, self.root, self.key = spark, root.rstrip("/"), tuple(key)

    def version(self) -> int:
        """The number of the current version, 0 for none."""
        try:
            row = self.spark.read.parquet(f"{self.root}/pointer").agg(F.max("version").alias("v")).first()
        except AnalysisException:
            return 0
        return row.v or 0

    def read(self) -> DataFrame | None:
        at = self.version()
        return self.spark.read.parquet(f"{self.root}/v{at}") if at else None

    def _publish(self, rows: DataFrame) -> int:
        at = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/v{at}")
        self.spark.range(1).select(F.lit(at).alias("version"), F.current_timestamp().alias("indexed_at")).write.mode("append").parquet(f"{self.root}/pointer")
        return at

    def replace(self, rows: DataFrame) -> int:
        """A version with these rows only."""
        return self._publish(rows)

    def refresh(self, rows: DataFrame) -> DataFrame:
        """A version with the rows of a new scan; keys that are gone leave it. Returns key and status of every record."""
        before = self.read()
        statuses = rows.select(*self.key).distinct().withColumn("status", F.lit("new")) if before is None else incremental_changes(before, rows, key=self.key)
        self._publish(rows)
        return statuses

    def upsert(self, rows: DataFrame) -> int:
        """A version in which these rows replace those of the same key."""
        before = self.read()
        return self._publish(rows if before is None else upserted(before, rows, key=self.key))

"""Refreshing the index from a stream of file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamlens.sources.store import SnapshotStore


def refresh_stream(rows: DataFrame, store: SnapshotStore, *, checkpoint: str, order: str = "mtime") -> StreamingQuery:
    """Upsert a stream of file rows into ``store``, a version per batch; of rows with one key in a batch the one with the
    greatest ``order`` counts. Ends when all that is there has been taken."""

    def take(batch: DataFrame, _: int) -> None:
        others = [c for c in batch.columns if c not in store.key and c != order]
        newest = batch.groupBy(*store.key).agg(F.max(F.struct(order, *others)).alias("r")).select(*store.key, "r.*")
        store.upsert(newest.select(*batch.columns))

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

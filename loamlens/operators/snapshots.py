"""What changed between full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_sequence(deliveries: DataFrame, *, unit: Sequence[str], snapshot: str, status: str = "status", full: str = "full") -> DataFrame:
    """One row per unit with the sorted array ``_snaps`` of the snapshots that were delivered in full.

    Deliveries that are repeated, not full, or whose snapshot is null are left out. The array has one entry per delivery of
    a unit, so it is as long as the history of that unit.
    """
    return (
        deliveries.where((F.col(status) == full) & F.col(snapshot).isNotNull())
        .groupBy(*unit)
        .agg(F.sort_array(F.collect_set(snapshot)).alias("_snaps"))
    )


def snapshot_changes(
    rows: DataFrame,
    deliveries: DataFrame,
    *,
    unit: Sequence[str],
    key: Sequence[str],
    compare: Sequence[Column],
    newest: Sequence[str],
    snapshot: str = "snap_id",
) -> DataFrame:
    """Added, removed and changed keys between consecutive full snapshots of each unit.

    ``unit`` are the columns that name what is delivered as a whole, ``key`` those that name a record within it,
    ``compare`` the expressions whose difference makes a record changed and ``newest`` the columns by which one of several
    rows of a key in one snapshot is chosen: the greatest, nulls last.

    Validity intervals are the islands of a key with one row hash in adjacent snapshots. A start that has no neighbour
    before it is ``added`` (unless it lies in the first snapshot of the unit, which has nothing to be compared with), a
    start next to the end of the interval before is ``changed``, an end without a neighbour behind it is ``removed`` (unless
    it lies in the last snapshot). Result: snapshot (the later of the two), unit, key, change_kind, each case once.

    Nulls in unit, key or compared columns are values like others. Rows of snapshots without a full delivery don't count; a
    full delivery without rows removes all keys. Empty tables give an empty result. Other columns are ignored.

    One window over the key follows a partial aggregation, so that a key holds at most one row per snapshot however often
    rows are repeated; the deliveries are joined as they come (broadcast by size or split by the adaptive skew join).
    """
    unit, key = list(unit), list(key)
    snaps = full_sequence(deliveries, unit=unit, snapshot=snapshot)
    hashed = F.struct(F.xxhash64(*[c for x in compare for c in (x.isNull(), x)]), F.hash(*[c for x in compare for c in (x.isNull(), x)]))
    latest = (
        rows.select(*unit, *[k for k in key if k not in unit], snapshot, F.struct(*newest, hashed.alias("h")).alias("_row"))
        .groupBy(*unit, *[k for k in key if k not in unit], snapshot)
        .agg(F.max("_row").alias("_row"))
    )
    on = [latest[c].eqNullSafe(snaps[c]) for c in unit]
    placed = (
        latest.join(snaps, on)
        .select(*[latest[c] for c in latest.columns], "_snaps")
        .withColumn("_at", F.array_position("_snaps", F.col(snapshot)))
        .where("_at > 0")
    )
    of_key = [*unit, *[k for k in key if k not in unit]]
    by_key = Window.partitionBy(*of_key).orderBy("_at")
    starts = placed.withColumn("_before", F.lag("_at").over(by_key)).withColumn("_hash_before", F.lag("_row.h").over(by_key))
    next_at = F.lead("_at").over(by_key)
    touches = F.col("_before") == F.col("_at") - 1
    begins = (
        F.when(touches & F.col("_hash_before").eqNullSafe(F.col("_row.h")), F.lit(None).cast("string"))
        .when(touches, F.lit("changed"))
        .when(F.col("_at") > 1, F.lit("added"))
    )
    ends = F.when((F.col("_at") < F.size("_snaps")) & (F.coalesce(F.col("_next"), F.lit(0)) != F.col("_at") + 1), F.lit("removed"))
    return (
        starts.withColumn("_next", next_at)
        .select(
            *of_key,
            F.explode(
                F.filter(
                    F.array(
                        F.struct(F.col("_at").alias("at"), begins.alias("change_kind")),
                        F.struct((F.col("_at") + 1).alias("at"), ends.alias("change_kind")),
                    ),
                    lambda e: e["change_kind"].isNotNull(),
                )
            ).alias("_e"),
            "_snaps",
        )
        .select(F.element_at("_snaps", F.col("_e.at").cast("int")).alias(snapshot), *of_key, F.col("_e.change_kind").alias("change_kind"))
        .distinct()
    )

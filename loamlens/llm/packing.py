"""Filling fixed-capacity containers with items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlens.session import checkpointed

#: More kinds of containers than this are refused, as every item is placed once for each.
MAX_KINDS = 64


@dataclass
class OpenBins:
    """Bounded-space best fit: at most ``limit`` open bins of ``capacity``, kept by free space.

    Bit f of ``free`` says that an open bin has f units left, so the lowest bit from the item's size on is the best fit and
    the lowest bit of all is the fullest bin, which closes first when room for a new bin is needed.
    """

    capacity: int
    limit: int
    free: int = 0
    open: dict[int, list[int]] = field(default_factory=dict)
    n_open: int = 0
    n_bins: int = 0
    closed: set[int] = field(default_factory=set)

    def _put(self, bin_no: int, left: int) -> None:
        self.open.setdefault(left, []).append(bin_no)
        self.free |= 1 << left
        self.n_open += 1

    def _take(self, left: int) -> int:
        bins = self.open[left]
        bin_no = bins.pop()
        if not bins:
            del self.open[left]
            self.free &= ~(1 << left)
        self.n_open -= 1
        return bin_no

    def add(self, size: int) -> int:
        """The number of the bin that takes an item of ``size``, which is at most the capacity."""
        fits = self.free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            bin_no = self._take(left)
        else:
            if self.n_open >= self.limit:
                self.closed.add(self._take((self.free & -self.free).bit_length() - 1))
            left, bin_no = self.capacity, self.n_bins
            self.n_bins += 1
        self._put(bin_no, left - size)
        return bin_no


def _pack_once(items: DataFrame, shards: DataFrame, open_bins: int, level: int) -> DataFrame:
    """One run over the items, in shards that are packed each on its own.

    Items of one shard come in the order of a hash, so that sizes are mixed. ``kept``: the bin had been closed, or at the
    end was full to a hundredth; the items of the other bins can be packed again.
    """

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["mix", "item_key", "piece"], kind="stable", na_position="first")
        capacity = int(group["capacity"].iloc[0])
        bins = OpenBins(capacity, open_bins)
        place = [bins.add(int(s)) for s in group["size"]]
        loose = {b for left, bs in bins.open.items() if left * 100 > capacity for b in bs}
        return pd.DataFrame(
            {
                "container_id": group["container_id"], "capacity": group["capacity"], "item_key": group["item_key"], "piece": group["piece"], "size": group["size"],
                "bin_id": [f"{level}-{key[1]}-{b}" for b in place], "kept": [b not in loose for b in place],
            }
        )

    sharded = items.join(F.broadcast(shards), "container_id").withColumn("mix", F.xxhash64("item_key", "piece", F.lit(level)))
    kind = items.schema["item_key"].dataType.simpleString()
    return (
        sharded.withColumn("shard", F.pmod(F.col("mix"), F.col("n_shards")))
        .groupBy("container_id", "shard")
        .applyInPandas(pack, f"container_id bigint, capacity bigint, item_key {kind}, piece int, size bigint, bin_id string, kept boolean")
    )


def packed(
    sizes: DataFrame,
    containers: DataFrame,
    *,
    key: str = "doc_id",
    size: str = "n_tokens",
    open_bins: int = 256,
    items_per_shard: int = 50_000,
) -> DataFrame:
    """Every item placed once for each kind of container: container_id, capacity, key, piece, size, bin_id.

    Bounded-space online best fit (see :class:`OpenBins`) in shards of about ``items_per_shard`` items, which bounds what a
    task holds however many items there are. What the bins that are still open at the end of a shard hold is packed once
    more, in shards of the same size over what is left of all, so that few bins stay badly filled.

    An item larger than the capacity is cut into full pieces (each a bin of its own) and a rest, numbered by ``piece`` from
    0; no other item is split. Items of size 0, negative or null size count as 0 and are placed as well. Items with the same
    key are placed each, null keys too. Containers without a positive capacity are left out; repeated container rows count
    once; more than ``MAX_KINDS`` kinds are refused. Empty tables give an empty result.

    The kinds of containers, a bounded handful, go through the driver; items never do. Sizes are kept in the checkpoint
    folder, so that they are computed once.
    """
    kinds = containers.where("container_id IS NOT NULL AND capacity > 0").select(F.col("container_id").cast("bigint"), F.col("capacity").cast("bigint")).distinct().limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    once = checkpointed(sizes.select(F.col(key).alias("item_key"), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint")).alias("size")))
    pairs = F.array(*[F.struct(F.lit(k.container_id).cast("bigint").alias("container_id"), F.lit(k.capacity).cast("bigint").alias("capacity")) for k in kinds])
    if not kinds:
        pairs = F.array().cast("array<struct<container_id:bigint,capacity:bigint>>")
    wanted = once.select("item_key", "size", F.explode(pairs).alias("k")).select("item_key", "size", "k.*")
    full = F.when(F.col("size") > F.col("capacity"), F.floor((F.col("size") - 1) / F.col("capacity")).cast("int")).otherwise(F.lit(0))
    cut = wanted.withColumn("n_full", full)
    columns = ["container_id", "capacity", "item_key", "piece", "size", "bin_id"]
    whole = (
        cut.where("n_full > 0")
        .withColumn("number", F.monotonically_increasing_id())
        .select("container_id", "capacity", "item_key", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("piece"), F.col("capacity").alias("size"), "number")
        .withColumn("bin_id", F.concat_ws("-", F.lit("0"), F.hex("number"), "piece"))
        .select(*columns)
    )
    items = cut.select("container_id", "capacity", "item_key", F.col("n_full").alias("piece"), (F.col("size") - F.col("n_full") * F.col("capacity")).alias("size"))

    def shards(of: DataFrame) -> DataFrame:
        return of.groupBy("container_id").agg(F.greatest(F.lit(1).cast("bigint"), F.ceil(F.count(F.lit(1)) / items_per_shard)).alias("n_shards"))

    first = checkpointed(_pack_once(items, shards(items), open_bins, 1))
    loose = first.where("NOT kept").drop("kept", "bin_id")
    again = _pack_once(loose, shards(loose), open_bins, 2)
    result = first.where("kept").select(*columns).unionByName(again.select(*columns)).unionByName(whole)
    return result.withColumnRenamed("item_key", key)


def packing_report(placed: DataFrame) -> DataFrame:
    """Of each kind: its bins, the tokens in them, the fewest bins that could hold them and the share of room left unused."""
    return (
        placed.groupBy("container_id", "capacity", "bin_id")
        .agg(F.sum("size").alias("used"))
        .groupBy("container_id", "capacity")
        .agg(F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("n_tokens"))
        .withColumn("least_bins", F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint"))
        .withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")), 6))
    )

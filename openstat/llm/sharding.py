"""Sharding over fixed virtual slots.

A record hashes into one of thousands of slots for good; a small versioned table
says which shard owns a slot. Adding a shard or evening out bytes edits that table
and moves whole slots, never single records.

Maps are versions of one stored table (`SlotMaps`): each edit is written as a new version
in the shared folder, readers take the newest or one that they name.

`growth_map` depends on the numbers of slots and shards only: each new shard takes
an even share of slots from the others and nothing moves between the old ones.
`rebalance` edits a map by the bytes measured per slot. Null ids share one slot;
null text has size 1; empty input gives no rows.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from openstat.session import shared_dir

SLOTS = 4096
#: Parts of a slot that are put in order apart from one another.
PARTS = 8
MAP_SCHEMA = "version int, slot int, shard int"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


def growth_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Owner of each slot after growing from one shard to `shards`."""
    if not 1 <= shards <= slots:
        raise ValueError("there must be at least one slot for each shard")
    owner, held = [0] * slots, {0: list(range(slots))}
    for new in range(1, shards):
        heap = [(-len(mine), shard) for shard, mine in held.items()]
        for shard, mine in held.items():
            mine.sort(key=lambda slot: xxhash.xxh3_64_intdigest(f"{slot}:{new}"))
        heapq.heapify(heap)
        held[new] = []
        for _ in range(slots // (new + 1)):
            n, shard = heap[0]
            slot = held[shard].pop()
            heapq.heapreplace(heap, (n + 1, shard))
            held[new].append(slot)
            owner[slot] = new
    return owner


def map_version(spark: SparkSession, owner: list[int], version: int) -> DataFrame:
    return spark.createDataFrame(
        [(version, slot, shard) for slot, shard in enumerate(owner)], MAP_SCHEMA
    )


@dataclass
class SlotMaps:
    """The versions of a slot map, each a folder `version=n` of one table; the newest counts."""

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None) -> SlotMaps:
        return cls(spark, path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")

    def publish(self, owner: list[int], version: int) -> SlotMaps:
        """Write a version; one that is there already is an error, never overwritten."""
        rows = map_version(self.spark, owner, version).drop("version").coalesce(1)
        rows.write.mode("error").parquet(f"{self.path}/version={version}")
        return self

    def versions(self) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(self.path)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, one per slot, or of the newest."""
        table = self.versions()
        chosen = table.agg(F.max("version")).first()[0] if version is None else version
        return table.filter(F.col("version") == chosen)

    def owner(self, version: int | None = None) -> list[int]:
        rows = sorted((r["slot"], r["shard"]) for r in self.read(version).collect())  # one per fixed slot
        return [shard for _, shard in rows]


def slot_weights(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> dict[int, int]:
    """Bytes of the records in each slot: one aggregate, at most an entry per fixed slot."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    rows = slot_bytes(records.select(slot_of(F.col(id_col), slots).alias("vslot"), size.alias("size"))).collect()
    return {r["vslot"]: r["bytes"] for r in rows}


def slot_bytes(records: DataFrame, slot: str = "vslot", size: str = "size") -> DataFrame:
    return records.groupBy(slot).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))


def rebalance(owner: list[int], weights: dict[int, int], shards: int) -> list[int]:
    """The map edited so that shards hold near equal bytes, moving few slots.

    `weights`: bytes per slot, at most one entry for each of the fixed slots. A slot
    moves from the fullest to the emptiest shard while that lowers the larger of both.
    """
    owner, load, held = list(owner), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += weights.get(slot, 0)
        held[shard].append(slot)
    for _ in range(len(owner)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fits = [s for s in held[high] if 0 < weights.get(s, 0) < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap - 2 * weights[s]), s))
        held[high].remove(slot)
        held[low].append(slot)
        load[high] -= weights[slot]
        load[low] += weights[slot]
        owner[slot] = low
    return owner


def assign_shards(
    records: DataFrame, slot_map: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    slots: int = SLOTS, order: tuple[str, ...] = (),
) -> DataFrame:
    """`records` with size, text_crc32, vslot, shard and slot (0, 1, ... within the shard).

    `slot_map` holds one version: a row for each of the fixed slots, so it may be
    broadcast. Positions come from one count per part of a slot and an order within the part;
    no window over records spans a slot. Columns of these names in `records` are replaced.
    """
    text = F.col(text_col)
    made = {
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
        "vslot": slot_of(F.col(id_col), slots),
    }
    names = {"size", "text_crc32", "vslot", "shard", "slot", "_part", "_turn", "_first"} - {id_col, text_col}
    rows = records.drop(*names).withColumns(made)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(id_col, "text_crc32"), F.lit(PARTS)).cast("int"))
    owners = F.broadcast(slot_map.select(F.col("slot").alias("vslot"), "shard"))
    counts = rows.groupBy("vslot", "_part").agg(F.count("*").alias("rows")).join(owners, "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        "vslot", "_part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_first")
    )
    within = Window.partitionBy("vslot", "_part").orderBy(id_col, "text_crc32", "size", *order)
    placed = rows.withColumn("_turn", F.row_number().over(within))
    return (
        placed.join(F.broadcast(first), ["vslot", "_part"])
        .withColumn("slot", (F.col("_first") + F.col("_turn") - 1).cast("long"))
        .drop("_turn", "_first", "_part")
    )

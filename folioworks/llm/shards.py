"""Sharding by fixed virtual slots.

A record is hashed into one of thousands of slots, for good. Bytes are summed per slot, and a versioned table says which
shard holds which slot. Rebalancing edits that table: single slots move, or change places, from the fullest shard to the
emptiest. Only the slot table, whose size is fixed by `slots` and not by the data, is seen by the driver.

A null text has no bytes; a null id is a value like any other. Repeated rows are rows of their own: they share a slot and
follow each other in it. Extra columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks.llm import common

SLOTS = 4096
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: The map is near enough when the fullest and the emptiest shard differ by this part of the mean.
TOLERANCE = 0.001


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds which slot, and how often that was edited."""

    version: int
    shard_of: tuple[int, ...]


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every record, written once: later steps read no texts."""
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"), common.crc(F.col("text")).alias("text_crc32"))
    return common.written(slim.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")), "shard-records")


def loads(recs: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows): one row per slot in use, as many as there are slots at most."""
    return [tuple(r) for r in recs.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect()]


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    return SlotMap(0, tuple(s % shards for s in range(slots)))


def rebalance(old: SlotMap, slot_bytes: dict[int, int], shards: int) -> SlotMap:
    """The next version of the map: slots move, or swap, between the fullest and the emptiest shard while that closes their gap."""
    shard_of = list(old.shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, n in sorted(slot_bytes.items()):
        held[shard_of[slot]].append((n, slot))
    for h in held:
        h.sort()
    total = [sum(n for n, _ in h) for h in held]
    near = TOLERANCE * sum(total) / shards
    for _ in range(4 * len(shard_of)):
        hi, lo = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[hi] - total[lo]
        if gap <= near:
            break
        best, rest = None, gap  # what the gap is after an edit
        for give in held[hi]:
            at = bisect_left(held[lo], (give[0] - gap // 2, -1))
            for take in [(0, -1), *held[lo][max(0, at - 1) : at + 1]]:
                moved = give[0] - take[0]
                if moved > 0 and abs(gap - 2 * moved) < rest:
                    best, rest = (give, take), abs(gap - 2 * moved)
        if best is None:
            break
        for slot, src, dst in ((best[0], hi, lo), (best[1], lo, hi)):
            if slot[1] >= 0:
                held[src].remove(slot)
                held[dst].insert(bisect_left(held[dst], slot), slot)
                shard_of[slot[1]] = dst
                total[src] -= slot[0]
                total[dst] += slot[0]
    return SlotMap(old.version + 1, tuple(shard_of))


def map_table(spark: SparkSession, maps: list[SlotMap]) -> DataFrame:
    """(version, vslot, shard): every version of the map, as the table to keep beside the data."""
    out = None
    for m in maps:
        shard = F.split(F.lit(",".join(map(str, m.shard_of))), ",")[F.col("id").cast("int")].cast("int")
        part = spark.range(len(m.shard_of)).select(F.lit(m.version).alias("version"), F.col("id").cast("int").alias("vslot"), shard.alias("shard"))
        out = part if out is None else out.unionByName(part)
    return common.written(out.coalesce(1), "slot-map")


def assign(recs: DataFrame, maps: DataFrame) -> DataFrame:
    """Every record with its shard under the newest version, and its place there, from 0 without gaps.

    Places are counted inside each virtual slot, which holds a thousandth of the rows or less; a slot begins where the
    slots before it in its shard end. The map has one row per slot, so it can be broadcast.
    """
    newest = maps.agg(F.max("version").alias("version"))
    m = maps.join(newest, "version", "left_semi")
    counts = recs.groupBy("vslot").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    starts = m.join(counts, "vslot").withColumn("_start", F.coalesce(before, F.lit(0))).select("vslot", "shard", "version", "_start")
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return recs.withColumn("_nth", within).join(F.broadcast(starts), "vslot").withColumn("slot", F.col("_start") + F.col("_nth") - 1).drop("_start", "_nth")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Records spread over shards of near equal bytes: hashed to slots, mapped in turn, the map then edited by the slots' bytes."""
    recs = records(docs, slots)
    start = first_map(shards, slots)
    edited = rebalance(start, {s: n for s, n, _ in loads(recs)}, shards)
    return assign(recs, map_table(docs.sparkSession, [start, edited]))

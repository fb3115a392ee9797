"""Shards by fixed virtual slots.

A record's slot is the hash of its id and text and never changes. Which shard
holds a slot stands in a small map with a version, stored as a table; balancing
and growing edit the map, so that only the records of edited slots move.

Records of one text, and records of one id, are spread over slots like any
others: such a group may hold a third of all rows, more than a shard's share.
Only rows alike in both stay together.
"""

from __future__ import annotations

import heapq
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldframe.llm.common import shared_dir

SLOTS = 4096


class SlotMap(NamedTuple):
    """shard of each slot."""

    version: int
    shards: int
    shard: tuple[int, ...]

    @staticmethod
    def balanced(sizes: list[int], shards: int) -> SlotMap:
        """Version 1: slots by falling size, each to the shard that is lightest so far."""
        heap, out = [(0, s) for s in range(shards)], [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            held, to = heapq.heappop(heap)
            out[slot] = to
            heapq.heappush(heap, (held + sizes[slot], to))
        return SlotMap(1, shards, tuple(out))

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, to in enumerate(self.shard):
            out[to] += sizes[slot]
        return out

    def rebalanced(self, sizes: list[int], shards: int | None = None, slack: float = 0.01) -> SlotMap:
        """The next version: slots move one by one from the heaviest shard to the lightest while that brings the two closer and they differ by more than slack of the mean."""
        shards = shards or self.shards
        if shards < self.shards:
            raise ValueError("a map can only grow")
        out, grown = list(self.shard), self._replace(shards=shards)
        load = grown.loads(sizes)
        mean = sum(load) / shards
        own: list[list[int]] = [[] for _ in range(shards)]
        for slot, to in enumerate(out):
            own[to].append(slot)
        for _ in range(len(out)):
            top, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
            gap = load[top] - load[low]
            fits = [i for i in own[top] if 0 < sizes[i] < gap]
            if gap <= slack * mean or not fits:
                break
            # The slot that leaves the two closest.
            slot = min(fits, key=lambda i: (abs(gap - 2 * sizes[i]), i))
            own[top].remove(slot)
            own[low].append(slot)
            out[slot] = low
            load[top] -= sizes[slot]
            load[low] += sizes[slot]
        return SlotMap(self.version + 1, shards, tuple(out))

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table at path; a version that is there already is an error."""
        rows = [(i, s, self.shards) for i, s in enumerate(self.shard)]
        spark.createDataFrame(rows, "vslot int, shard int, shards int").coalesce(1).write.parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the map, the newest unless one is named."""
        table = spark.read.parquet(path)
        version = version or table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == version).orderBy("vslot").collect()
        return SlotMap(int(version), rows[0]["shards"], tuple(r["shard"] for r in rows))


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, text) -> doc_id, size (UTF-8 bytes and one), text_crc32, vslot.

    A null text has size 1 and the checksum of nothing; rows without an id are
    dealt by their text alone; repeated rows stay. Further columns are ignored.
    """
    data = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    return docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), _slot(slots).alias("vslot"))


def totals(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: `slots` rows reach the driver at most."""
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r["vslot"]], counts[r["vslot"]] = r["size"], r["n"]
    return sizes, counts


def placed(rows: DataFrame, plan: SlotMap, counts: list[int]) -> DataFrame:
    """rows with shard and slot: the place in the shard, gapless from 0. Slots follow each other in a shard; rows in a slot are ordered by id, checksum and size."""
    first, held = [], [0] * plan.shards
    for slot, to in enumerate(plan.shard):
        first.append(held[to])
        held[to] += counts[slot]
    table = rows.sparkSession.createDataFrame(list(zip(range(len(first)), plan.shard, first, strict=True)), "vslot int, shard int, first long")
    nth = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("nth", nth).join(F.broadcast(table), "vslot").withColumn("slot", F.col("first") + F.col("nth") - 1).drop("first", "nth")


def write_shards(docs: DataFrame, plan: SlotMap, path: str) -> None:
    """docs with all their columns under path/shard=N, without a shuffle; a column named shard is replaced."""
    to = F.element_at(F.array(*[F.lit(s) for s in plan.shard]), _slot(len(plan.shard)) + 1)
    docs.withColumn("shard", to).write.partitionBy("shard").parquet(path)


def op10_sharding(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Near equal bytes in each shard, through a map stored in the shared folder and read back from there."""
    rows = slotted(docs)
    sizes, counts = totals(rows)
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    SlotMap.balanced(sizes, shards).save(docs.sparkSession, path)
    out = placed(rows, SlotMap.load(docs.sparkSession, path), counts)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")

"""Sharding over fixed virtual slots.

A record's key hashes to one of a few thousand slots, for ever. What changes is the map of slots to shards: it is fitted
to the bytes of each slot, kept under a version, and edited slot by slot when shards fill unevenly or are added. Records
move only with their slot, and finding a record needs the hash and the map alone.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideboard.llm.common import staged, table
from tideboard.session import fresh_path

N_SLOTS, N_SHARDS, OVERHEAD = 4096, 40, 16
MAP_SCHEMA = "version int, slot int, shard int, slot_bytes long, slot_rows long, row_offset long"


@dataclass(frozen=True)
class SlotMap:
    """``shards[slot]`` is the shard that holds a slot."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            out[shard] += sizes[slot]
        return out


def fit_map(sizes: list[int], n_shards: int) -> SlotMap:
    """Version 1: the largest slot first, each to the lightest shard so far. Empty slots go round."""
    shards, heap = [0] * len(sizes), [(0, 0, shard) for shard in range(n_shards)]
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        load, held, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], held + 1, shard))
    return SlotMap(1, n_shards, tuple(shards))


def rebalance(old: SlotMap, sizes: list[int], n_shards: int, slack: float = 0.02) -> SlotMap:
    """The next version: slots leave the heaviest shard for the lightest while that shard is over the mean by more than
    ``slack`` and a move lessens the gap between the two. New shards start empty; at least as many shards as before."""
    if n_shards < old.n_shards:
        raise ValueError("a map can't lose shards")
    shards, loads = list(old.shards), old.loads(sizes) + [0] * (n_shards - old.n_shards)
    own: list[set[int]] = [set() for _ in range(n_shards)]
    for slot, shard in enumerate(shards):
        if sizes[slot]:
            own[shard].add(slot)
    most = sum(sizes) / n_shards * (1 + slack)
    while True:
        heavy, light = max(range(n_shards), key=lambda s: loads[s]), min(range(n_shards), key=lambda s: loads[s])
        gap = loads[heavy] - loads[light]
        fits = [s for s in own[heavy] if sizes[s] < gap]
        if loads[heavy] <= most or not fits:
            return SlotMap(old.version + 1, n_shards, tuple(shards))
        slot = min(fits, key=lambda s: (abs(gap / 2 - sizes[s]), s))
        own[heavy].remove(slot)
        own[light].add(slot)
        shards[slot] = light
        loads[heavy], loads[light] = loads[heavy] - sizes[slot], loads[light] + sizes[slot]


def with_slot(df: DataFrame, keys: list[str], n_slots: int = N_SLOTS, name: str = "virtual_slot") -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int"))


def slot_stats(records: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot. The driver gets one row per slot, whatever the number of records."""
    sizes, rows = [0] * n_slots, [0] * n_slots
    found = records.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    for r in found.collect():
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["size"], r["n"]
    return sizes, rows


def map_rows(slot_map: SlotMap, sizes: list[int], rows: list[int]) -> list[tuple]:
    """The stored map: with each slot, its weight and how many rows of lower slots its shard holds."""
    before, out = [0] * slot_map.n_shards, []
    for slot, shard in enumerate(slot_map.shards):
        out.append((slot_map.version, slot, shard, sizes[slot], rows[slot], before[shard]))
        before[shard] += rows[slot]
    return out


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the last if none is named."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = version or stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == version).orderBy("slot").collect()  # one row per slot
    return SlotMap(version, 1 + max(r["shard"] for r in rows), tuple(r["shard"] for r in rows))


def stored_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The last version stored; None where there is no map yet."""
    try:
        stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    version = stored.agg(F.max("version")).first()[0]
    return None if version is None else load_map(spark, path, version)


def shard_documents(
    docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None
) -> DataFrame:
    """Shard, and place in the shard, of every document: doc_id, size, text_crc32, shard, slot, virtual_slot, map_version.

    Size: UTF-8 bytes of the text plus 16; null text: 16. Hashed are doc_id and the text's crc32, so neither copies of a
    text nor documents without an id meet in one slot. The map is fitted to bytes and stored at ``map_path``; where
    one is stored, its last version is rebalanced to the bytes and shards of now and appended as the next version.
    ``slot`` counts the rows of a shard from 0 without gaps: by virtual slot, then doc_id (nulls first), crc32, size;
    rows equal in all of them take neighbouring places. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    records = staged(with_slot(narrow, ["doc_id", "text_crc32"], n_slots), "slot-records")
    sizes, rows = slot_stats(records, n_slots)
    path = map_path or fresh_path(spark, "slot-map")
    old = stored_map(spark, path) if map_path else None
    if old and len(old.shards) != n_slots:
        raise ValueError("a map can't change its number of slots")
    slot_map = rebalance(old, sizes, n_shards) if old else fit_map(sizes, n_shards)
    spark.createDataFrame(map_rows(slot_map, sizes, rows), MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stored = spark.read.schema(MAP_SCHEMA).parquet(path).filter(F.col("version") == slot_map.version)
    dim = stored.select(F.col("slot").alias("virtual_slot"), "shard", "row_offset", F.col("version").alias("map_version"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        records.withColumn("place", place.cast("long") - 1)
        .join(F.broadcast(dim), "virtual_slot")  # n_slots rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("row_offset") + F.col("place")).alias("slot"), "virtual_slot", "map_version")
    )


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40, sizes near equal."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


QUERIES = {"op7_virtual_slots": op7_virtual_slots}

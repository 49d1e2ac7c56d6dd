"""A trie over conversations: each distinct sequence of first turns is a node, with sums over its subtree.

A turn is a digest, and the digest of a prefix is the sum of its turns' digests, each salted with its position. Sums can
be taken in blocks, so no conversation, however long, has to be read by one task.

Nodes are counted in shards. A shard holds the prefixes of some conversations over one block of depths, enumerates the
distinct ones and gives each a slot by a minimal perfect hash; the digest stored in the slot is compared at every lookup.
Counts are scattered into flat arrays by slot. A first pass adds up the members of nodes that several shards hold. In the
second pass each node's own values stand in the one shard that holds its smallest member; they are accumulated along the
parents' slots from the deepest level up, and what shards have for the same node is added up. What lies deeper than a
shard's block comes in as one row at the block's end.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideboard.llm.common import staged, table

# Workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096  # depths of a shard's prefixes
SHARD = 1 << 14  # prefixes of a shard, about; at most BLOCK more of a single conversation
IDS = 10  # bits: so many conversation ids, as a power of two, are joined to one piece of text
LOAD = 1.5  # places per key left over, at each level of the perfect hash
KEY = "decimal(38,0)"  # 96-bit digests, and sums of them
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- minimal perfect hash

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class NodeTable:
    """Distinct keys of several 64-bit words, each in a slot of its own from 0 to their number less one.

    Level by level, keys that are alone at their hashed place take it; the others go on to the next level. A key's slot
    is the number of places taken before its own."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # taken or not, and the slot of the first place and on
        self.keys = np.zeros_like(keys)
        left, first = np.arange(len(keys)), 0
        while len(left):
            size = max(1, int(LOAD * len(left)))
            at = self._places(keys[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slots = first + np.cumsum(alone) - alone
            self.levels.append((alone, slots))
            placed = alone[at]
            self.keys[slots[at[placed]]] = keys[left[placed]]
            first += int(alone.sum())
            left = left[~placed]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = np.full(len(keys), 0x9E3779B97F4A7C15 * (level + 1) % (1 << 64), np.uint64)
        for word in keys.T:
            h = _mix(h ^ word) + np.uint64(0x9E3779B97F4A7C15)
        return (h % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for one that the table doesn't hold."""
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, slots) in enumerate(self.levels):
            at = self._places(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = slots[at[hit]]
            left = left[~hit]
        found = out >= 0
        found[found] = (self.keys[out[found]] == keys[found]).all(1)  # another key's place is no match
        return np.where(found, out, -1)


def _words(depth: pa.ChunkedArray, prefix: pa.ChunkedArray, up: int = 0) -> np.ndarray:
    """Keys of three words: depth, and both halves of the 128-bit prefix."""
    whole = prefix.combine_chunks()
    halves = np.frombuffer(whole.buffers()[1], np.uint64)[2 * whole.offset : 2 * (whole.offset + len(whole))].reshape(-1, 2)
    return np.column_stack([(depth.to_numpy() - up).astype(np.uint64), halves])


# --- turns and paths

def digest(text: Column) -> Column:
    """96 bits of SHA-256 as a whole number."""
    h = F.sha2(text, 256)
    high, low = (F.conv(F.substring(h, k, 12), 16, 10).cast("decimal(20,0)") for k in (1, 13))
    return (high * F.lit(1 << 48).cast("decimal(17,0)") + low).cast(KEY)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), turn_digest, n_bytes, in order of turn, null first, then digest. Turns are dealt to
    ranges of about the same size, so that a conversation with very many isn't ordered in one task."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("turn_digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = [F.asc_nulls_first("turn"), F.col("turn_digest")]
    ranged = staged(turns, "trie-turns").repartitionByRange("conv_id", *order)
    held = staged(ranged.withColumn("chunk", F.spark_partition_id()), "trie-ranges")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    offsets = sums.withColumn("offset", F.sum("n").over(before)).filter("offset > 0").drop("n")  # those cut by a range's end
    at = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(*order)) + F.coalesce("offset", F.lit(0))
    return held.join(offsets, ["conv_id", "chunk"], "left").select("conv_id", at.alias("position"), "turn_digest", "n_bytes")


def with_lengths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as paths, ``is_end`` at each last one, and conv_id, length of every conversation."""
    lengths = turns.groupBy("conv_id").agg(F.max("position").alias("length"))
    return turns.join(lengths, "conv_id").withColumn("is_end", F.col("position") == F.col("length")).drop("length"), lengths


def paths(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, block, prefix, parent, n_bytes, is_end, lead of every prefix, the root included. ``lead`` is the
    first prefix that the conversation has in the block."""
    root = lengths.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("block"), F.lit(0).cast(KEY).alias("own"),
        F.lit(0).cast("long").alias("n_bytes"), (F.col("length") == 0).alias("is_end"),
    )
    own = digest(F.concat(F.col("position").cast("string"), F.lit(":"), F.col("turn_digest").cast("string")))
    depth = F.col("position").cast("long")
    each = turns.select("conv_id", depth.alias("depth"), F.floor((depth - 1) / block).alias("block"), own.alias("own"), "n_bytes", "is_end")
    rows = root.unionByName(each)
    # Later blocks need the sums of those before; only conversations longer than a block have any.
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = each.join(each.filter(F.col("depth") == block + 1).select("conv_id"), "conv_id", "left_semi")
    carried = long.groupBy("conv_id", "block").agg(F.sum("own").alias("own")).withColumn("carry", F.sum("own").over(before))
    within = Window.partitionBy("conv_id", "block")
    local = F.sum("own").over(within.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("local", local).withColumn("lead", F.min(F.when(F.col("depth") == F.col("block") * block + 1, F.col("local"))).over(within))
    joined = summed.join(carried.filter("carry IS NOT NULL").select("conv_id", "block", "carry"), ["conv_id", "block"], "left")
    carry = F.coalesce("carry", F.lit(0).cast(KEY))
    prefix = (F.col("local") + carry).cast(KEY)
    return joined.select(
        "conv_id", "depth", "block", prefix.alias("prefix"), (prefix - F.col("own")).cast(KEY).alias("parent"), "n_bytes", "is_end",
        (F.coalesce("lead", F.lit(0).cast(KEY)) + carry).cast(KEY).alias("lead"),
    )


def dealt(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """The paths with a ``shard`` each: conversations that begin a block alike go together, unless they are too many."""
    buckets = max(1, -(-rows.count() // shard))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("block", "lead"), F.lit(buckets)))
    sizes = bucketed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / shard).alias("parts"))
    part = F.pmod(F.xxhash64("conv_id"), F.col("parts"))
    return bucketed.join(sizes, "bucket").withColumn("shard", F.struct("bucket", "block", part.alias("part"))).drop("bucket", "parts", "lead")


# --- nodes

COUNTED = f"depth long, prefix {KEY}, parent {KEY}, n_convs long, conv_id long, n_bytes long"
SUMMED = f"depth long, prefix {KEY}, saved_tokens long, n_leaves long, parent_conv_id long"


def _count(key: tuple, group: pa.Table) -> pa.Table:
    """One row per distinct prefix of a shard: members and the smallest of them."""
    keys = _words(group.column("depth"), group.column("prefix"))
    first = np.unique(keys, axis=0, return_index=True)[1]
    nodes = NodeTable(keys[first])
    slots = nodes.slots(keys)
    row = np.zeros(len(nodes), np.int64)
    row[slots[first]] = first
    n = np.bincount(slots, minlength=len(nodes))
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, slots, group.column("conv_id").to_numpy())
    out = group.select(["depth", "prefix", "parent", "n_bytes"]).take(pa.array(row))
    columns = [out.column("depth"), out.column("prefix"), out.column("parent"), pa.array(n), pa.array(least), out.column("n_bytes")]
    return _keyed(key, columns, COUNTED)


def _keyed(key: tuple, columns: list, schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    table = pa.table(columns, names)
    parts = key[0].as_py()
    for c in ("part", "block", "bucket"):
        table = table.add_column(0, c, pa.array(np.full(table.num_rows, parts[c], np.int64)))
    return table


def _accumulate(group: pa.Table) -> pa.Table:
    """Sums over the subtrees as far as they are in the shard, and the parent's smallest member where it is there."""
    keys = _words(group.column("depth"), group.column("prefix"))
    first = np.unique(keys, axis=0, return_index=True)[1]
    nodes = NodeTable(keys[first])
    slots = nodes.slots(keys)
    saved, leaves = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    np.add.at(saved, slots, group.column("saved_tokens").to_numpy())
    np.add.at(leaves, slots, group.column("n_leaves").to_numpy())
    # A carried row of a node may come first; what is the node's own stands in the other one.
    row = np.zeros(len(nodes), np.int64)
    own = np.flatnonzero(~group.column("carried").to_numpy())
    row[slots[own]] = own
    nodes_of = group.take(pa.array(row))
    depth = nodes_of.column("depth").to_numpy()
    parents = nodes.slots(_words(nodes_of.column("depth"), nodes_of.column("parent"), up=1))
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[parents[level] >= 0]
        np.add.at(saved, parents[level], saved[level])
        np.add.at(leaves, parents[level], leaves[level])
    least = nodes_of.column("conv_id").to_numpy()
    above = pa.array(least[np.maximum(parents, 0)], mask=parents < 0)
    columns = [nodes_of.column("depth"), nodes_of.column("prefix"), pa.array(saved), pa.array(leaves), above]
    return pa.table(columns, [c.split()[0] for c in SUMMED.split(", ")])


def end_hashes(rows: DataFrame) -> DataFrame:
    """depth, prefix, ends_sha256: SHA-256 of the ascending ids of the conversations that end at a node. Ids are joined
    to pieces of text in all tasks; only the hash itself, which has no other way, reads a node's pieces one after another."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = rows.filter("is_end").groupBy("depth", "prefix", F.shiftright("conv_id", IDS).alias("range")).agg(ids.alias("ids"))
    sorted_pieces = pieces.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None

        def row() -> pa.RecordBatch:
            columns = [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.decimal128(38, 0)), pa.array([hashed.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, ["depth", "prefix", "ends_sha256"])

        for batch in batches:
            done = []
            for depth, prefix, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "prefix", "ids")), strict=True):
                if now != (depth, prefix):
                    if now is not None:
                        done.append((*now, hashed.hexdigest()))
                    now, hashed = (depth, prefix), hashlib.sha256()
                else:
                    hashed.update(b",")
                hashed.update(ids.encode())
            if done:
                columns = [pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.decimal128(38, 0)), pa.array([r[2] for r in done])]
                yield pa.RecordBatch.from_arrays(columns, ["depth", "prefix", "ends_sha256"])
        if now is not None:
            yield row()

    return sorted_pieces.select("depth", "prefix", "ids").mapInArrow(run, f"depth long, prefix {KEY}, ends_sha256 string")


def _later_blocks(joined: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """Rows that bring, to the last prefix a conversation has in a block, what its later blocks hold of its own."""
    totals = joined.filter("block > 0 AND owned").groupBy(F.col("conv_id").alias("conv"), "block")
    totals = totals.agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    ends = rows.filter((F.col("depth") > 0) & (F.col("depth") % block == 0)).select("shard", F.col("conv_id").alias("conv"), "block", "depth", "prefix", "parent")
    after = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    both = ends.join(totals, ["conv", "block"], "full")
    zero = F.lit(0).cast("long")
    summed = both.select("shard", "depth", "prefix", "parent", *(F.coalesce(F.sum(c).over(after), zero).alias(c) for c in ("saved_tokens", "n_leaves")))
    return summed.filter("shard IS NOT NULL AND (saved_tokens <> 0 OR n_leaves <> 0)").select(
        "shard", "depth", "prefix", "parent", zero.alias("conv_id"), "saved_tokens", "n_leaves", F.lit(True).alias("carried")
    )


def prefix_trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. ``turns`` has conv_id, position from 1 without gaps, turn_digest, n_bytes and is_end; ``lengths`` has
    every conv_id once, those without turns too, and its length.

    The root is a node if there is any conversation. A conversation without turns ends at the root."""
    rows = staged(dealt(staged(paths(turns, lengths, block), "trie-paths"), shard), "trie-dealt")
    counted = rows.select("shard", "conv_id", "depth", "prefix", "parent", "n_bytes").groupBy("shard")
    held = staged(counted.applyInArrow(_count, "bucket long, block long, part long, " + COUNTED), "trie-shards")
    held = held.withColumn("shard", F.struct("bucket", "block", "part")).drop("bucket", "part")
    nodes = held.groupBy("depth", "prefix").agg(
        F.min("parent").alias("parent"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("n_bytes").alias("n_bytes")
    )
    nodes = staged(nodes, "trie-counts")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, ["depth", "prefix"], "left").fillna(0, ["n_children"]), "trie-nodes")

    known = nodes.select("depth", "prefix", "n_convs", F.col("conv_id").alias("least"), "n_bytes", "n_children")
    joined = held.drop("n_convs", "n_bytes").join(known, ["depth", "prefix"]).withColumn("owned", F.col("conv_id") == F.col("least"))
    zero = F.lit(0).cast("long")
    joined = joined.select(
        "shard", "depth", "block", "prefix", "parent", F.col("least").alias("conv_id"), "owned",
        F.when(F.col("owned"), (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(zero).alias("saved_tokens"),
        F.when(F.col("owned") & (F.col("n_children") == 0), zero + 1).otherwise(zero).alias("n_leaves"),
        F.lit(False).alias("carried"),
    )
    joined = staged(joined, "trie-values")
    values = joined.drop("block", "owned").unionByName(_later_blocks(joined, rows, block))
    sums = values.groupBy("shard").applyInArrow(lambda group: _accumulate(group), SUMMED)
    sums = sums.groupBy("depth", "prefix").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"), F.max("parent_conv_id").alias("parent_conv_id"))
    done = nodes.drop("n_bytes").join(sums, ["depth", "prefix"]).join(end_hashes(rows), ["depth", "prefix"], "left")
    # A block's first prefixes have their parents in another shard.
    first = (F.col("depth") > 1) & ((F.col("depth") - 1) % block == 0)
    above = nodes.filter((F.col("depth") > 0) & (F.col("depth") % block == 0))
    above = above.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("conv_id").alias("above"))
    out = done.filter(~first).withColumn("above", F.lit(None).cast("long")).unionByName(done.filter(first).join(above, ["depth", "parent"], "left"), allowMissingColumns=True)
    return out.select(
        "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text).

    Rows with a null conv_id take no part. Turns are ordered by turn, null first; turns of the same number, repeated rows
    included, by a digest of role and text. Null role or text is empty. An empty table gives no nodes; other columns
    aren't read."""
    turns, lengths = with_lengths(staged(numbered_turns(conversations), "trie-numbered"))
    return prefix_trie(turns, lengths, block, shard)


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Paths and lengths of conversations whose first turns are replaced: conversation c has the first h turns of
    conversation c - c % family, h = crc32(decimal c) % heads, then its own after its first h."""
    own = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    sized = own.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    sized = sized.join(base, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    sized = staged(sized.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-lengths")
    opening = turns.filter(F.col("position") < heads).withColumnRenamed("conv_id", "base")
    first = opening.join(sized, "base").filter("position <= h")
    rest = turns.join(sized, "conv_id").filter("position > h").withColumn("position", F.col("position") - F.col("h") + F.col("head"))
    columns = ["conv_id", "position", "turn_digest", "n_bytes", (F.col("position") == F.col("length")).alias("is_end")]
    return first.select(*columns).unionByName(rest.select(*columns)), sized.select("conv_id", "length")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = staged(numbered_turns(table(spark, sf_dir, "conversations")), "trie-numbered")
    return prefix_trie(*rebuilt(turns))


_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
_BYTES = "list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
CRC_SQL = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: {_STEP}), 4294967295)"
TWINS = {
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, sha256(strlen(r) || ':' || r || x) AS s, strlen(x) AS n_bytes FROM t),
o AS (SELECT conv_id, s, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) AS p FROM g),
i AS (SELECT conv_id, count(*) AS n, {CRC_SQL} % 9 AS h, conv_id - conv_id % 5 AS base FROM o GROUP BY conv_id),
l AS (SELECT i.conv_id, i.base, i.h, least(i.h, coalesce(j.n, 0)) AS head, least(i.h, coalesce(j.n, 0)) + greatest(i.n - i.h, 0) AS length
  FROM i LEFT JOIN i j ON j.conv_id = i.base),
f AS (SELECT l.conv_id, o.p AS d, s, n_bytes FROM l JOIN o ON o.conv_id = l.base AND o.p <= l.h
  UNION ALL SELECT l.conv_id, o.p - l.h + l.head, s, n_bytes FROM l JOIN o ON o.conv_id = l.conv_id AND o.p > l.h),
k AS (SELECT conv_id, 0::BIGINT AS d, '' AS k, NULL AS up, 0 AS n_bytes FROM l
  UNION ALL SELECT conv_id, d, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY d), coalesce(string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), n_bytes FROM f),
n AS (SELECT k, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(n_bytes) AS n_bytes FROM k GROUP BY k, d),
c AS (SELECT up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.k = n.k),
a AS (SELECT k.k, sum((w.n_convs - 1) * w.n_bytes) AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
  FROM w JOIN k ON k.conv_id = w.conv_id AND k.d <= w.d GROUP BY k.k),
e AS (SELECT k.k, sha256(string_agg(k.conv_id::VARCHAR, ',' ORDER BY k.conv_id)) AS ends FROM k JOIN l ON l.conv_id = k.conv_id AND l.length = k.d GROUP BY k.k)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, a.n_leaves, a.saved_tokens::BIGINT AS saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM w JOIN a ON a.k = w.k LEFT JOIN w u ON u.k = w.up AND w.d > 0 LEFT JOIN e ON e.k = w.k"""
}
QUERIES = {"op11_prefix_trie": op11_prefix_trie}

"""Hard negatives by vertical scans of decomposed vectors (BOND).

Vectors lie in blocks, one column per dimension, with the least and largest value of each. For an anchor the columns are
read in the order of its largest components. After every few columns, what the unread ones can still add lies between
two sums of per-column bounds, so a candidate whose score can no longer be among those wanted leaves the bitmap. What is
left when all columns are read has exact integer scores.

A first scan finds each anchor's best rows of its own label, a second one the rows of other labels inside the score
windows that these positives open. Anchors and data blocks meet in tasks of a bounded size; each hands on at most as
many rows per anchor and window as are wanted, and these are merged by rank.
"""

from __future__ import annotations

import sys
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideboard.llm.common import staged, table

# Workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
BLOCK_ROWS, BLOCKS, ANCHORS = 4096, 4, 512  # rows of a data block; data blocks, and anchors, that meet in one task
MOST_TASKS = 20_000
STRIDE = 8  # columns between two looks at the bounds
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

BLOCK_SCHEMA = "dim int, part long, ids binary, labels binary, columns binary"
ANCHOR_SCHEMA = "dim int, part long, keys binary, ids binary, labels binary, vectors binary, counts binary, positive_ids binary, positive_scores binary"
FOUND_SCHEMA = "anchor_key long, anchor_id long, place int, positive_id long, positive_score long, vec_id long, score long"


def scaled(embedding: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, a whole number in a double; null if one is null or not finite."""

    def whole(v: Column) -> Column:
        y = v.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles have no fraction

    x = F.transform(F.col(embedding), whole)
    plain = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(plain, F.lit(False)), x)


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row_key, vec_id, label, dim, vector: the rows that take part, repeated ones once."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), scaled(scale=scale).alias("vector"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").dropDuplicates(["vec_id", "label", "vector"])
    return rows.select(F.xxhash64("vec_id", "label", "vector").alias("row_key"), "vec_id", "label", F.size("vector").alias("dim"), "vector")


def _longs(column) -> bytes:
    return np.ascontiguousarray(column.to_numpy(), np.int64).tobytes()


def _matrix(group: pa.Table) -> np.ndarray:
    lists = group.column("vector").combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, group.column("dim")[0].as_py())


def _parted(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows dealt evenly into parts of about ``most`` rows of one dimension, and dim, parts."""
    sizes = staged(rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")), "bond-sizes")
    return rows.join(sizes, "dim").withColumn("part", F.pmod("row_key", F.col("parts"))).drop("parts"), sizes


def decompose(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """A row per block of vectors, its values one column after another, and dim, parts."""

    def pack(group: pa.Table) -> pa.Table:
        values = [group.column("dim")[0].as_py(), group.column("part")[0].as_py(), _longs(group.column("vec_id")), _longs(group.column("label"))]
        columns = np.ascontiguousarray(_matrix(group).T)
        small = columns.astype(np.int32) if np.abs(columns).max(initial=0) < 1 << 31 else None
        values.append((b"f" + columns.tobytes()) if small is None else (b"i" + small.tobytes()))
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    parted, sizes = _parted(rows, block_rows)
    made = parted.select("dim", "part", "vec_id", "label", "vector").groupBy("dim", "part").applyInArrow(pack, BLOCK_SCHEMA)
    return made, sizes


def pack_anchors(anchors: DataFrame, most: int = ANCHORS) -> tuple[DataFrame, DataFrame]:
    """A row per block of anchors (with ``positives``, a list of id and score each), and dim, parts."""

    def pack(group: pa.Table) -> pa.Table:
        lists = group.column("positives").combine_chunks()
        flat = lists.flatten()
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = [group.column("dim")[0].as_py(), group.column("part")[0].as_py(), _longs(group.column("row_key"))]
        values += [_longs(group.column("vec_id")), _longs(group.column("label")), np.ascontiguousarray(_matrix(group)).tobytes()]
        values += [counts.tobytes(), *(_longs(flat.field(c)) for c in ("vec_id", "score"))]
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in ANCHOR_SCHEMA.split(", ")])

    parted, sizes = _parted(anchors, most)
    made = parted.select("dim", "part", "row_key", "vec_id", "label", "vector", "positives").groupBy("dim", "part").applyInArrow(pack, ANCHOR_SCHEMA)
    return made, sizes


class Block:
    """A data block read from its row: columns, their bounds, and where each label is."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, columns: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        kind = np.int32 if columns[:1] == b"i" else np.float64
        self.columns = np.frombuffer(columns[1:], kind).reshape(dim, len(self.ids)).astype(np.float64)
        self.lows, self.highs = self.columns.min(1, initial=np.inf), self.columns.max(1, initial=-np.inf)
        self.whole: Block | None = None
        self.of_label = {v: np.flatnonzero(self.labels == v) for v in np.unique(self.labels).tolist()}
        self.read = 0

    def exact(self) -> Block:
        """The same block in Python's whole numbers, for sums that a double can't hold."""
        if self.whole is None:
            self.whole = Block.__new__(Block)
            self.whole.__dict__.update(self.__dict__)
            for c in ("columns", "lows", "highs"):
                values = getattr(self, c)
                setattr(self.whole, c, np.array([int(v) for v in values.ravel().tolist()], object).reshape(values.shape))
        return self.whole


def vertical_scan(block: Block, q: np.ndarray, alive: np.ndarray, may) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the candidates that ``may`` leaves: it is given the candidates' least and largest
    possible scores after every few columns and says which of them can still be wanted."""
    large = np.maximum(np.abs(block.lows), np.abs(block.highs))
    if len(q) and len(block.ids) and float(np.abs(q) @ large) * 2 >= EXACT:
        block, q = block.exact(), np.array([int(v) for v in q.tolist()], object)
    order = np.argsort(-np.abs(q.astype(float)), kind="stable")
    ends = (q * block.lows)[order], (q * block.highs)[order]
    least, most = np.minimum(*ends), np.maximum(*ends)
    left_least, left_most = least.sum() if len(q) else 0, most.sum() if len(q) else 0
    scores = np.zeros(len(alive), q.dtype)
    for k in range(0, len(q), STRIDE):
        dims = order[k : k + STRIDE]
        if 2 * len(alive) > len(block.ids):
            scores = scores + (q[dims] @ block.columns[dims])[alive]
        else:
            scores = scores + q[dims] @ block.columns[np.ix_(dims, alive)]
        block.read += len(dims) * len(alive)
        left_least, left_most = left_least - least[k : k + STRIDE].sum(), left_most - most[k : k + STRIDE].sum()
        kept = may(scores + left_least, scores + left_most)
        if not kept.all():
            alive, scores = alive[kept], scores[kept]
        if not len(alive):
            break
    return alive, scores


def _best(found: list[tuple[int, int]], ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k first of those found so far, as (-score, id), and the new ones."""
    if len(scores) > k and scores.dtype != object:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= edge
        ids, scores = ids[near], scores[near]
    return sorted(found + [(-int(s), i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)])[:k]


def best_of_label(blocks: list[Block], vec_id: int, label: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(-score, id) of the k first rows with the label and another id."""
    found: list[tuple[int, int]] = []
    for block in blocks:
        alive = block.of_label.get(label, np.zeros(0, np.int64))
        alive = alive[block.ids[alive] != vec_id]

        def may(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            least = [-s for s, _ in found[k - 1 :]]
            if len(low) >= k:
                least.append(np.partition(low, len(low) - k)[len(low) - k] if low.dtype != object else sorted(low.tolist())[-k])
            return high >= max(least) if least else np.ones(len(high), bool)

        at, scores = vertical_scan(block, q, alive, may)
        found = _best(found, block.ids[at], scores, k)
    return found


def best_in_windows(blocks: list[Block], label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window of scores, both ends inside, (-score, id) of the k first rows with another label."""
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    for block in blocks:
        alive = np.flatnonzero(block.labels != label)

        def may(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            kept = np.zeros(len(low), bool)
            for (a, b), own in zip(windows, found, strict=True):
                floor = -own[-1][0] if len(own) == k else a
                kept |= (high >= floor) & (low <= b)
            return kept

        at, scores = vertical_scan(block, q, alive, may)
        for j, (a, b) in enumerate(windows):
            inside = (scores >= a) & (scores <= b)
            found[j] = _best(found[j], block.ids[at[inside]], scores[inside], k)
    return found


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Whole scores from low to high per cent of a positive's."""
    return -(-low * score // 100), high * score // 100


def scan(blocks: DataFrame, parts: DataFrame, anchors: DataFrame, k: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """What each task finds for its anchors among its blocks. Anchors without positives look for rows of their own label,
    others for those in the windows of their positives."""
    packed, anchor_parts = pack_anchors(anchors)
    packed = staged(packed, "bond-anchors")
    groups = parts.select("dim", F.ceil(F.col("parts") / BLOCKS).alias("groups"))
    meets = anchor_parts.join(groups, "dim").agg(F.sum(F.col("parts") * F.col("groups"))).first()[0] or 0
    n = int(min(max(1, 2 * meets), MOST_TASKS))
    left = packed.join(groups, "dim").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
    right = blocks.join(anchor_parts, "dim").join(groups, "dim").withColumn("group", F.pmod("part", F.col("groups"))).drop("part", "groups")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    keys = ["dim", "part", "group"]

    def meet(own: pa.Table, data: pa.Table) -> pa.Table:
        found: list[tuple] = []
        held = [Block(*(data.column(c)[i].as_py() for c in ("dim", "ids", "labels", "columns"))) for i in range(data.num_rows)]
        for row in own.to_pylist():
            row_keys, ids, labels, counts, pos_ids, pos_scores = (
                np.frombuffer(row[c], np.int64).tolist() for c in ("keys", "ids", "labels", "counts", "positive_ids", "positive_scores")
            )
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dim"])
            at = 0
            for i, (key, vec_id, label, count) in enumerate(zip(row_keys, ids, labels, counts, strict=True)):
                if not count:
                    best = [(0, None, None, best_of_label(held, vec_id, label, vectors[i], k))]
                else:
                    own_ids, own_scores = pos_ids[at : at + count], pos_scores[at : at + count]
                    lists = best_in_windows(held, label, vectors[i], [window(s, low, high) for s in own_scores], k)
                    best = list(zip(range(count), own_ids, own_scores, lists, strict=True))
                at += count
                found += [(key, vec_id, place, p, s, i, max(-LONG, min(LONG, -n))) for place, p, s, rows in best for n, i in rows]
        types = [pa.int32() if c.endswith(" int") else pa.int64() for c in FOUND_SCHEMA.split(", ")]
        names = [c.split()[0] for c in FOUND_SCHEMA.split(", ")]
        return pa.table([pa.array([r[j] for r in found], t) for j, t in enumerate(types)], names)

    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(meet, FOUND_SCHEMA)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_key", "anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row whose vec_id divides by
    ``every`` and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of another label
    with ``low`` to ``high`` per cent of the positive's score. First is by higher inner product of floor(scale * x), then
    by smaller vec_id; where there are fewer, all.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Vectors are compared
    with those of their own length; empty ones score 0. Rows that repeat count once; rows that share a vec_id and differ
    are several anchors and several candidates, but none is a positive of its own id. A positive with a negative score
    has no negatives. Scores outside of a long are given as its nearest end. An empty table gives none. Columns other
    than vec_id, label and embedding aren't read."""
    rows = staged(usable(vectors, scale), "bond-rows")
    blocks, parts = decompose(rows)
    blocks = staged(blocks, "bond-blocks")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    none = F.expr("CAST(array() AS array<struct<vec_id: bigint, score: bigint>>)")
    found = staged(_first(scan(blocks, parts, anchors.withColumn("positives", none), positives), positives), "bond-positives")
    own = found.groupBy(F.col("anchor_key").alias("row_key"), F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "score"))).alias("positives"))
    wanted = scan(blocks, parts, staged(anchors.join(own, ["row_key", "vec_id"]), "bond-wanted"), negatives, low, high)
    return _first(wanted, negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_bond(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"))


TWINS = {
    "op13_bond": f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e::DOUBLE))) = 0),
a AS (SELECT *, row_number() OVER (ORDER BY vec_id, label, x) AS k FROM v WHERE vec_id % {EVERY} = 0),
s AS (SELECT k, a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score FROM a JOIN v ON len(a.x) = len(v.x)),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS place FROM s WHERE same AND vec_id <> anchor_id),
n AS (SELECT p.k, p.place, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.k, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.place <= {POSITIVES} AND s.k = p.k AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
}
QUERIES = {"op13_bond": op13_bond}

"""Exact top-k by inner product, best first over M-trees.

Vectors are dealt to trees around pivots. A tree is made of pages: each has a centre, a covering radius over all that is
below it and, stored beside it, the distance to its parent's centre. For a query q no vector x under a page can score
more than q.centre + |q| * radius; and q.centre itself is at most q.parent + |q| * distance to the parent, so that pages
are passed over without a look at their centre. Pages are opened in order of their bounds until the k-th best score is
above them all.

A tree is one row of the index, so any executor can search any tree. Queries go out in blocks of a fixed size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideboard.llm.common import staged, table

SCALE, TOP, EVERY = 1024, 10, 100
PIVOTS, SAMPLE = 64, 4096  # pivots are chosen among about so many vectors; every vector is indexed
TREE_ROWS, PAGE_ROWS = 4096, 64
QUERY_BLOCK = 8192
TREE_SCHEMA = "tree long, dim int, ids binary, vectors binary, starts binary, ends binary, parents binary, centres binary, radii binary, distances binary"
EXACT = float(1 << 53)


def scaled(embedding: str = "embedding"):
    """floor(1024 * x) of each component as long; null if a component is null, not finite or too large for one."""
    x = F.transform(F.col(embedding), lambda v: F.floor(v.cast("double") * SCALE))
    plain = F.forall(F.col(embedding), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < 2.0**40))
    return F.when(F.coalesce(plain, F.lit(False)), x)


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vec_id, dim, vector: the rows that take part; a null id can't be named and doesn't."""
    rows = vectors.select(F.col("vec_id").cast("long"), scaled(embedding).alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    return rows.select("vec_id", F.size("vector").alias("dim"), "vector")


def _matrix(column) -> np.ndarray:
    lists = column.to_pylist()
    return np.array(lists, dtype=np.float64).reshape(len(lists), -1)


def choose_pivots(rows: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """By dimension, vectors far from each other, out of a sample of about ``sample``, drawn by hash."""
    total = rows.count()
    drawn = rows if total <= sample else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    by_dim: dict[int, list] = {}
    for r in drawn.select("dim", "vector").collect():
        by_dim.setdefault(r["dim"], []).append(r["vector"])
    out = {}
    for dim, lists in by_dim.items():
        x = np.array(lists, float).reshape(len(lists), dim)
        chosen, near = [0], np.full(len(x), np.inf)
        while len(chosen) < min(n, len(x)):
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
            if near.max() <= 0:
                break
            chosen.append(int(near.argmax()))
        out[dim] = x[chosen]
    return out


def build_tree(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Pages over the rows, reordered so that each page's are next to each other; the root is page 0.

    Built from above: a page of more than PAGE_ROWS rows is parted by the nearer of two far rows."""
    order, starts, ends, parents = np.arange(len(x)), [], [], []
    todo = [(0, len(x), -1)]
    while todo:
        a, b, parent = todo.pop()
        page = len(starts)
        starts.append(a)
        ends.append(b)
        parents.append(parent)
        if b - a <= PAGE_ROWS:
            continue
        own = x[order[a:b]]
        one = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
        two = own[((own - one) ** 2).sum(1).argmax()]
        side = ((own - one) ** 2).sum(1) - ((own - two) ** 2).sum(1)
        split = np.argsort(side, kind="stable")  # halves, so that equal rows don't make a deep tree
        order[a:b] = order[a:b][split]
        middle = a + (b - a) // 2
        todo += [(a, middle, page), (middle, b, page)]
    x = x[order]
    centres = np.array([x[a:b].mean(0) for a, b in zip(starts, ends, strict=True)]).reshape(len(starts), x.shape[1])
    radii = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max(initial=0)) for a, b, c in zip(starts, ends, centres, strict=True)])
    distances = np.array([0.0 if p < 0 else np.sqrt(((centres[k] - centres[p]) ** 2).sum()) for k, p in enumerate(parents)])
    return {"ids": ids[order], "vectors": x, "starts": np.array(starts), "ends": np.array(ends), "parents": np.array(parents), "centres": centres, "radii": radii, "distances": distances}


class Tree:
    """A tree read from its row."""

    def __init__(self, row: dict):
        dim, whole = row["dim"], lambda c: np.frombuffer(row[c], np.int64)
        self.ids, self.starts, self.ends, self.parents = whole("ids"), whole("starts"), whole("ends"), whole("parents")
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(self.ids), dim)
        self.large = float(np.abs(self.vectors).max(initial=0))
        self.floats = self.vectors.astype(float)
        self.centres = np.frombuffer(row["centres"], float).reshape(len(self.starts), dim)
        self.radii, self.distances = np.frombuffer(row["radii"], float), np.frombuffer(row["distances"], float)
        self.children: list[list[int]] = [[] for _ in self.starts]
        for k, p in enumerate(self.parents.tolist()):
            if p >= 0:
                self.children[p].append(k)
        self.looked = 0

    def products(self, q: np.ndarray, a: int, b: int) -> list[int]:
        """Exact inner products: in floating point where no sum can leave its whole numbers, else in Python's own."""
        if float(np.abs(q).max(initial=0)) * self.large * max(1, len(q)) < EXACT:
            return (self.floats[a:b] @ q.astype(float)).astype(np.int64).tolist()
        own = [int(v) for v in q]
        return [sum(map(int.__mul__, own, map(int, row))) for row in self.vectors[a:b].tolist()]

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, without the query's own rows."""
        norm = float(np.sqrt((q.astype(float) ** 2).sum()))
        slack = 1e-9 * (1 + norm * (1 + float(np.abs(self.centres).max(initial=0))) * max(1, len(q)))
        at_root = float(self.centres[0] @ q)
        pages, best = [(-(at_root + norm * self.radii[0]), 0, at_root)], []  # best: the least of the k first
        while pages:
            bound, page, product = heapq.heappop(pages)
            if len(best) == k and -bound + slack < best[0][0]:
                break
            if not self.children[page]:
                a, b = int(self.starts[page]), int(self.ends[page])
                self.looked += b - a
                for score, vec_id in zip(self.products(q, a, b), self.ids[a:b].tolist(), strict=True):
                    if vec_id != query_id and (len(best) < k or (score, -vec_id) > best[0]):
                        (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -vec_id))
                continue
            for child in self.children[page]:
                if len(best) == k and product + norm * (self.distances[child] + self.radii[child]) + slack < best[0][0]:
                    continue  # by the stored distance alone
                own = float(self.centres[child] @ q)
                heapq.heappush(pages, (-(own + norm * self.radii[child]), child, own))
        return [(score, -negative) for score, negative in sorted(best, reverse=True)]


def build_index(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """A row per tree. Vectors go to the nearest pivot; a pivot with many, such as one with a large group of copies, has
    several trees, so none is larger than about ``tree_rows``."""
    spark = rows.sparkSession
    pivots = spark.sparkContext.broadcast(choose_pivots(rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            near = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in pivots.value:
                    for part in np.array_split(at, max(1, len(at) // 2048)):
                        x, p = _matrix(batch.column("vector").take(pa.array(part))), pivots.value[dim]
                        near[part] = (-2 * x @ p.T + (p**2).sum(1)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "pivot"])

    dealt = staged(rows.mapInArrow(deal, "vec_id long, dim int, vector array<long>, pivot int"), "mtree-vectors")
    sizes = dealt.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"))  # PIVOTS rows per dimension
    parts = F.ceil(F.col("n") / tree_rows)
    # Same-sized trees need no draw: a hash of the id deals a pivot's vectors out evenly; row numbers keep copies apart.
    spread = dealt.join(F.broadcast(sizes.select("dim", "pivot", parts.alias("parts"))), ["dim", "pivot"])
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts"))
    treed = spread.withColumn("tree", F.xxhash64("dim", "pivot", part))

    def grow(group: pa.Table) -> pa.Table:
        batch = group.combine_chunks()
        dim = batch.column("dim")[0].as_py()
        lists = batch.column("vector").to_pylist()
        x = np.array(lists, dtype=np.int64).reshape(len(lists), dim)
        made = build_tree(batch.column("vec_id").to_numpy(), x.astype(float))
        made["vectors"] = made["vectors"].astype(np.int64)
        for c in ("ids", "starts", "ends", "parents"):
            made[c] = made[c].astype(np.int64)
        names = [c.split()[0] for c in TREE_SCHEMA.split(", ")]
        values = [batch.column("tree")[0].as_py(), dim, *(np.ascontiguousarray(made[c]).tobytes() for c in names[2:])]
        types = [pa.int64(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    return staged(treed.select("tree", "dim", "vec_id", "vector").groupBy("tree").applyInArrow(grow, TREE_SCHEMA), "mtree-index")


def search_index(index: DataFrame, queries: DataFrame, k: int = TOP, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score: each query's best ``k`` in every tree of its dimension. The queries go out in blocks of
    about ``block`` rows, dealt by hash, each a broadcast of a fixed size, and each is one pass over the index."""
    spark = index.sparkSession
    held = staged(queries, "mtree-queries")
    parts = -(-held.count() // block)
    out = None
    for k_part in range(parts):
        own = held.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)) == k_part)
        rows = own.collect()  # about block rows
        sent = spark.sparkContext.broadcast([(r["vec_id"], np.array(r["vector"], np.int64)) for r in rows])

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    tree, found = Tree(row), ([], [], [])
                    for query_id, q in sent.value:
                        if len(q) == row["dim"]:
                            for score, vec_id in tree.search(query_id, q, k):
                                for column, v in zip(found, (query_id, vec_id, score), strict=True):
                                    column.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

        part = index.mapInArrow(look, "query_id long, vec_id long, score long")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id long, vec_id long, score long") if out is None else out


def top_k(vectors: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose vec_id divides by ``every`` the k rows of other ids with the
    highest inner products of floor(1024 * x), ties to the smaller vec_id; all, if there are fewer.

    Rows with a null vector or id, or a component that is null, not finite or of 2**40 or more, take no part. Vectors
    are compared with those of their own length; empty ones score 0. A vec_id that repeats with different vectors is
    several candidates and several queries, whose results are merged; a row that repeats counts once."""
    rows = usable(vectors).dropDuplicates(["vec_id", "vector"])
    rows = staged(rows, "mtree-rows")
    found = search_index(build_index(rows), rows.filter(F.col("vec_id") % every == 0), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


EMBEDDING_SQL = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))"
TWINS = {
    "op5_mtree": f"""
WITH v AS (SELECT DISTINCT vec_id, {EMBEDDING_SQL} AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= {TOP}"""
}
QUERIES = {"op5_mtree": op5_mtree}

"""SimHash near-duplicates found in a space of segment popcounts.

A fingerprint's embedding is the number of set bits in each of its segments. Flipping one bit moves one coordinate by
one, so the Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints. Fingerprints
within two bits are therefore found by a range join at distance two on the integer grid: each is filed under its own
cell and the cells one step away, and two of them that are within range share a cell. What shares a cell is then
verified on all 64 bits. Cells that hold many fingerprints are filed again on the finest grid, segments of one bit,
where a cell has 65 members at most and sharing one is the exact condition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.llm.common import merged, sieved, slices, staged, table

SEED, WORDS = 42, 3
CROWD = 128  # members of a coarse cell; above, the finest grid takes over
SLICE_BYTES = 4 << 20
SENT = 1 << 16  # links up to which Spark may choose to send them to all executors


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Of each run of so many words, in order; of all words where there are fewer."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z, space and \x09-\x0D count
    if not tokens:
        return np.zeros(0, np.uint64)
    last = max(1, len(tokens) - words + 1)
    joined, size = b" ".join(tokens), list(map(len, tokens))
    starts = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(np.asarray(size) + 1, out=starts[1:])
    ends = (starts[min(words, len(tokens)) :] - 1)[:last].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends, strict=True)), np.uint64, last)


def simhash(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of so many hashes; of none, zero."""
    last = len(hashes)
    if not last:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, last, 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > last, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of word shingles; without words, zero."""
    return simhash(shingle_hashes(text, words))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Popcounts of the 16 four-bit segments, each in its own four bits of a long."""
    ones = F.lit(0x1111111111111111)
    first, second, third, fourth = (F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in range(4))
    return first + second + third + fourth


def cells(point: Column) -> Column:
    """The cell of an embedding and those one step away, inside the grid (coordinates 0 to 4)."""
    near = [point]
    for k in range(0, 64, 4):
        step = 1 << k
        held = F.shiftrightunsigned(point, k).bitwiseAND(F.lit(15))
        near += [F.when(held < 4, point + F.lit(step)), F.when(held > 0, point - F.lit(step))]
    return F.filter(F.array(*near), lambda c: c.isNotNull())


def within(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def fine_links(members: DataFrame) -> DataFrame:
    """Links a > b that connect all fingerprints within two bits: each, filed under itself and its 64 one-bit changes,
    is linked to the least of the 65 or fewer that share a cell."""
    changed = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << k) if k < 63 else -(1 << 63))) for k in range(64)]
    filed = members.select("fp", F.explode(F.array(*changed)).alias("cell"))
    least = filed.groupBy("cell").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return filed.join(merged(least), "cell").filter(F.col("fp") > F.col("b")).select(F.col("fp").alias("a"), "b").distinct()


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links a > b between distinct fingerprints (column fp): all pairs of two or fewer differing bits that share a
    cell of at most ``crowd`` members, and for fuller cells links that connect the same fingerprints."""
    filed = distinct.select("fp", F.explode(cells(embedding(F.col("fp")))).alias("cell"))
    full = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = staged(filed.join(merged(full), "cell"), "simhash-cells")
    few = shared.filter(F.col("n") <= crowd)
    a, b = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    pairs = a.join(merged(b), "cell").filter((F.col("a") > F.col("b")) & within(F.col("a"), F.col("b"), 2)).select("a", "b")
    return pairs.distinct().unionByName(fine_links(shared.filter(F.col("n") > crowd).select("fp").distinct()))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of the edges (a > b) reaches. Stars are made large and small in turn
    until nothing changes; each round is a file in the shared folder."""

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = staged(edges, "component-edges")
    seen = state(edges)
    while seen[0]:
        sized = merged if seen[0] > SENT else lambda df: df  # files of links are far smaller than the links
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(sized(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sized(low), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = staged(small.distinct(), "component-edges")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def named(rows: DataFrame, classes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """The rows (doc_id, key) with the component_id of their class. Classes: key, least doc_id; roots: node, root."""
    rooted = classes.join(merged(roots.withColumnRenamed("node", key)), key, "left").withColumn("root", F.coalesce("root", key))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.select("root").distinct()
    # Only linked classes need a name from others; the rest keep their own least id.
    other = rooted.join(merged(linked), "root").join(merged(names), "root").select(key, "component_id")
    mapped = classes.join(merged(other), key, "left").select(key, F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(merged(mapped), key).select("doc_id", key, "component_id")


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, component_id of every document; component_id is the least doc_id reachable over links.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked with each other. Shorter texts
    than a shingle are one shingle. Repeated rows have one row each. A row with null doc_id has a component like any
    other but never names one; if only such rows are reachable, component_id is null. Other columns are not read."""
    prints = staged(fingerprints(docs), "simhash-fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = staged(components(links(classes.select("fp"), crowd)), "simhash-roots")
    return named(prints, classes, roots, "fp")


def keep_one(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The documents that name their component as found; all columns. Rows without a doc_id stay: nothing can be said of them.
    Of rows that repeat a doc_id one stays."""
    found = staged(find(docs), "simhash-kept").filter(F.col("doc_id").isNotNull())
    counted = found.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("n"))
    counted = staged(counted, "simhash-counted")
    others = counted.filter("n <> 1")
    repeated = others.filter("n > 1")
    alone = counted.filter("n = 1")
    # Texts move only where the map of the other ids leaves it open whether they stay.
    return (
        sieved(docs, others, among=False).filter(F.col("doc_id").isNotNull())
        .unionByName(sieved(docs, others).join(merged(alone), "doc_id", "left_semi"))
        .unionByName(sieved(docs, repeated).join(merged(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
        .unionByName(docs.filter(F.col("doc_id").isNull()))
    )


def op3_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_segments": op3_simhash_segments}

"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least a bound, all of them.

Two sets as similar as that share a shingle among the first few of each, in whatever order all shingles are put, if few
is one more than a set may miss. Shingles rare in a sample come first, so few sets meet that aren't alike.

Each set has a SimHash fingerprint. Sets whose fingerprints are within two bits are compared first, and what they prove
to be alike is one component from then on, whose sets needn't be compared with each other. Two bits miss many edited
copies, so the sets that share a first shingle follow: each is compared with their centre, the one that meets the most
sets; those that this doesn't put into the component that most of them are in are compared with all others. At the first
shingle that two sets share they can share no more than begins there in each. A pair is then held against a bitmap of each
set's shingle hashes: bits of one that the other lacks are shingles that it lacks, which bounds the overlap from above. Long
sets have a second, larger bitmap. Only for pairs within these bounds the sets are made again from the texts and compared;
nothing else of a set is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideboard.llm.common import merged, sieved, slices, staged
from tideboard.llm.simhash import SLICE_BYTES, components, links, named, shingle_hashes, simhash
from tideboard.llm.vertical import COUNTERS, shingle_counts

WORDS, ALIKE = 5, 0.8
BITS = 2048  # of a set's bitmap; longer sets than half as many shingles have one more, of two to four bits a shingle


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def _bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) > 0).view(np.int64)


def _lists(values: list[np.ndarray], missing: np.ndarray | None = None) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *values])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=None if missing is None else pa.array(missing))


def read_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, set_id, fp, size, bits, finer of every document: a hash of the different shingles of the text, their
    fingerprint, their number and their bitmaps, the second one null for short sets; none without words. And in rows of
    their own bucket, n: how often hashed shingles occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        names = ["doc_id", "set_id", "fp", "size", "bits", "finer", "bucket", "n"]
        for batch in slices(batches, "text", SLICE_BYTES):
            found = [np.unique(shingle_hashes(x.as_py(), words)) for x in batch.column("text")]
            flat = np.concatenate([np.zeros(0, np.uint64), *found])
            counts += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            ids = pa.array(np.array([_set_id(x) for x in found], np.uint64).view(np.int64))
            prints = pa.array(np.array([simhash(x) for x in found], np.uint64).view(np.int64))
            sizes = np.array([len(x) for x in found], np.int32)
            is_short = 2 * sizes <= BITS
            finer = [np.zeros(0, np.int64) if short else _bitmap(x, 1 << (2 * len(x) - 1).bit_length()) for x, short in zip(found, is_short, strict=True)]
            none = pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.int64())
            maps = _lists([_bitmap(x, BITS) for x in found]), _lists(finer, is_short)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, prints, pa.array(sizes), *maps, *none], names)
        held = np.flatnonzero(counts)
        for at in np.array_split(held, max(1, len(held) >> 16)):
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            none = [pa.nulls(len(at), t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array(counts[at])], names)

    schema = "doc_id long, set_id long, fp long, size int, bits array<long>, finer array<long>, bucket int, n long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _sets(read: DataFrame) -> DataFrame:
    return read.filter("bucket IS NULL").drop("bucket", "n")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents' rows of ``read_sets``."""
    return _sets(read_sets(docs, words))


def first_shingles(docs: DataFrame, counts, words: int = WORDS, alike: float = ALIKE) -> DataFrame:
    """shingle, set_id, size, rest: of each set those shingles of which any set as similar shares one, and how many of the
    set's order begin there. Rare ones come first by ``counts``, a broadcast array; it decides the work, never the result.
    Dealt by shingle, so that what is counted or joined by shingle doesn't move again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, done = counts.value, set()
        for batch in slices(batches, "text", SLICE_BYTES):
            found, ids, sizes, rests = [], [], [], []
            for text in batch.column("text"):
                held = np.unique(shingle_hashes(text.as_py(), words))
                set_id = _set_id(held)
                if not len(held) or set_id in done:  # copies in a task are filed once
                    continue
                done.add(set_id)
                few = len(held) - math.ceil(alike * len(held) - 1e-9) + 1
                rank = ranks[(held % np.uint64(COUNTERS)).astype(np.int64)]
                low = np.flatnonzero(rank <= np.partition(rank, few - 1)[few - 1])
                found.append(held[low[np.lexsort((held[low], rank[low]))[:few]]].view(np.int64))
                ids.append(np.full(few, set_id, np.uint64).view(np.int64))
                sizes.append(np.full(few, len(held), np.int32))
                rests.append(len(held) - np.arange(few, dtype=np.int32))
            if found:
                columns = [pa.array(np.concatenate(x)) for x in (found, ids, sizes, rests)]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "set_id", "size", "rest"])

    schema = "shingle long, set_id long, size int, rest int"
    return docs.select("text").mapInArrow(run, schema).repartition("shingle").distinct()


def whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """set_id, shingles of the wanted sets, made again from the texts of one document each. Classes: set_id, least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in slices(batches, "text", SLICE_BYTES):
            made = [np.unique(shingle_hashes(x.as_py(), words)) for x in batch.column("text")]
            found = {}
            for x in made:
                set_id = _set_id(x)
                if set_id not in done:
                    done.add(set_id)
                    found[set_id] = x.view(np.int64)
            if found:
                ids = pa.array(np.array(list(found), np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids, _lists(list(found.values()))], ["set_id", "shingles"])

    chosen = staged(classes.join(merged(wanted), "set_id", "left_semi").select(F.col("least").alias("doc_id")), "copies-chosen")
    texts = sieved(docs.select(F.col("doc_id").cast("long"), "text"), chosen).select("text")
    found = texts.mapInArrow(run, "set_id long, shingles array<long>")
    return found.join(merged(wanted), "set_id", "left_semi").dropDuplicates(["set_id"])


def print_pairs(sets: DataFrame) -> DataFrame:
    """Pairs a > b of sets whose fingerprints connect them: sets of one fingerprint with the least of them, and the least
    ones of fingerprints that ``simhash.links`` links."""
    prints = staged(sets.filter("size > 0").select("set_id", "fp").distinct(), "copies-prints")
    least = prints.groupBy("fp").agg(F.min("set_id").alias("least"))
    same = prints.join(merged(least), "fp").filter(F.col("set_id") > F.col("least")).select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    near = links(least.select("fp"))
    for c in ("a", "b"):
        near = near.join(merged(least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_set"))), c)
    return same.unionByName(near.select(F.greatest("a_set", "b_set").alias("a"), F.least("a_set", "b_set").alias("b")))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs a, b that aren't in one component of the roots (node, root)."""
    for c in ("a", "b"):
        pairs = pairs.join(merged(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))), c, "left")
    return pairs.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _bounded(a: Column, b: Column, size_a: Column, size_b: Column, alike: float) -> Column:
    """Whether two sets may be similar by their bitmaps of one length."""

    def most(x: Column, y: Column, size: Column) -> Column:
        lacking = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return size - F.aggregate(lacking, F.lit(0), lambda held, n: held + n)

    both = F.least(most(a, b, size_a), most(b, a, size_b))
    return both >= (size_a + size_b - both) * alike - 1e-6


def _folded(bits: Column) -> Column:
    """A bitmap of half the length."""
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseOR(q))


def possible_pairs(pairs: DataFrame, marks: DataFrame, alike: float) -> DataFrame:
    """a, b of the pairs that sizes and bitmaps (set_id, size, bits, once each) don't rule out."""
    for c in ("a", "b"):
        pairs = pairs.join(merged(marks.select(F.col("set_id").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits"))), c)
    a_size, b_size = F.col("a_size"), F.col("b_size")
    fits = F.least(a_size, b_size) >= F.greatest(a_size, b_size) * alike - 1e-9
    return pairs.filter(fits & _bounded(F.col("a_bits"), F.col("b_bits"), a_size, b_size, alike)).select("a", "b", "a_size", "b_size")


def finer_pairs(pairs: DataFrame, marks: DataFrame, alike: float) -> DataFrame:
    """a, b of the pairs (with their sizes) that the larger bitmaps (set_id, finer) don't rule out. Bitmaps are powers of
    two in length; pairs in which one is missing, or more than twice the other, stay."""
    finer = marks.filter("finer IS NOT NULL")
    for c in ("a", "b"):
        pairs = pairs.join(merged(finer.select(F.col("set_id").alias(c), F.col("finer").alias(f"{c}_finer"))), c, "left")
    a, b, sizes = F.col("a_finer"), F.col("b_finer"), (F.col("a_size"), F.col("b_size"))
    may = (
        F.when(F.size(a) == F.size(b), _bounded(a, b, *sizes, alike))
        .when(F.size(a) == 2 * F.size(b), _bounded(_folded(a), b, *sizes, alike))
        .when(F.size(b) == 2 * F.size(a), _bounded(a, _folded(b), *sizes, alike))
    )
    return pairs.filter(a.isNull() | b.isNull() | F.coalesce(may, F.lit(True))).select("a", "b")


def alike_pairs(pairs: DataFrame, marks: DataFrame, docs: DataFrame, classes: DataFrame, words: int, alike: float) -> DataFrame:
    """a, b of the pairs whose sets are similar enough."""
    possible = staged(possible_pairs(pairs, marks, alike), "copies-possible")
    possible = staged(finer_pairs(possible, marks, alike), "copies-finer")
    wanted = possible.select(F.col("a").alias("set_id")).unionByName(possible.select(F.col("b").alias("set_id"))).distinct()
    met = staged(whole_sets(docs, classes, wanted, words), "copies-met")
    of = {c: met.select(F.col("set_id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("a", "b")}
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = possible.join(of["a"], "a").join(of["b"], "b")
    return staged(joined.filter(both / (F.size("of_a") + F.size("of_b") - both) >= alike).select("a", "b"), "copies-alike")


def set_links(docs: DataFrame, read: DataFrame, classes: DataFrame, words: int = WORDS, alike: float = ALIKE) -> DataFrame:
    """Links a > b between sets as similar as ``alike`` that connect all such sets. Read: ``read_sets`` of the documents;
    classes: set_id, least."""
    sets = _sets(read)
    counts = docs.sparkSession.sparkContext.broadcast(np.minimum(shingle_counts(read), (1 << 32) - 1).astype(np.uint32))
    filed = first_shingles(docs, counts, words, alike)
    full = filed.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    meeting = staged(filed.join(merged(full), "shingle"), "copies-meeting")
    weights = meeting.groupBy("set_id").agg(F.sum("n").alias("weight"))
    centres = meeting.join(merged(weights), "set_id").groupBy("shingle").agg(F.max(F.struct("weight", "set_id", "size", "rest")).alias("centre"))
    low = (F.col(f"centre.{c}").alias(f"low_{c}") for c in ("size", "rest"))
    shared = meeting.join(merged(centres), "shingle").select("shingle", "set_id", "size", "rest", F.col("centre.set_id").alias("low"), *low)
    shared = staged(shared, "copies-shared")
    marks = sets.select("set_id", "size", "bits", "finer").join(merged(shared.select("set_id").distinct()), "set_id", "left_semi")
    marks = staged(marks.dropDuplicates(["set_id"]), "copies-marks")
    share = alike / (1 + alike)  # of both sizes, which the overlap of similar sets is at least

    def may(a: str, b: str):
        """By size, and by what begins at a shared shingle: at the first that similar sets share both hold."""
        sizes, rests = [F.col(f"{c}size") for c in (a, b)], [F.col(f"{c}rest") for c in (a, b)]
        return (F.least(*sizes) >= F.greatest(*sizes) * alike - 1e-9) & (F.least(*rests) >= (sizes[0] + sizes[1]) * share - 1e-6)

    def links_of(pairs: DataFrame) -> DataFrame:
        return alike_pairs(pairs, marks, docs, classes, words, alike)

    stars = shared.filter((F.col("set_id") != F.col("low")) & may("", "low_")).select(F.greatest("set_id", "low").alias("a"), F.least("set_id", "low").alias("b")).distinct()
    printed = links_of(print_pairs(sets))
    near = printed.unionByName(links_of(apart(stars, components(printed))))
    roots = components(near)
    members = shared.join(merged(roots.withColumnRenamed("node", "set_id")), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    members = staged(members.select("shingle", "set_id", "size", "rest", "low", "root"), "copies-members")
    by_root = members.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_root.groupBy("shingle").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("most")).filter("roots > 1")
    left = members.filter("set_id <> low").join(merged(mixed.select("shingle", F.col("most.root").alias("main"))), "shingle")
    x = left.filter("root <> main").select("shingle", *(F.col(c).alias(f"x_{c}") for c in ("set_id", "size", "rest", "root")))
    y = left.select("shingle", "main", *(F.col(c).alias(f"y_{c}") for c in ("set_id", "size", "rest", "root")))
    once = (F.col("y_root") == F.col("main")) | (F.col("x_set_id") > F.col("y_set_id"))
    rest = x.join(merged(y), "shingle").filter((F.col("x_root") != F.col("y_root")) & once & may("x_", "y_"))
    rest = rest.select(F.greatest("x_set_id", "y_set_id").alias("a"), F.least("x_set_id", "y_set_id").alias("b")).distinct()
    return near.unionByName(links_of(rest))


def near_copies(docs: DataFrame, words: int = WORDS, alike: float = ALIKE) -> DataFrame:
    """doc_id, set_id, component_id of every document; component_id is the least doc_id reachable over pairs whose
    shingle sets have a similarity of ``alike`` or more. Odd rows are treated as by ``simhash.near_duplicates``: texts
    without words are alike, shorter ones than a shingle are one shingle."""
    read = staged(read_sets(docs, words), "copies-sets")
    sets = _sets(read).select("doc_id", "set_id")
    classes = staged(sets.groupBy("set_id").agg(F.min("doc_id").alias("least")), "copies-classes")
    roots = staged(components(set_links(docs, read, classes, words, alike)), "copies-roots")
    return named(sets, classes, roots, "set_id")

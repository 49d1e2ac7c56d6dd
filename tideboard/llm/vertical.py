"""Jaccard join of word-shingle sets by vertical partitioning.

All shingles stand in one global order, rare ones first. The order is cut into fragments, and so every set is cut into
segments; the overlap of two sets is the sum, over the fragments, of what their segments share. Fragments are counted
separately and summed per pair.

Which pairs are counted: two similar sets share one of the first shingles of each (as many as either may miss, and one).
Where few sets share such a shingle, those that size and position allow are compared. Where many do, all are compared
with the most central of them, the leader. Links make components, and only pairs across components matter after that.
By the triangle inequality, a set far from the leader is similar only to sets that aren't close to it either. Sets close
to it are told apart by what they miss of it or have beside it, their difference. Of two similar ones, not both linked
with the leader, the differences overlap by a bound that follows from the sizes; so they share one of the first parts of
each difference, and these are the next, smaller groups. Where a smaller group's leader brings few components together,
the group has no centre, and what the bounds leave of its pairs across components is counted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.llm.common import slices, staged, table
from tideboard.llm.simhash import SLICE_BYTES, components, named

# Workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, PERCENT = 5, 80
FRAGMENTS = 4
COUNTERS = 1 << 18  # of shingles by hash, over all documents; the order they give decides the work, never the result
CROWD = 64  # sets of a group that are compared with each other; above, a leader comes first
FOLLOWERS = 256  # sets that meet one copy of a leader's segments
KEY = "decimal(38,0)"
KEPT_WORDS = 1 << 20
MARKS = 1 << 24  # bits of a filter of the documents whose sets are cut; a full one only makes more sets be cut
ABOUT = 1e-6  # bounds are whole numbers, or apart by more than this


# --- sets and their order

class Words(dict):
    """64-bit hashes of words, kept for as long as they are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 3)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _joined(hashed: np.ndarray, words: int) -> np.ndarray:
    """A hash for each run of so many words, made of the words' hashes in order."""
    last = len(hashed) - words + 1
    out = np.full(max(0, last), words, np.uint64)
    for k in range(words if last > 0 else 0):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + last])
    return out


def sets_of(texts: Sequence[str | None], words: int, known: Words) -> list[np.ndarray]:
    """Of each text the sorted hashes of its different shingles."""
    tokens = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]  # bytes: only A-Z, space and \x09-\x0D count
    ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
    hashed = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.uint64, int(ends[-1]) if len(ends) else 0)
    runs, out = _joined(hashed, words), []
    for n, end in zip(map(len, tokens), ends.tolist(), strict=True):
        own = runs[end - n : end - words + 1] if n >= words else _joined(hashed[end - n : end], n) if n else hashed[:0]
        out.append(np.unique(own))
    return out


def _set_ids(sets: list[np.ndarray]) -> pa.Array:
    """126-bit hashes of whole sets."""
    halves = np.zeros((len(sets), 2), np.uint64)
    for i, x in enumerate(sets):
        data = x.tobytes()
        halves[i] = xxhash.xxh64_intdigest(data, 1), xxhash.xxh64_intdigest(data, 2) >> 2
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(sets), [None, pa.py_buffer(halves.tobytes())])


def read_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, set_id, size of every document, and in rows of their own bucket, n: how often hashed shingles occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(COUNTERS, np.int64), Words()
        names = ["doc_id", "set_id", "size", "bucket", "n"]
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = sets_of(batch.column("text").to_pylist(), words, known)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            counts += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            sizes = np.array([len(x) for x in sets], np.int32)
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _set_ids(sets), pa.array(sizes), *none], names)
        held = np.flatnonzero(counts)
        for at in np.array_split(held, max(1, len(held) >> 16)):
            none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.decimal128(38, 0), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array(counts[at])], names)

    schema = f"doc_id long, set_id {KEY}, size int, bucket int, n long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def shingle_counts(read: DataFrame) -> np.ndarray:
    """The counters, added up: COUNTERS numbers, whatever the size of the corpus."""
    rows = read.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def fragment_ends(counts: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Counts up to which the fragments but the last one go, so that each holds about as many shingles."""
    held = np.sort(counts[counts > 0])
    mass = np.cumsum(held)
    at = np.searchsorted(mass, [mass[-1] * k / fragments for k in range(1, fragments)]) if len(mass) else []
    return held[at] if len(mass) else np.zeros(fragments - 1, np.int64)


def _few(size: int, percent: int) -> int:
    """So many first shingles of a set that any similar set has one of them; 0 if only an equal set is similar."""
    least = -(-size * percent // 100)
    return 0 if least == size and size * 100 // percent == size else size - least + 1


def first_shingles(docs: DataFrame, words: int, percent: int, counts) -> DataFrame:
    """key, set_id, size, rest: the first shingles of every set, and how many of the set's order begin there. Sets that
    are in several tasks are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, done, known = counts.value, set(), Words()
        for batch in slices(batches, "text", SLICE_BYTES):
            found, ids, sizes, rests = [], [], [], []
            sets = sets_of(batch.column("text").to_pylist(), words, known)
            of = _set_ids(sets)
            for i, (x, set_id) in enumerate(zip(sets, of.to_pylist(), strict=True)):
                few = _few(len(x), percent)
                if few and set_id not in done:
                    done.add(set_id)  # copies in a task are filed once
                    rank = ranks[(x % np.uint64(COUNTERS)).astype(np.int64)]
                    low = np.flatnonzero(rank <= np.partition(rank, few - 1)[few - 1])
                    found.append(x[low[np.lexsort((x[low], rank[low]))[:few]]])
                    ids.append(np.full(few, i))
                    sizes.append(np.full(few, len(x), np.int32))
                    rests.append(len(x) - np.arange(few, dtype=np.int32))
            if found:
                columns = [pa.array(np.concatenate(found).view(np.int64)), of.take(pa.array(np.concatenate(ids)))]
                columns += [pa.array(np.concatenate(c)) for c in (sizes, rests)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "set_id", "size", "rest"])

    return docs.select("text").mapInArrow(run, f"key long, set_id {KEY}, size int, rest int")


def _mark(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(MARKS))


def marks(ids: DataFrame) -> np.ndarray:
    """A bit for each doc_id, null included: MARKS bits, whatever the number of ids."""
    at = ids.select(_mark(F.col("doc_id")).alias("at"))
    words = at.select(F.floor(F.col("at") / 32).alias("word"), F.expr("shiftleft(1L, cast(at % 32 AS int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MARKS // 32, np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out


def segments(docs: DataFrame, words: int, counts, ends: np.ndarray, marked) -> DataFrame:
    """set_id, fragment, shingles: the sets of marked documents, cut along the order; each fragment has a row, empty or
    not. One document of each set is marked, as a set cut in many tasks would meet its pairs once for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, bits, done, known = counts.value, marked.value, set(), Words()
        for batch in slices(batches, "text", SLICE_BYTES):
            at = batch.column("at").to_numpy()
            held = bits[at // 32] >> (at % 32).astype(np.uint32) & 1
            sets = sets_of(batch.column("text").filter(pa.array(held == 1)).to_pylist(), words, known)
            of, cut, ids = _set_ids(sets), [], []
            for i, (x, set_id) in enumerate(zip(sets, of.to_pylist(), strict=True)):
                if set_id not in done:
                    done.add(set_id)
                    part = np.searchsorted(ends, ranks[(x % np.uint64(COUNTERS)).astype(np.int64)])
                    cut += [x[part == k] for k in range(len(ends) + 1)]
                    ids += [i] * (len(ends) + 1)
            if ids:
                starts = np.cumsum([0, *map(len, cut)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(cut).view(np.int64)))
                fragments = np.tile(np.arange(len(ends) + 1, dtype=np.int32), len(ids) // (len(ends) + 1))
                yield pa.RecordBatch.from_arrays([of.take(pa.array(ids)), pa.array(fragments), lists], ["set_id", "fragment", "shingles"])

    placed = docs.select(_mark(F.col("doc_id").cast("long")).alias("at"), "text")
    return placed.mapInArrow(run, f"set_id {KEY}, fragment int, shingles array<long>")


# --- overlaps

def similar(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (a + b - overlap)


def _met(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """The pairs (a, b), each with both segments of every fragment. Many sets meet the same b, so its segments are
    copied, one for about FOLLOWERS of them."""
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).alias("copies"))
    salted = pairs.join(copies, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies"))).drop("copies")
    of_a = cut.select(F.col("set_id").alias("a"), "fragment", F.col("shingles").alias("of_a"))
    of_b = cut.select(F.col("set_id").alias("b"), "fragment", F.col("shingles").alias("of_b")).join(copies, "b")
    of_b = of_b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    return salted.join(of_a, "a").join(of_b, ["b", "fragment", "salt"]).drop("salt")


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """The pairs with their overlap: partial counts by fragment, summed per pair."""
    others = [c for c in pairs.columns if c not in ("a", "b")]
    partial = _met(pairs, cut).select(*pairs.columns, "fragment", F.size(F.array_intersect("of_a", "of_b")).alias("part"))
    return partial.distinct().groupBy("a", "b", *others).agg(F.sum("part").alias("overlap"))


def differences(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """key, set_id, size, rest, share, centre: for each pair of a set and a leader (a, b, size_a, size_b, overlap) the first
    parts of the difference: shingles that the set has beside the leader, then those it misses.

    Similar sets x and y need an overlap of t (|x| + |y|), t = percent / (100 + percent). With leader l, misses A and
    additions B, they have |l| - |Ax| - |Ay| and what their differences share. So the differences share no less than
    share(x) + share(y), where share(x) = t |x| + |Ax| - |l| / 2. The leader's own share is the least there is; a set is
    linked with the leader if both shares add up to no more than 0."""
    t = percent / (100 + percent)
    sides = {"added": F.array_except("of_a", "of_b"), "missed": F.array_except("of_b", "of_a")}
    each = _met(pairs.select("a", "b", "size_a", "size_b", "overlap"), cut)
    lists = (F.sort_array(F.collect_set(F.struct("fragment", F.sort_array(x).alias("of")))).alias(c) for c, x in sides.items())
    each = each.groupBy("a", "b", "size_a", "size_b", "overlap").agg(*lists)
    parts = [F.transform(F.flatten(F.col(f"{c}.of")), lambda x, k=k: F.struct(F.lit(k).alias("side"), x.alias("shingle"))) for k, c in enumerate(sides)]
    each = each.select("a", "b", "size_a", "size_b", "overlap", F.posexplode(F.concat(*parts)).alias("at", "part"))
    least = F.col("size_b") / 2 - t * F.col("size_b")  # minus the leader's share
    each = each.withColumn("rest", F.col("size_a") + F.col("size_b") - 2 * F.col("overlap") - F.col("at"))
    each = each.withColumn("share", t * F.col("size_a") + F.col("size_b") / 2 - F.col("overlap"))
    each = each.withColumn("linked", F.col("share") <= least + ABOUT)
    each = each.withColumn("strong", F.col("rest") > F.col("share") + least - ABOUT)
    # Of two sets one isn't linked. Its share is above the leader's bound, so the other one's rest must be too.
    each = each.filter(F.col("strong") | (~F.col("linked") & (F.col("rest") >= F.col("share") - least - ABOUT)))
    each = each.select(
        F.xxhash64("b", "part").alias("key"), F.col("a").alias("set_id"), F.col("size_a").alias("size"), "rest", "share", "linked", "strong",
        (2 * F.col("overlap") - F.col("size_a") - F.col("size_b")).alias("centre"),
    )
    each = staged(each, "vertical-differences")
    # What is left of a set that isn't strong meets linked sets only.
    meets = each.filter("linked").select("key").distinct()
    return each.filter("strong").unionByName(each.filter("NOT strong").join(meets, "key", "left_semi")).drop("linked", "strong")


# --- links

def _few_of(size: Column, percent: int) -> Column:
    """How many first shingles a set of the size has."""
    return size - F.ceil(size * percent / 100 - F.lit(1e-9)) + 1


def prefix_pairs(small: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """a, b, size_a, size_b of the sets that meet in a small group and may be similar: by size and position, and by how
    many of their first shingles (``shared``: set_id, keys) they share. Of what follows, they share at most what one has."""
    pairs = _pairs(small, small, percent, F.col("set_id_x") > F.col("set_id_y"))
    keys = {c: shared.select(F.col("set_id").alias(c), F.col("keys").alias(f"keys_{c}")) for c in ("a", "b")}
    counted = pairs.join(keys["a"], "a").join(keys["b"], "b").withColumn("both", F.size(F.array_intersect("keys_a", "keys_b")))
    needed = (F.col("size_a") + F.col("size_b")) * (percent / (100 + percent)) - ABOUT
    behind = F.greatest(*(F.col(c) - _few_of(F.col(c), percent) for c in ("size_a", "size_b")))
    return counted.filter(F.col("both") + behind >= needed).select("a", "b", "size_a", "size_b")


def _pairs(x: DataFrame, y: DataFrame, percent: int, *more: Column) -> DataFrame:
    """Pairs of a group that size and position allow; larger id first."""
    x, y = (g.select("key", *(F.col(c).alias(f"{c}_{k}") for c in g.columns if c != "key")) for g, k in ((x, "x"), (y, "y")))
    fits = F.least("size_x", "size_y") * 100 >= F.greatest("size_x", "size_y") * percent
    # At the first part that two sets share they can share no more than begins there in each.
    may = fits & (F.least("rest_x", "rest_y") >= F.col("share_x") + F.col("share_y") - ABOUT)
    for c in more:
        may = may & c
    swap = F.col("set_id_x") < F.col("set_id_y")
    ordered = {}
    for c in ("set_id", "size"):
        ordered[c, "a"] = F.when(swap, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x"))
        ordered[c, "b"] = F.when(swap, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y"))
    chosen = x.join(y, "key").filter(may & (F.col("set_id_x") != F.col("set_id_y")))
    return chosen.select(ordered["set_id", "a"].alias("a"), ordered["set_id", "b"].alias("b"), ordered["size", "a"].alias("size_a"), ordered["size", "b"].alias("size_b")).distinct()


def _links(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    counted = overlaps(pairs, cut)
    return counted.filter(similar(F.col("overlap"), F.col("size_a"), F.col("size_b"), percent)).select("a", "b")


def _led(groups: DataFrame) -> DataFrame:
    """The groups with the most central set of each: leader, leader_size, and leader_root where roots are known."""
    named_by = [c for c in ("set_id", "size", "root") if c in groups.columns]
    best = groups.groupBy("key").agg(F.max(F.struct("centre", *named_by)).alias("best"))
    leaders = best.select("key", *(F.col(f"best.{c}").alias("leader" if c == "set_id" else f"leader_{c}") for c in named_by))
    return staged(groups.join(leaders, "key"), "vertical-led")


def _stars(groups: DataFrame) -> DataFrame:
    """a, b, size_a, size_b: every set of the groups with each of its leaders; b is the leader."""
    joined = groups.filter(F.col("set_id") != F.col("leader"))
    return joined.select(F.col("set_id").alias("a"), F.col("leader").alias("b"), F.col("size").alias("size_a"), F.col("leader_size").alias("size_b")).distinct()


def _roots(links: DataFrame) -> DataFrame:
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return staged(components(ordered), "vertical-roots")


def _mixed(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """The groups in which more than one component is left, with the root of each set."""
    rooted = groups.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return rooted.join(mixed, "key")


def _crowds(groups: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Groups of at most ``crowd`` sets, of two at least, and larger ones with their leaders."""
    sized = groups.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    sized = staged(groups.join(sized, "key"), "vertical-groups")
    large = sized.filter(F.col("members") > crowd)
    return sized.filter(F.col("members") <= crowd), large


def _apart() -> Column:
    return (F.col("root_x") != F.col("root_y")) & (F.col("set_id_x") > F.col("set_id_y"))


def set_roots(docs: DataFrame, read: DataFrame, classes: DataFrame, words: int, percent: int, crowd: int = CROWD) -> DataFrame:
    """node, root: the sets that are linked with others, and the least of each component. ``classes``: set_id, least."""
    found, context = shingle_counts(read), docs.sparkSession.sparkContext
    counts = context.broadcast(np.minimum(found, (1 << 32) - 1).astype(np.uint32))
    filed = staged(first_shingles(docs, words, percent, counts), "vertical-filed")
    met = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    filed = filed.join(met, "key", "left_semi").distinct().withColumn("share", F.col("size") * (percent / (100 + percent)))
    small, large = _crowds(filed, crowd)

    # Only sets that are compared are cut, each in one document.
    shared = small.unionByName(large).groupBy("set_id", "size").agg(F.collect_list("key").alias("keys"))
    shared = staged(shared, "vertical-shared")  # a list is a part of its text
    few = staged(prefix_pairs(small, shared, percent), "vertical-few")
    compared = few.select(F.col("a").alias("set_id")).unionByName(few.select(F.col("b").alias("set_id"))).unionByName(large.select("set_id"))
    chosen = classes.join(compared, "set_id", "left_semi").select(F.col("least").alias("doc_id"))
    cut = segments(docs, words, counts, fragment_ends(found), context.broadcast(marks(chosen)))
    cut = staged(cut, "vertical-segments")

    links = staged(_links(few, cut, percent), "vertical-links")
    # A set is central if few of its first shingles are in no other set.
    groups = _led(large.join(shared.select("set_id", (F.size("keys") - _few_of(F.col("size"), percent)).cast("long").alias("centre")), "set_id"))
    both = F.col("size_a") + F.col("size_b") - F.col("overlap")
    is_linked = similar(F.col("overlap"), F.col("size_a"), F.col("size_b"), percent)
    stars = staged(overlaps(_stars(groups), cut), "vertical-stars")
    links = links.unionByName(stars.filter(is_linked).select("a", "b"))
    while True:
        roots = _roots(links)
        live = staged(_mixed(groups, roots), "vertical-live")
        if live.isEmpty():
            return roots
        led = live.join(stars.withColumnsRenamed({"a": "set_id", "b": "leader"}), ["set_id", "leader"])
        # Similar sets differ in their distance from the leader by no more than 100 - percent.
        is_far, is_loose = (100 * F.col("overlap") < (3 * percent - 200) * both), (100 * F.col("overlap") <= (2 * percent - 100) * both)
        far = _pairs(led.filter(is_far), led.filter(is_loose), percent, F.col("root_x") != F.col("root_y"))
        links = links.unionByName(staged(_links(far, cut, percent), "vertical-links"))
        close = led.filter(~is_far).select(F.col("set_id").alias("a"), F.col("leader").alias("b"), "size_a", "size_b", "overlap").distinct()
        small, large = _crowds(differences(close, cut, percent), crowd)
        groups = _led(_mixed(large, roots))
        stars = staged(overlaps(_stars(groups), cut), "vertical-stars")
        links = links.unionByName(stars.filter(is_linked).select("a", "b"))
        outside = F.col("root") != F.col("leader_root")
        judged = groups.join(stars.withColumnsRenamed({"a": "set_id", "b": "leader"}), ["set_id", "leader"])
        judged = judged.groupBy("key").agg(F.count_if(outside).alias("apart"), F.count_if(outside & is_linked).alias("met"))
        slow = F.col("met") * 4 < F.col("apart")
        direct = _mixed(small, roots).unionByName(groups.join(judged.filter(slow), "key", "left_semi"), allowMissingColumns=True)
        direct = staged(direct.select("key", "set_id", "size", "rest", "share", "root"), "vertical-apart")
        links = links.unionByName(staged(_links(_pairs(direct, direct, percent, _apart()), cut, percent), "vertical-links"))
        groups = groups.join(judged.filter(~slow), "key", "left_semi").drop("root", "leader_root")


def near_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: documents are linked when their sets of ``words``-word shingles
    have a Jaccard similarity of ``percent`` per cent or more; component_id is the least doc_id reachable over links.

    A-Z are lower-cased, words are runs of anything but ASCII white space. A text of fewer words is one shingle. Null and
    empty texts, and those of white space, have an empty set and are linked with nothing. Repeated rows have a row each.
    A row with null doc_id has a component like any other but never names one; if only such rows are reachable,
    component_id is null. An empty table gives no rows. Columns other than doc_id and text aren't read."""
    read = staged(read_sets(docs, words), "vertical-sets")
    rows = read.filter("bucket IS NULL").select("doc_id", "set_id", "size")
    classes = staged(rows.filter("size > 0").groupBy("set_id").agg(F.min("doc_id").alias("least")), "vertical-classes")
    roots = set_roots(docs, read, classes, words, percent, crowd)
    linked = named(rows.filter("size > 0").select("doc_id", "set_id"), classes, roots, "set_id")
    sizes = rows.select("set_id", "size").distinct()
    linked = linked.join(sizes, "set_id").select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
    empty = rows.filter("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def op12_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_sets(table(spark, sf_dir, "documents"), words=3, percent=90)


TWINS = {
    "op12_vertical": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'),
    lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
c AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS least FROM s GROUP BY list_sort(s), len(s)),
x AS (SELECT least, n, unnest(s) AS t FROM c),
f AS (SELECT t, count(*) AS df FROM x GROUP BY t),
o AS (SELECT least, n, x.t, row_number() OVER (PARTITION BY least ORDER BY f.df, x.t) AS p FROM x JOIN f ON f.t = x.t),
h AS (SELECT * FROM o WHERE p <= n - ceil(n * 9 / 10.0) + 1),
q AS (SELECT DISTINCT a.least AS a, b.least AS b FROM h a JOIN h b ON a.t = b.t AND a.least > b.least AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 9),
l AS (SELECT q.a, q.b FROM q JOIN c a ON a.least = q.a JOIN c b ON b.least = q.b
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 90 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (SELECT least, least FROM c UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.root),
z AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE z.root END AS component_id
FROM s JOIN c ON c.s = list_sort(s.s) JOIN z ON z.node = c.least"""
}
QUERIES = {"op12_vertical": op12_vertical}

"""Toxicity by two class-conditional Kneser-Ney models.

Texts are lower-cased words. Toxic and ordinary labelled texts have their own counts of word pairs; below those, of
words and of word stems (the first bytes of a word), counted Kneser-Ney fashion by the contexts, here documents, that
they occur in, so that one text that repeats itself counts once. Of each class's count the absolute discount is what
lies within ``DISCOUNT`` standard deviations of the shared expectation; it goes back to the counts that both classes
share, split as the next lower order would split them, with ``SHARED`` observations more. So what is rare says what its
words and stems say, and neither class gains by having more text. A text's evidence is the difference of its two
log-likelihoods over its distinct pairs, divided by their number.

All labelled rows of the training folds are counted. An expression's part is its log ratio less that of the next lower
order, so a text's evidence is the plain sum of the parts of its pairs, words and stems. Counts within the discount
leave a part of exactly nothing; all other parts are rows of a table that grows with the corpus. The commonest of them
travel to the texts, and the rest is joined to the texts' keys.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.llm.common import sieved, slices, staged, table, uniform

STEM_BYTES = 5
DISCOUNT, SHARED = 3.0, 5.0
PAIR_CUT = 3  # documents; counts under DISCOUNT can't get beyond it, so the part of rarer pairs is nothing
HOT_PARTS = 1 << 17  # parts that travel to the texts, at most; only speed depends on it
SIEVE_BITS = 24  # of the filter for keys that have a part in the joined table; it lets some others through, loses none
WORDS_HELD = 400_000  # while expressions are counted, where a new start writes what was added up
WORDS_MET = 1 << 16  # while parts are looked up, where a new start costs little
CALIBRATE_ROWS = 20_000  # labelled rows of the calibration fold, about, that the two coefficients are fitted on
SLICE_BYTES, HELD_KEYS = 2 << 20, 1 << 20
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class _Words(dict):
    """Word to its place, from 1, in the words seen by this process; place 0 stands before a text's first word. Keys
    that hold everywhere are 64-bit hashes."""

    def __init__(self) -> None:
        self.start()

    def start(self) -> None:
        self.clear()
        self.keyed, self.stem_at = array("Q", [xxhash.xxh64_intdigest(b"")]), array("q", [0])
        self.stems, self.stems_keyed = {b"": 0}, array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        stem = word[:STEM_BYTES]
        at = self.stems.setdefault(stem, len(self.stems))
        if at == len(self.stems_keyed):
            self.stems_keyed.append(xxhash.xxh64_intdigest(stem, 1))
        self[word] = out = len(self.keyed)
        self.keyed.append(xxhash.xxh64_intdigest(word))
        self.stem_at.append(at)
        return out

    def stems_of(self, words: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.stem_at, np.int64)[words.astype(np.int64)].astype(np.uint64)

    def word_keys(self, words: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.keyed, np.uint64)[words.astype(np.int64)]

    def stem_keys(self, stems: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.stems_keyed, np.uint64)[stems.astype(np.int64)]


_words = _Words()


def numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in one run, and how many there are of each text."""
    parts = [(t or "").lower().encode("utf-8", "replace").translate(_SPACED).split() for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    words = np.fromiter((x for p in parts for x in map(_words.__getitem__, p)), np.uint64, int(sizes.sum()))
    return words, sizes


def paired(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each word with the one before it, above it; a text's first has zero before it."""
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]]) if len(words) else words
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = 0
    return before << np.uint64(32) | words


def distinct_pairs(words: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Each text's different pairs, in order of their numbers."""
    pairs, ends = paired(words, sizes), np.cumsum(sizes)
    return [np.unique(pairs[end - size : end]) for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]


def last_of(pairs: np.ndarray) -> np.ndarray:
    return pairs & np.uint64(0xFFFFFFFF)


def pair_keys(pairs: np.ndarray) -> np.ndarray:
    """As ``pair_key``: the first word's key turned by one bit, with the last word's."""
    first = _words.word_keys(pairs >> np.uint64(32))
    return (first << np.uint64(1) | first >> np.uint64(63)) ^ _words.word_keys(last_of(pairs))


def pair_key(first: str, last: str) -> Column:
    turned = F.shiftleft(first, 1).bitwiseOR(F.shiftrightunsigned(first, 63))
    return turned.bitwiseXOR(F.col(last))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, order, key, above, n: documents that hold a pair (2), word (1) or stem (0), added up over what a task
    reads. The key is the (last) word's or the stem's; above it is a pair's first word or a word's stem."""
    held: dict[tuple[int, int], list] = {(y, order): [] for y in (0, 1) for order in (0, 1, 2)}

    def merged(at) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held[at], strict=True))
        held[at] = []
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    def named(order: int, keys: np.ndarray) -> list[np.ndarray]:
        if order == 0:
            return [_words.stem_keys(keys), np.zeros(len(keys), np.uint64)]
        if order == 1:
            return [_words.word_keys(keys), _words.stem_keys(_words.stems_of(keys))]
        return [_words.word_keys(last_of(keys)), _words.word_keys(keys >> np.uint64(32))]

    def out(at) -> Iterator[pa.RecordBatch]:
        keys, n = merged(at)
        for k in range(0, len(keys), 100_000):
            part = slice(k, k + 100_000)
            fixed = [pa.array(np.full(len(keys[part]), v, np.int32)) for v in at]
            names = [pa.array(x.view(np.int64)) for x in named(at[1], keys[part])]
            yield pa.RecordBatch.from_arrays([*fixed, *names, pa.array(n[part])], ["toxic", "order", "key", "above", "n"])

    def all_out() -> Iterator[pa.RecordBatch]:
        for at, lists in held.items():
            if lists:
                yield from out(at)
        _words.start()

    for batch in slices(batches, "text", SLICE_BYTES):
        if len(_words) > WORDS_HELD:
            yield from all_out()
        labels, texts = batch.column("toxic").to_pylist(), batch.column("text").to_pylist()
        for y in (0, 1):
            pairs = distinct_pairs(*numbered([t for t, label in zip(texts, labels, strict=True) if label == y]))
            words = [np.unique(last_of(x)) for x in pairs]
            found = {2: pairs, 1: words, 0: [np.unique(_words.stems_of(x)) for x in words]}
            for order, lists in found.items():
                if lists:
                    held[y, order].append(np.unique(np.concatenate(lists), return_counts=True))
                    if sum(len(k) for k, _ in held[y, order]) > HELD_KEYS:
                        held[y, order] = [merged((y, order))]
                        if len(held[y, order][0][0]) > HELD_KEYS // 2:
                            yield from out((y, order))
    yield from all_out()  # workers live on; the words of a task don't


def sieve_bits(keys: np.ndarray) -> list[np.ndarray]:
    """Two bits of the sieve for each key."""
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return [mixed >> np.uint64(64 - SIEVE_BITS), (mixed >> np.uint64(8)) & np.uint64((1 << SIEVE_BITS) - 1)]


@dataclass
class Hot:
    """The parts that travel, in order of their keys, and the sieve for the others' keys; None where there are none."""

    keys: np.ndarray
    parts: np.ndarray
    sieve: np.ndarray | None

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' parts, zero for others, and which keys may have one in the joined table."""
        at = np.searchsorted(self.keys, keys)
        own = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        parts = np.zeros(len(keys))
        parts[own] = self.parts[at[own]]
        if self.sieve is None:
            return parts, np.zeros(len(keys), bool)
        there = ~own
        for bit in sieve_bits(keys):
            there &= (self.sieve[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return parts, there

    def gather(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's number of distinct pairs and sum of parts here; then text, key and how often it counts, for keys
        to be joined."""
        if len(_words) > WORDS_MET:
            _words.start()
        pairs = distinct_pairs(*numbered(texts))
        sizes = np.array([len(x) for x in pairs], np.int64)
        of, every = np.repeat(np.arange(len(texts)), sizes), np.concatenate([np.zeros(0, np.uint64), *pairs])
        words = last_of(every).astype(np.int64)
        used = np.flatnonzero(np.bincount(words, minlength=1)).astype(np.uint64)
        total, left = np.zeros(len(every)), []
        for keys in (_words.word_keys(used), _words.stem_keys(_words.stems_of(used))):
            parts, there = np.zeros(len(_words) + 1), np.zeros(len(_words) + 1, bool)
            named = np.zeros(len(_words) + 1, np.uint64)
            at = used.astype(np.int64)
            (parts[at], there[at]), named[at] = self.of(keys), keys
            total += parts[words]
            some = np.flatnonzero(there[words])
            left.append((of[some], named[words[some]]))
        keys = pair_keys(every)
        parts, there = self.of(keys)
        left.append((of[there], keys[there]))
        at, keys = (np.concatenate(x) for x in zip(*left, strict=True))
        order = np.lexsort((keys, at))
        at, keys = at[order], keys[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (at[1:] != at[:-1]) | (keys[1:] != keys[:-1])]))
        n = np.diff(np.append(first, len(at)))
        return sizes, np.bincount(of, total + parts, len(texts)).astype(float), at[first], keys[first], n


@dataclass
class Ratios:
    """Parts of log ratios, those that travel and a table (key, part) of the others, and the coefficients that turn
    evidence into a score."""

    hot: Hot
    others: DataFrame
    slope: np.ndarray
    offset: float


def evidence(docs: DataFrame, ratios: Ratios, columns: list[str]) -> DataFrame:
    """The columns, with a and b: log ratio over length, and over the root of length, of each row's text. Zero for a
    text without letters and digits."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *columns, "text")
    shared = docs.sparkSession.sparkContext.broadcast(ratios.hot)  # at most HOT_PARTS parts and the sieve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            sizes, total, at, keys, n = shared.value.gather(batch.column("text").to_pylist())
            fixed = [batch.column(c) for c in ("row", *columns)]
            blank = [pa.nulls(batch.num_rows, pa.int64())] * 2
            names = ["row", *columns, "size", "total", "key", "n"]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(sizes), pa.array(total), *blank], names)
            for k in range(0, len(at), 100_000):
                part = slice(k, k + 100_000)
                named = [pa.array(batch.column("row").to_numpy(zero_copy_only=False)[at[part]])]
                named += [pa.nulls(len(at[part]), c.type) for c in fixed[1:]] + [pa.nulls(len(at[part]), t) for t in (pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*named, pa.array(keys[part].view(np.int64)), pa.array(n[part])], names)
        _words.start()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    found = staged(rows.mapInArrow(run, f"{kinds}, size long, total double, key long, n long"), "kneser-evidence")
    joined = found.filter("key IS NOT NULL").select("row", "key", "n").join(ratios.others, "key")
    more = joined.groupBy("row").agg(F.sum(F.col("n") * F.col("part")).alias("more"))
    out = found.filter("key IS NULL").drop("key", "n").join(more, "row", "left")
    whole, size = F.col("total") + F.coalesce("more", F.lit(0.0)), F.greatest("size", F.lit(1))
    return out.select(*columns, (whole / size).alias("a"), (whole / F.sqrt(size)).alias("b"))


def score_of(ratios: Ratios) -> Column:
    margin = F.col("a") * float(ratios.slope[0]) + F.col("b") * float(ratios.slope[1]) + ratios.offset
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))))


def maybe_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among the labels': all that are, and few others. The join that follows is exact."""
    return sieved(docs, labels)


def count_expressions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """order, key, above, n1, n0: in how many toxic and ordinary documents; labels: doc_id, toxic."""
    # Labels grow with the documents: both are shuffled at every size, of the texts those that may have a label.
    rows = maybe_labelled(docs.select("doc_id", "text"), labels).join(labels.hint("shuffle_hash"), "doc_id").select("text", "toxic")
    counted = rows.mapInArrow(_count, "toxic int, order int, key long, above long, n long")
    of = {f"n{y}": F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)) for y in (0, 1)}
    found = counted.groupBy("order", "key", "above").agg(*(x.alias(c) for c, x in of.items()))
    return found.filter((F.col("order") < 2) | (F.col("n0") + F.col("n1") >= PAIR_CUT))


def _kept(prior: Column) -> Column:
    """What of the toxic count lies beyond the discount, if the split is expected as the prior log odds say."""
    expected = (F.col("n0") + F.col("n1")) / (1 + F.exp(-prior))
    beyond = F.col("n1") - expected
    return F.signum(beyond) * F.greatest(F.lit(0.0), F.abs(beyond) - DISCOUNT * F.sqrt(expected + 1))


def _topped(prior: Column) -> Column:
    """Log odds of an expression's counts, discounted towards the split that the prior log odds expect: those
    themselves where nothing is kept."""
    share, whole = 1 / (1 + F.exp(-prior)), F.col("n0") + F.col("n1")
    toxic = F.least(F.greatest(whole * share + _kept(prior), F.lit(0.0)), whole)
    odds = F.log((toxic + SHARED * share) / (whole - toxic + SHARED * (1 - share)))
    return F.when(_kept(prior) == 0, prior).otherwise(odds)


def log_ratios(counts: DataFrame) -> DataFrame:
    """key, n, part: of every pair, word and stem with a part. The log ratio says how much likelier the expression is
    in toxic text, for pairs given the first word; the part is what it has beyond the next lower order's."""
    totals = {r["order"]: r for r in counts.groupBy("order").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).collect()}
    odds = {k: float(np.log((totals[k]["n1"] + 1) / (totals[k]["n0"] + 1))) if k in totals else 0.0 for k in (0, 1, 2)}
    of = {k: counts.filter(F.col("order") == k).drop("order") for k in (0, 1, 2)}
    n = (F.col("n0") + F.col("n1")).alias("n")

    def parts(rows: DataFrame, key: Column) -> DataFrame:
        return rows.filter(_kept(F.col("shift") + F.col("prior")) != 0).select(key.alias("key"), n, (F.col("r") - F.col("prior")).alias("part"))

    def ratios(rows: DataFrame) -> DataFrame:
        return rows.withColumn("r", _topped(F.col("shift") + F.col("prior")) - F.col("shift"))

    stems = ratios(of[0].withColumn("prior", F.lit(0.0)).withColumn("shift", F.lit(odds[0])))
    known = stems.select(F.col("key").alias("above"), F.col("r").alias("prior"))
    words = staged(ratios(of[1].join(known, "above").withColumn("shift", F.lit(odds[1]))), "kneser-words")
    last = words.select("key", F.col("r").alias("prior"))
    first = words.select(F.col("key").alias("above"), F.col("r").alias("given"))
    pairs = of[2].join(last, "key").join(first, "above", "left")
    pairs = ratios(pairs.withColumn("shift", F.coalesce("given", F.lit(0.0)) + odds[2]))
    found = parts(stems, F.col("key")).unionByName(parts(words, F.col("key")))
    return found.unionByName(parts(pairs, pair_key("above", "key")))


def _dealt(parts: DataFrame, most: int) -> tuple[Hot, DataFrame]:
    """The commonest parts, at most so many, with a sieve for the others; and the others: key, part."""
    step = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, 1 << 30
    for r in sorted(parts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # eight for each doubling
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    hot, others = parts.filter(step >= least).select("key", "part").toArrow(), parts.filter(step < least).select("key", "part")
    keys, values = hot.column("key").to_numpy().view(np.uint64), hot.column("part").to_numpy()
    order = np.argsort(keys)
    sieve = None
    if held > hot.num_rows:

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bit in sieve_bits(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)):
                    ones = np.uint64(1) << (bit & np.uint64(63))
                    yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int32)), pa.array(ones.view(np.int64))], ["at", "ones"])

        found = others.mapInArrow(bits, "at int, ones long").groupBy("at").agg(F.bit_or("ones").alias("ones")).toArrow()
        sieve = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
        sieve[found.column("at").to_numpy()] = found.column("ones").to_numpy().view(np.uint64)
    return Hot(keys[order], values[order], sieve), others


def calibrate(evidence: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps on standardised evidence, lightly ridged."""
    if len(np.unique(labels)) < 2:
        return np.array([200.0, 0.0]), -2.0
    mean, spread = evidence.mean(0), evidence.std(0) + 1e-9
    x = np.hstack([(evidence - mean) / spread, np.ones((len(evidence), 1))])
    w, ridge = np.zeros(3), np.diag([0.01, 0.01, 1e-6]) * 10
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
    slope = w[:2] / spread
    return slope, float(w[2] - slope @ mean)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, calibrated_on: int = 1, hot: int = HOT_PARTS) -> Ratios:
    """Models of the labelled rows whose crc32(doc_id) mod ``modulus`` is neither the held-out fold nor the one that
    the two coefficients are fitted on. A doc_id labelled twice is toxic if one label says so; labels other than 0 and
    1, and null ids, are left out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("toxic"))
    fold = F.crc32(F.col("doc_id").cast("string")) % modulus
    counted = ~fold.isin(held_out, calibrated_on)  # on both sides, so that other folds' texts aren't shuffled
    counts = staged(count_expressions(docs.filter(counted), usable.filter(counted)), "kneser-counts")
    parts = staged(log_ratios(counts), "kneser-parts")
    out = Ratios(*_dealt(parts, hot), np.zeros(2), 0.0)
    other = usable.filter(fold == calibrated_on)
    share = min(1.0, CALIBRATE_ROWS / max(1, other.count()))
    drawn = F.broadcast(other.filter(uniform(10, F.col("doc_id")) < share))  # about CALIBRATE_ROWS rows
    rows = evidence(docs.select("doc_id", "text").join(drawn, "doc_id"), out, ["toxic"]).collect()
    out.slope, out.offset = calibrate(np.array([[r["a"], r["b"]] for r in rows]).reshape(-1, 2), np.array([r["toxic"] for r in rows], float))
    return out


def score_documents(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """doc_id, score: one row for each document. Null and empty texts, and texts without letters and digits, have no
    evidence and one and the same score."""
    found = evidence(docs.select(F.col("doc_id").cast("long"), "text"), ratios, ["doc_id"])
    return found.select("doc_id", score_of(ratios).alias("score"))


def keep_ordinary(docs: DataFrame, ratios: Ratios, most: float = 0.5) -> DataFrame:
    """The documents with a score under ``most``, all columns: those without a like row, by doc_id and text, among the
    documents that score more."""
    marked = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "text")
    scored = evidence(marked, ratios, ["_id", "_text"])
    dropped = staged(scored.filter(score_of(ratios) >= most).select("_id", "_text").distinct(), "kneser-dropped")
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_id"]) & (F.xxhash64(docs["text"]) == dropped["_text"]), "left_anti")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; rows whose crc32(doc_id) mod 5 is 0 are held out of all fitting."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op10_kneser_ney": op10_kneser_ney}

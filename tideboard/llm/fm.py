"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Each of the features i has a weight and a short vector. A document's score adds the weighted features x and, for every
pair of them, the inner product of their vectors times both features; the sum over pairs is half the difference of the
squared sum and the sum of squares, so scoring is linear in the number of features present.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.llm.common import slices, table, uniform

BUCKETS, RANK = 1 << 16, 8
PER_CLASS = 3000  # labelled rows of either label that the fit reads, about; the rest of the labels isn't needed
SLICE_BYTES, WORDS_HELD = 2 << 20, 1 << 16
STATISTICS = (
    "words", "word length", "distinct", "single", "commonest", "repeats", "capitals", "symbol runs", "bars", "digits",
    "marks", "lines", "line repeats", "short lines", "n_chars",
)
_RUNS = re.compile(r"[^\w\s]{2,}")
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        self[word] = out = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return out


_bucket = _Buckets()


def statistics(text: str, words: list[str], counts: Counter, n_chars: float | None) -> list[float]:
    """One number for each of STATISTICS; an empty text has zeros."""
    n, raw, lines = len(words), text.encode("utf-8", "replace"), text.split("\n")
    return [
        np.log1p(n),
        len(text) / max(1, n),
        len(counts) / max(1, n),
        sum(map((1).__eq__, counts.values())) / max(1, n),
        max(counts.values(), default=0) / max(1, n),
        sum(map(operator.eq, words, words[1:])) / (n + 8),  # one pair in a short text says little
        sum(map(str.isupper, words)) / max(1, n),
        len(_RUNS.findall(text)) / max(1, n),
        raw.count(b"|") / max(1, n),
        len(raw.translate(None, _NOT_DIGITS)) / max(1, len(raw)),
        (len(raw) - len(raw.translate(None, _MARKS))) / max(1, len(raw)),
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines),
        np.log1p(max(0.0, n_chars or 0.0)),
    ]


def features(text: str | None, n_chars: float | None) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Statistics, distinct word buckets, and a unit vector of damped counts over them."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    held = np.fromiter(map(_bucket.__getitem__, map(str.lower, counts)), np.int64, len(counts))
    damped = np.bincount(held, np.fromiter(counts.values(), float, len(counts))) if len(held) else np.zeros(0)
    at = np.flatnonzero(damped) if len(held) < BUCKETS // 64 else np.unique(held)
    x = np.log1p(damped[at])
    if len(_bucket) > WORDS_HELD:
        _bucket.clear()
    return statistics(text, words, counts, n_chars), at.astype(np.int32), (x / max(1e-9, np.linalg.norm(x))).astype(np.float32)


@dataclass
class Machine:
    """``weights`` and ``vectors`` have a row for each word bucket and, after those, for each statistic."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, found: list[tuple[list[float], np.ndarray, np.ndarray]]):
        """Feature numbers and values of all documents in one run, and where each document's begin."""
        own = np.arange(len(STATISTICS), dtype=np.int32) + BUCKETS
        scaled = np.clip((np.array([f[0] for f in found]) - self.mean) / self.spread, -4, 4).astype(np.float32) / 2
        at = np.concatenate([y for f in found for y in (own, f[1])])
        x = np.concatenate([y for f, s in zip(found, scaled, strict=True) for y in (s, f[2])])
        starts = np.zeros(len(found), np.int64)
        np.cumsum([len(STATISTICS) + len(f[1]) for f in found[:-1]], out=starts[1:])
        return at, x, starts

    def margin(self, at, x, starts) -> tuple[np.ndarray, np.ndarray]:
        scaled = self.vectors[at] * x[:, None]
        total = np.add.reduceat(scaled, starts)
        squares = np.add.reduceat(np.einsum("ij,ij->i", scaled, scaled), starts)
        linear = np.add.reduceat(self.weights[at] * x, starts)
        return self.bias + linear + ((total**2).sum(1) - squares) / 2, total

    def score(self, found) -> np.ndarray:
        if not found:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.rows(found))[0].astype(float), -30, 30)))


def fit(found: list, labels: np.ndarray, sample_weight: np.ndarray, steps: int = 300, rate: float = 0.02, decay: float = 1e-5, seed: int = 4) -> Machine:
    """Logistic loss by Adam over batches of 256 rows: ten rounds, or as many as make ``steps`` batches. With rows of
    one label only, a constant score."""
    rng, size = np.random.default_rng(seed), BUCKETS + len(STATISTICS)
    own = np.array([f[0] for f in found]) if found else np.zeros((1, len(STATISTICS)))
    out = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32), own.mean(0), own.std(0) + 1e-6)
    share = (float(sample_weight[labels == 1].sum()) + 1) / (float(sample_weight.sum()) + 2)
    out.bias = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        out.vectors[:] = 0
        return out
    state = [np.zeros_like(p) for p in (out.weights, out.weights, out.vectors, out.vectors)]
    bias_state, step, parts = [0.0, 0.0], 0, -(-len(found) // 256)
    for _ in range(max(10, -(-steps // parts))):
        order = rng.permutation(len(found))
        for part in np.array_split(order, parts):
            step += 1
            at, x, starts = out.rows([found[i] for i in part])
            margin, total = out.margin(at, x, starts)
            slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) * sample_weight[part] / sample_weight[part].sum()).astype(np.float32)
            lengths = np.diff(np.append(starts, len(at)))
            s, t = np.repeat(slope, lengths), np.repeat(total, lengths, axis=0)
            grad_v = (s * x)[:, None] * (t - out.vectors[at] * x[:, None])
            present, inverse = np.unique(at, return_inverse=True)
            flat = [np.bincount(inverse, s * x, len(present))] + [np.bincount(inverse, grad_v[:, k], len(present)) for k in range(RANK)]
            grads = (flat[0] + decay * out.weights[present], np.stack(flat[1:], 1) + decay * out.vectors[present])
            for p, g, m, v in ((out.weights, grads[0], state[0], state[1]), (out.vectors, grads[1], state[2], state[3])):
                m[present] = 0.9 * m[present] + 0.1 * g
                v[present] = 0.99 * v[present] + 0.01 * g * g
                p[present] -= rate * m[present] / (1 - 0.9**step) / (np.sqrt(v[present] / (1 - 0.99**step)) + 1e-6)
            bias_state = [0.9 * bias_state[0] + 0.1 * float(slope.sum()), 0.99 * bias_state[1] + 0.01 * float(slope.sum()) ** 2]
            out.bias -= rate * bias_state[0] / (1 - 0.9**step) / (np.sqrt(bias_state[1] / (1 - 0.99**step)) + 1e-6)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        rows = [features(t.as_py(), n.as_py()) for t, n in zip(batch.column("text"), batch.column("n_chars"), strict=True)]
        columns = [batch.column("label"), pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["label", "stats", "at", "x"])
    _bucket.clear()  # workers live on; the words of a task don't


def _text_and_size(docs: DataFrame) -> DataFrame:
    size = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id"), "text", size.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", remainder: int = 1, modulus: int = 3, per_class: int = PER_CLASS) -> Machine:
    """A machine fitted on about ``per_class`` rows of either label, drawn by hash from the labelled rows outside the
    held-out fold, and weighted back to the share of each. A doc_id labelled twice counts with its greater label;
    labels other than 0 and 1, and null ids, are left out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % modulus != remainder))
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("label") == value, min(1.0, per_class / n)).otherwise(share)
    drawn = usable.filter(uniform(4, F.col("doc_id")) < share)
    rows = _text_and_size(docs).join(F.broadcast(drawn), "doc_id").drop("doc_id")  # about 2 * per_class rows
    packed = rows.select("label", "text", "n_chars").mapInArrow(_pack, "label int, stats array<double>, at binary, x binary").collect()
    y = np.array([r["label"] for r in packed], dtype=float)
    found = [(r["stats"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in packed]
    weight = np.array([sizes[int(v)] / max(1, int((y == v).sum())) for v in y], dtype=float)
    return fit(found, y, weight)


def _shared(spark: SparkSession, machine: Machine):
    return spark.sparkContext.broadcast(machine)  # BUCKETS * (RANK + 1) floats, whatever the data


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score: one row for each document. Null and empty texts have no words and a score like any other."""
    shared = _shared(docs.sparkSession, machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = [features(t.as_py(), n.as_py()) for t, n in zip(batch.column("text"), batch.column("n_chars"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(found), pa.float64())], ["doc_id", "score"])
        _bucket.clear()  # workers live on; the words of a task don't

    return _text_and_size(docs).select(F.col("doc_id").cast("long"), "text", "n_chars").mapInArrow(score, "doc_id long, score double")


def keep_good(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The documents with a score of at least ``least``, all columns, in one pass without a shuffle. Repeated rows and
    rows without id are judged like others."""
    shared, sized = _shared(docs.sparkSession, machine), "n_chars" in docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            sizes = batch.column("n_chars").to_pylist() if sized else [None] * batch.num_rows
            found = [features(t.as_py(), n) for t, n in zip(batch.column("text"), sizes, strict=True)]
            yield batch.filter(pa.array(shared.value.score(found) >= least))
        _bucket.clear()

    return docs.mapInArrow(keep, docs.schema)


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; rows whose crc32(doc_id) mod 3 is 1 are held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op4_factorisation_machine": op4_factorisation_machine}

"""Chroma audio fingerprints, and search for recordings that share a stretch of sound.

A recording is cut into overlapping frames; each frame's spectrum is folded onto the twelve pitch classes. Sixteen
filters compare sums over neighbouring rectangles of the frames by pitch classes, each sum four looks into an integral
image; each comparison is two Gray-coded bits, and the bits at a place make a packed 32-bit integer. Two recordings are
aligned by counting, for each difference of places, how many of their integers agree. Wherever enough do, the runs of
places are found in which few bits differ; what lies around a run doesn't count against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.llm.common import staged, table

RATE, FRAME, HOP = 4096, 1024, 512
WINDOW = 16  # frames under the filters of one integer
EVERY, QUERY_BLOCK = 50, 2048
LEAST_HITS, LEAST_OVERLAP, MOST_ERRORS = 3, 8, 0.25
#: Filters as (kind, first pitch class, pitch classes, frames): kinds 0 to 3 compare a rectangle with nothing, its lower
#: and upper half, its earlier and later half, and its diagonal quarters.
FILTERS = tuple((k, (5 * i + 3 * k) % 8, 2 + (i + k) % 3 * 2, (4, 8, 12, 16)[i]) for k in range(4) for i in range(4))
CUTS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def pitch_classes(rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """A row per spectral line from 55 Hz up, with a one for its pitch class."""
    lines = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(lines), 12), np.float32)
    heard = np.flatnonzero(lines >= 55)
    out[heard, np.round(12 * np.log2(lines[heard] / 440)).astype(int) % 12] = 1
    return out


def chroma(signal: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames by pitch classes, each frame of length 1; silent frames are zero."""
    n = 1 + (len(signal) - FRAME) // HOP if len(signal) >= FRAME else 0
    if n == 0:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP][:n] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
    folded = power @ pitch_classes(rate)
    return folded / np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-6)


def fingerprint(signal: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Packed integers, one for each place of the window; none for a signal shorter than it."""
    image = chroma(signal, rate)
    places = len(image) - WINDOW + 1
    if places <= 0:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(places)

    def area(frame: int, frames: int, low: int, classes: int) -> np.ndarray:
        a, b, c, d = at + frame, at + frame + frames, low, low + classes
        return whole[b, d] - whole[a, d] - whole[b, c] + whole[a, c]

    out = np.zeros(places, np.uint32)
    for kind, low, classes, frames in FILTERS:
        start, half, middle = (WINDOW - frames) // 2, frames // 2, classes // 2
        every = area(start, frames, low, classes)
        if kind == 0:
            part = every - area(start, frames, 0, 12) * classes / 12
        elif kind == 1:
            part = 2 * area(start, frames, low + middle, classes - middle) - every
        elif kind == 2:
            part = 2 * area(start + half, half, low, classes) - every
        else:
            part = 2 * (area(start, half, low, middle) + area(start + half, half, low + middle, classes - middle)) - every
        level = np.searchsorted(CUTS, part / frames)
        out = (out << np.uint32(2)) | GRAY[level]
    return out


@dataclass(frozen=True)
class Alignment:
    """A run of places, ``start`` to before ``end`` of a, that match those of b ``offset`` lower."""

    offset: int
    hits: int
    start: int
    end: int
    errors: float

    @property
    def overlap(self) -> int:
        return self.end - self.start


def runs(bits: np.ndarray, hits: int, overlap: int, errors: float) -> list[tuple[int, int]]:
    """From the bits that differ at each place: disjoint runs with a share of at most ``errors``, ``hits`` places
    without any and ``overlap`` places; each is the best that is left, where a place counts by how far it is below the
    share."""
    total = np.concatenate([[0.0], np.cumsum(32 * errors + 1e-9 - bits)])
    agree = np.concatenate([[0], np.cumsum(bits == 0)])
    found, open_ = [], [(0, len(bits))]
    while open_:
        low, high = open_.pop()
        if high - low < overlap or agree[high] - agree[low] < hits:
            continue
        held = total[low : high + 1]
        gains = held - np.minimum.accumulate(held)
        end = int(gains.argmax())
        if gains[end] <= 0:
            continue
        start = int(held[: end + 1].argmin())
        if end - start >= overlap and agree[low + end] - agree[low + start] >= hits:
            found.append((low + start, low + end))
        open_ += [(low, low + start), (low + end, high)]
    return found


def alignments(a: np.ndarray, b: np.ndarray, hits: int = LEAST_HITS, overlap: int = LEAST_OVERLAP, errors: float = MOST_ERRORS) -> list[Alignment]:
    """The matching runs of all differences of places (of a less of b) at which ``hits`` integers agree, the best first.
    A run is left out if a better one at another difference meets it in a and in b: held and repeated notes match
    themselves a little further on."""
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    counts = right - left
    i = np.repeat(np.arange(len(a)), counts)
    j = order[np.repeat(left - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
    offsets, votes = np.unique(i - j, return_counts=True)
    found = []
    for offset in offsets[votes >= hits].tolist():
        first, last = max(0, offset), min(len(a), offset + len(b))
        bits = np.bitwise_count(a[first:last] ^ b[first - offset : last - offset]).astype(np.int64)
        for start, end in runs(bits, hits, overlap, errors):
            wrong, agree = int(bits[start:end].sum()), int((bits[start:end] == 0).sum())
            found.append((32 * errors * (end - start) - wrong, Alignment(offset, agree, first + start, first + end, wrong / (32 * (end - start)))))
    out: list[Alignment] = []
    for _, x in sorted(found, key=lambda f: (-f[0], abs(f[1].offset), f[1].offset, f[1].start)):
        if not any(x.start < y.end and y.start < x.end and x.start - x.offset < y.end - y.offset and y.start - y.offset < x.end - x.offset for y in out):
            out.append(x)
    return out


def align(a: np.ndarray, b: np.ndarray) -> Alignment | None:
    """The best matching run; None if there is none."""
    return next(iter(alignments(a, b)), None)


def fingerprint_recordings(recordings: DataFrame) -> DataFrame:
    """rec_id, prints (the packed integers as bytes). Recordings: rec_id, pcm (16-bit little-endian mono at RATE).

    Null, empty and too short recordings have no integers. An odd last byte is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for pcm in batch.column("pcm"):
                raw = pcm.as_py() or b""
                signal = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
                prints.append(fingerprint(signal).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(prints, pa.binary())], ["rec_id", "prints"])

    return recordings.select(F.col("rec_id").cast("long"), "pcm").mapInArrow(run, "rec_id long, prints binary")


def matches(prints: DataFrame, every: int = EVERY, block: int = QUERY_BLOCK, hits: int = LEAST_HITS, overlap: int = LEAST_OVERLAP, errors: float = MOST_ERRORS) -> DataFrame:
    """query_class, match_class, offset, run_start, run_end, hits, overlap, bit_errors between classes of equal
    fingerprints; a row for each run, whose places in the query class start at run_start and end before run_end.

    Classes are named by their least id. Queries are the classes with a recording whose id divides by ``every``, in
    blocks of a fixed size against all classes; each class looks its integers up in the block's own. A run agrees in
    ``hits`` integers, is ``overlap`` places long and differs in at most ``errors`` of the bits."""
    spark = prints.sparkSession
    classes = prints.filter("rec_id IS NOT NULL AND length(prints) > 0").groupBy("prints")
    classes = staged(classes.agg(F.min("rec_id").alias("class_id"), F.max((F.col("rec_id") % every == 0).cast("int")).alias("asked")), "chroma-classes")
    queries = classes.filter("asked = 1")
    parts = -(-queries.count() // block)
    schema = "query_class long, match_class long, offset int, run_start int, run_end int, hits int, overlap int, bit_errors double"
    out = None
    for k in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64("class_id"), F.lit(parts)) == k).select("class_id", "prints").collect()  # about block rows
        own = [(r["class_id"], np.frombuffer(r["prints"], "<u4")) for r in rows]
        values = np.concatenate([p for _, p in own])
        of = np.repeat(np.arange(len(own)), [len(p) for _, p in own])
        places = np.concatenate([np.arange(len(p)) for _, p in own])
        order = np.argsort(values, kind="stable")
        sent = spark.sparkContext.broadcast((own, values[order], of[order], places[order]))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, values, of, places = sent.value
            for batch in batches:
                found: list[list] = [[] for _ in range(8)]
                for class_id, raw in zip(batch.column("class_id").to_pylist(), batch.column("prints").to_pylist(), strict=True):
                    b = np.frombuffer(raw, "<u4")
                    left = np.searchsorted(values, b, "left")
                    counts = np.searchsorted(values, b, "right") - left
                    at = np.repeat(left - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
                    votes, agree = np.unique(of[at] << 32 | (places[at] - np.repeat(np.arange(len(b)), counts) + (1 << 31)), return_counts=True)
                    for q in np.unique(votes[agree >= hits] >> 32).tolist():  # those that agree often enough at one offset
                        for x in alignments(own[q][1], b, hits, overlap, errors) if own[q][0] != class_id else []:
                            for column, v in zip(found, (own[q][0], class_id, x.offset, x.start, x.end, x.hits, x.overlap, x.errors), strict=True):
                                column.append(v)
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

        part = classes.select("class_id", "prints").mapInArrow(look, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def search_recordings(recordings: DataFrame, every: int = EVERY) -> DataFrame:
    """kind, rec_id, class_id, offset, run_start, run_end, hits, overlap, bit_errors.

    A row of kind "member" for each recording: its class, named by the least id of the same fingerprint; null for
    recordings without fingerprint (null, empty, too short). A row of kind "match" for each matching run of a query class
    (rec_id) with another class (class_id): those of classes with an id that divides by ``every``, against all.
    Repeated rows have a member row each; rows without id are members but never name a class."""
    prints = staged(fingerprint_recordings(recordings), "chroma-prints")
    named = prints.filter("length(prints) > 0").groupBy("prints").agg(F.min("rec_id").alias("class_id"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("offset", "int"), ("run_start", "int"), ("run_end", "int"), ("hits", "int"), ("overlap", "int"), ("bit_errors", "double"))]
    members = prints.join(named, "prints", "left").select(F.lit("member").alias("kind"), "rec_id", "class_id", *blank)
    found = matches(prints, every).select(F.lit("match").alias("kind"), F.col("query_class").alias("rec_id"), F.col("match_class").alias("class_id"), "offset", "run_start", "run_end", "hits", "overlap", F.round("bit_errors", 6).alias("bit_errors"))
    return members.unionByName(found)


def notes_to_pcm(notes: np.ndarray, seconds: float = 0.125, rate: int = RATE) -> np.ndarray:
    """Tones one after the other as 16-bit samples: note 0 is A at 220 Hz, each step a semitone."""
    n = int(seconds * rate)
    phase = 2 * np.pi * 220 * 2 ** (notes[:, None] / 12) * np.arange(n) / rate
    return (12000 * (np.sin(phase) + 0.4 * np.sin(2 * phase)) / 1.4).astype("<i2").reshape(-1)


def recordings_of(vectors: DataFrame) -> DataFrame:
    """rec_id, pcm: a tune for each vector, a note for each component."""

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # 64 kB of samples each
                part = batch.slice(start, 256)
                tunes = []
                for vector in part.column("embedding").to_pylist():
                    notes = np.array([0.0 if x is None or not np.isfinite(x) else x for x in vector or []])
                    tunes.append(notes_to_pcm(np.clip(np.round(12 + 40 * notes), 0, 24)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(tunes, pa.binary())], ["rec_id", "pcm"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(play, "rec_id long, pcm binary")


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tunes of all embeddings: equal ones, and alignments of every fiftieth with all others."""
    return search_recordings(recordings_of(table(spark, sf_dir, "embeddings")))


QUERIES = {"op8_chroma": op8_chroma}

"""Token-id output as shuffled planes.

Documents are tokenised in doc_id order, an end id after each, and the id stream of each shard is cut into blocks of a
fixed number of ids. A block's ids are transposed into planes, all first bytes (or bits), all second ones and so on, and
each plane is compressed by itself: the high planes are nearly constant and vanish.

The file format is a folder of Parquet files, so that executors need no file system of their own and lost tasks leave
no halves. A row is a block: ``planes`` holds the compressed planes one after the other; the other columns are its index:
shard, block, number of ids, length of each plane, and which documents' ids it holds, in order.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideboard.llm.common import slices, staged, table
from tideboard.session import fresh_path

BLOCK_IDS, END_ID = 1 << 16, 0
SLICE_BYTES, HELD_PIECES = 4 << 20, 400_000
BLOCK_SCHEMA = (
    "shard int, block int, n_ids int, mode string, lengths array<int>, planes binary, "
    "doc_ids array<long>, counts array<int>, ordinals array<long>, opened boolean, closed boolean"
)
#: Letters and other characters whose classes all Unicode versions agree on, and, for texts of nothing else, the
#: byte-level vocabulary's way to cut a text. Texts with other characters go to the tokenizer whole.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-я"
SETTLED = re.compile(rf"[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf×÷‐-‧{LETTERS}]*")
PIECES = re.compile(rf" [{LETTERS}]+|[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers. The tokenizer never merges across the pieces that a text is
    cut into, so each different piece is encoded once and the ids of its other occurrences are copied."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = self.tokenizer.get_vocab()
        self.width = np.zeros(max(tokens.values(), default=0) + 1, np.int64)  # bytes of each id, a character of its token each
        self.width[list(tokens.values())] = list(map(len, tokens))
        self.number = defaultdict(itertools.count().__next__)  # of pieces, in the order in which they are first met
        self.ids = np.zeros(0, "<u4")  # of all pieces; where each piece's begin, how many it has, and how often it was met
        self.first, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the pieces that were met again, or none if those are too many."""
        again = self.met > 1
        if again.sum() > HELD_PIECES // 2:
            again[:] = False
        kept = list(itertools.compress(self.number, again))
        self.number = defaultdict(itertools.count(len(kept)).__next__, zip(kept, range(len(kept)), strict=True))
        self.ids, self.size = self.of(np.flatnonzero(again)), self.size[again]
        self.first, self.met = np.cumsum(self.size) - self.size, np.zeros(len(kept), np.int64)

    def of(self, pieces: np.ndarray) -> np.ndarray:
        """The ids of a sequence of pieces."""
        sizes = self.size[pieces]
        return self.ids[np.repeat(self.first[pieces] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encodes the pieces that are numbered next. Those that are words after a space go in one run, which the
        tokenizer cuts into them again, and the others one by one."""
        spaced = np.fromiter((p[0] == " " and p[1:].isalpha() for p in pieces), bool, len(pieces))
        words = list(itertools.compress(pieces, spaced))
        joined = "".join(words)
        run = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        reached = np.cumsum(self.width[run])  # bytes up to the end of each id; each word's end has to be one of them
        wanted = np.cumsum(list(map(len, words if joined.isascii() else map(str.encode, words))), dtype=np.int64)
        last = np.searchsorted(reached, wanted)
        if not (len(words) and len(run) and reached[-1] == wanted[-1] and (reached[last] == wanted).all()):
            spaced[:], run, last = False, run[:0], last[:0]
        others = self.tokenizer.encode_batch_fast(list(itertools.compress(pieces, ~spaced)), add_special_tokens=False)
        apart = [np.asarray(x.ids, "<u4") for x in others]
        size = np.zeros(len(pieces), np.int64)
        size[spaced], size[~spaced] = np.diff(last, prepend=-1), [len(x) for x in apart]
        first = np.zeros(len(pieces), np.int64)
        for which in (spaced, ~spaced):
            first[which] = np.cumsum(size[which]) - size[which]
        first += len(self.ids) + np.where(spaced, 0, len(run))
        self.ids = np.concatenate([self.ids, run, *apart])
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])

    def many(self, texts: list[str]) -> list[bytes]:
        if len(self.number) > HELD_PIECES:
            self.forget()
        cut = [PIECES.findall(t) if SETTLED.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        counts = np.array([len(c or ()) for c in cut], np.int64)
        pieces = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(c or () for c in cut)), np.int64, int(counts.sum()))
        new = list(itertools.islice(self.number, len(self.size), None))
        for k in range(0, len(new), 50_000):
            self.learn(new[k : k + 50_000])
        self.met = np.append(self.met, np.zeros(len(new), np.int64)) + np.bincount(pieces, minlength=len(self.size))
        ends = 4 * np.append(0, np.cumsum(self.size[pieces]))
        ids, bounds = self.of(pieces).tobytes(), ends[np.append(0, np.cumsum(counts))].tolist()
        return [self.whole(t) if c is None else ids[a:b] for t, c, a, b in zip(texts, cut, bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def split_planes(ids: np.ndarray, mode: str = "byte", level: int = 1) -> list[bytes]:
    """The compressed planes of a block of 32-bit ids, the lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "bit":
        raw = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(raw[:, k]).tobytes() for k in range(32)]
    else:
        planes = [raw[:, k].tobytes() for k in range(4)]
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(p) for p in planes]


def join_planes(planes: list[bytes], n_ids: int, mode: str = "byte") -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [np.frombuffer(unpack(p), np.uint8) for p in planes]
    if mode == "bit":
        bits = np.stack([np.unpackbits(p, count=n_ids) for p in raw], 1) if n_ids else np.zeros((0, 32), np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack(raw, 1)).reshape(-1).view("<u4")


def _blocks(path: str, mode: str, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, ordinal = TaskContext.get().partitionId(), 0, 0
        held, parts, opened = bytearray(), [], False  # parts: (doc_id, ordinal, ids in this block)

        def out(closed: bool) -> pa.RecordBatch:
            ids = np.frombuffer(bytes(held), "<u4")
            planes = split_planes(ids, mode)
            row = [shard, block, len(ids), mode, [len(p) for p in planes], b"".join(planes), [p[0] for p in parts], [p[2] for p in parts], [p[1] for p in parts], opened, closed]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_(), pa.bool_()]
            names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in slices(batches, "text", SLICE_BYTES):
            found = encoder(path).many([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                left = memoryview(ids + END_ID.to_bytes(4, "little"))
                while len(left):
                    part = left[: 4 * block_ids - len(held)]
                    held += part
                    parts.append((doc_id, ordinal, len(part) // 4))
                    left = left[len(part) :]
                    if len(held) == 4 * block_ids:
                        yield out(closed=not len(left))
                        block, opened = block + 1, bool(len(left))
                        held, parts = bytearray(), []
                ordinal += 1
        if parts:
            yield out(closed=True)

    return write


def write_planes(docs: DataFrame, path: str, tokenizer: str | None = None, mode: str = "byte", block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all documents in ascending doc_id order: shard after shard, block after block.

    Null and empty texts have the end id only. Documents without an id come first; rows that share one are in order of
    their texts. An empty table writes an empty folder. Other columns are not read."""
    tokenizer = tokenizer or tokenizer_path()
    sorted_docs = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    sorted_docs.mapInArrow(_blocks(tokenizer, mode, block_ids), BLOCK_SCHEMA).write.parquet(path)


def read_block(row: dict) -> np.ndarray:
    ends = np.cumsum(row["lengths"])
    planes = [row["planes"][e - n : e] for e, n in zip(ends, row["lengths"], strict=True)]
    return join_planes(planes, row["n_ids"], row["mode"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's ids, or the part of them that a block holds: whole is false if others hold more."""
    names = ["shard", "block", "ordinal", "doc_id", "at", "n", "whole", "ids"]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            ids = read_block(row).tobytes()
            ends = np.cumsum(row["counts"])
            n, last = len(ends), len(ends) - 1
            whole = [not (k == 0 and row["opened"]) and not (k == last and not row["closed"]) for k in range(n)]
            at = (ends - row["counts"]).tolist()
            columns = [
                pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["ordinals"], pa.int64()),
                pa.array(row["doc_ids"], pa.int64()), pa.array(at, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(whole),
                pa.array([ids[4 * a : 4 * e] for a, e in zip(at, ends.tolist(), strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _documents, with a checksum for the ids of whole documents; parts keep their ids."""
    for batch in _documents(batches):
        whole, ids = batch.column("whole").to_pylist(), batch.column("ids").to_pylist()
        sums = pa.array([zlib.crc32(x) if w else None for w, x in zip(whole, ids, strict=True)], pa.int64())
        rest = pa.array([None if w else x for w, x in zip(whole, ids, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], sums, rest], [*batch.schema.names[:7], "ids_crc32", "ids"])


_PART = "shard int, block int, ordinal long, doc_id long, at long, n long, whole boolean"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids: the id arrays of all documents, from the files."""

    def numbers(batches):
        for batch in batches:
            lists = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("ids").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    parts = spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(_documents, f"{_PART}, ids binary")
    return _joined(parts).select("doc_id", "ids").mapInArrow(numbers, "doc_id long, ids array<long>")


def _joined(parts: DataFrame) -> DataFrame:
    """Whole documents as they are, the others put together from their parts: at most two blocks' ends each way."""
    cut = parts.filter(~F.col("whole")).groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "ids"))), lambda x: F.hex(x["ids"]))).alias("ids"),
    )
    return parts.filter("whole").select("shard", "ordinal", "doc_id", "ids").unionByName(cut.withColumn("ids", F.unhex("ids")))


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, start: ids before each block, from the index columns alone. Two steps, so that no task has more
    than the blocks of a shard or one row per shard."""
    index = spark.read.schema(BLOCK_SCHEMA).parquet(path).select("shard", "block", "n_ids")
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row per task
    before, rows = 0, []
    for r in totals:
        rows.append((r["shard"], before))
        before += r["n"]
    bases = spark.createDataFrame(rows, "shard int, base long")
    own = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return index.withColumn("own", F.coalesce(own, F.lit(0))).join(bases, "shard").select("shard", "block", (F.col("base") + F.col("own")).alias("start"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    parts = spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(_digests, f"{_PART}, ids_crc32 long, ids binary")
    parts = staged(parts, "plane-documents").join(shard_starts(spark, path), ["shard", "block"]).withColumn("start", F.col("start") + F.col("at"))
    whole = parts.filter("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")
    cut = parts.filter(~F.col("whole")).groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "ids"))), lambda x: F.hex(x["ids"]))).alias("ids"),
    )
    return whole.unionByName(cut.select("doc_id", "start", "n_tokens", F.crc32(F.unhex("ids")).alias("ids_crc32")))


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "planes")
    write_planes(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)


QUERIES = {"op1_bit_planes": op1_bit_planes}

"""SentencePiece sampling without replacement, and decoding.

A text's segmentations are the paths of a lattice of vocabulary pieces. Words don't share pieces, so the lattice is a
chain of word lattices, and a text's path is drawn by one uniform number for each word: within a word the paths divide
[0, 1) by their probabilities. The best ``k`` paths under Gumbel-perturbed log-probabilities are found by an A* search
whose nodes are sets of paths, "as this path up to word j, other than it in j": a node's bound is its set's perturbed
maximum, drawn from the set's total probability and below its parent's. Popping a node draws its maximal path and leaves
the sets that the path parts the rest into. The popped paths are a sample without replacement, in order.

Piece probabilities come from the vocabulary's merge ranks by Zipf's law, flattened by ``alpha``; nothing is trained.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.llm.common import slices, table

SAMPLES, ALPHA, SEED = 2, 0.5, 6
RANK_SHIFT = 3.0
SLICE_BYTES, HELD_CHARS = 1 << 18, 1 << 19
LEARNT_CHARS = 50_000  # characters of new words, about, whose lattices are made at once; a longer word is one run
SPACE = "▁"
WORDS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
NEAR, MOST_NOISE = 128, 37.0  # words looked at first; a Gumbel number of a double below 1 is less
_FRESH = 2.0**-30  # a word's number is used up when its path is rarer than this; then it is drawn anew from itself


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mixed(keys: np.ndarray) -> np.ndarray:
    out = keys * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Vocabulary:
    """Pieces with log weights, and hashed lookups of substrings and of prefixes by length."""

    BITS = 20

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        crossing = [p for p in (self.pieces[i] for i in plain) if len(WORDS.findall(p)) != 1]
        if crossing:
            raise ValueError(f"pieces that cross words: {crossing[:3]}")
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        self.raw = pa.array([bytes([byte_of[i]]) if i in byte_of else self.pieces[i].encode() for i in range(n)], pa.binary())
        ranks = np.array([-model.get_score(i) for i in plain])
        weights = 1 / (ranks + RANK_SHIFT)
        logs = alpha * np.log(weights / weights.sum())
        self.byte_log = float(logs.min()) - 1.0
        self.longest = max(len(self.pieces[i]) for i in plain)
        keys = np.array([self.key(self.pieces[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.logs = keys[order], np.array(plain)[order], logs[order]
        slots = self.slot(self.keys)
        self.place, self.is_prefix = np.full(1 << self.BITS, -1, np.int32), np.zeros(1 << self.BITS, bool)
        self.place[slots] = np.arange(len(slots))
        self.shared = np.bincount(slots, minlength=1 << self.BITS) > 1  # slots of several pieces
        self.is_prefix[self.slot(np.array(list({self.key(self.pieces[i][:k]) for i in plain for k in range(1, len(self.pieces[i]) + 1)}), np.uint64))] = True

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (_mixed(keys) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Where each key stands among the pieces; -1 for keys of none."""
        out = self.place[slots]
        doubtful = np.flatnonzero(self.shared[slots])
        out[doubtful] = np.minimum(np.searchsorted(self.keys, keys[doubtful]), len(self.keys) - 1)
        return np.where(self.keys[out] == keys, out, -1)

    @staticmethod
    def key(piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * 1000003 + ord(c) + 1) % (1 << 64)
        return out

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """The text of a sequence of ids."""
        joined = self.raw.take(pa.array(ids, pa.int64())).buffers()[2]
        return str(joined or b"", "utf-8", "replace").replace(SPACE, " ")[1:]


class Lattices:
    """The lattices of the words met so far. Edges of a position stand together; ``cum`` adds up the probabilities of
    the paths through them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.number = defaultdict(itertools.count().__next__)  # of words, in the order in which they are first met
        self.first_char = np.zeros(1, np.int64)  # of each word, and one past the last
        self.first_edge = np.zeros(1, np.int64)  # of each character, and one past the last
        self.cum, self.log = np.zeros(0), np.zeros(0, np.float32)
        self.piece, self.step = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def learn(self, words: list[str]) -> None:
        """Adds the lattices of the words numbered next, made in runs: what a run holds besides them is bounded."""
        sizes = np.array([len(w) for w in words], np.int64)
        runs = np.cumsum(sizes) // LEARNT_CHARS
        bounds = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(words)]
        made = [self.made(words[a:b]) for a, b in itertools.pairwise(bounds)]
        edges = np.concatenate([x[0] for x in made])  # of each character
        self.first_char = np.concatenate([self.first_char, self.first_char[-1] + np.cumsum(sizes)])
        self.first_edge = np.concatenate([self.first_edge, self.first_edge[-1] + np.cumsum(edges, dtype=np.int64)])
        for k, name in enumerate(("cum", "log", "piece", "step"), 1):
            setattr(self, name, np.concatenate([getattr(self, name), *(x[k] for x in made)]))

    def made(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """How many edges each character of the words has, and their sums, logs, pieces and steps."""
        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        left = ends - np.arange(len(code))
        v = self.vocabulary
        at, key = np.arange(len(code)), np.zeros(len(code), np.uint64)
        starts, lengths, pieces, logs = [], [], [], []
        for n in range(1, v.longest + 1):
            inside = left[at] >= n
            at, key = at[inside], key[inside] * np.uint64(1000003) + code[at[inside] + (n - 1)] + np.uint64(1)
            slot = v.slot(key)
            alive = v.is_prefix[slot]
            at, key, slot = at[alive], key[alive], slot[alive]
            place = v.find(key, slot)
            hit = np.flatnonzero(place >= 0)
            starts.append(at[hit])
            lengths.append(np.full(len(hit), n))
            pieces.append(v.ids[place[hit]])
            logs.append(v.logs[place[hit]])
        # A character that is no piece is an edge of its bytes: one id, or, of several, minus the code point and one.
        known = np.zeros(len(code), bool)
        known[starts[0]] = True
        rest = np.flatnonzero(~known)
        width = 1 + (code[rest] > 0x7F).astype(int) + (code[rest] > 0x7FF) + (code[rest] > 0xFFFF)
        single = np.array([v.bytes[b] for b in range(128)])
        spelled = code[rest].astype(np.int64)
        starts.append(rest)
        lengths.append(np.ones(len(rest), np.int64))
        pieces.append(np.where(spelled < 128, single[np.minimum(spelled, 127)], -1 - spelled))
        logs.append(v.byte_log * width)
        # A character's edges side by side, the longest first: most draws end there.
        counted = np.zeros(len(code) + 1, np.int64)
        for chars in starts:
            counted[chars + 1] += 1
        first = np.cumsum(counted)
        start = np.repeat(np.arange(len(code)), counted[1:])
        free = first[:-1].copy()
        step, piece, log = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(len(start))
        for chars, n, ids, weights in reversed(list(zip(starts, lengths, pieces, logs, strict=True))):
            own = free[chars]
            step[own], piece[own], log[own] = n, ids, weights
            free[chars] += 1
        # Log mass of all ways from a character to its word's end, words side by side, from their ends backward.
        mass = np.zeros(len(code) + 1)
        longest = int(left.max(initial=0))
        by_left = np.argsort(left.astype(np.uint16) if longest < 1 << 16 else left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(1, longest + 2))
        through = np.zeros(len(start))
        word_end = ends[start] == start + step
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            chars = by_left[a:b]
            counts = first[chars + 1] - first[chars]
            offsets = np.cumsum(counts) - counts
            edges = np.repeat(first[chars] - offsets, counts) + np.arange(int(counts.sum()))
            value = log[edges] + np.where(word_end[edges], 0.0, mass[np.minimum(start[edges] + step[edges], len(code))])
            top = np.maximum.reduceat(value, offsets)
            mass[chars] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), offsets))
            through[edges] = value - np.repeat(mass[chars], counts)
        chance = np.exp(through)
        # Added up edge by edge, so that a word's sums are the same whatever words it is learnt with.
        cum, edges, last = chance.copy(), first[:-1] + 1, first[1:]
        while True:
            edges, last = edges[edges < last], last[edges < last]
            if not len(edges):
                break
            cum[edges] += cum[edges - 1]
            edges = edges + 1
        cum[first[1:] - 1] = 1.0
        return counted[1:].astype(np.int32), cum, through.astype(np.float32), piece.astype(np.int32), step.astype(np.uint8)

    def numbered(self, texts: list[list[str]]) -> np.ndarray:
        if self.first_char[-1] > HELD_CHARS:
            self.__init__(self.vocabulary)
        out = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        new = list(itertools.islice(self.number, len(self.first_char) - 1, None))
        if new:
            self.learn(new)
        return out

    def draw(self, words: np.ndarray, u: np.ndarray, with_pieces: bool = False):
        """For each word the path at its number u: log-probability, and where its share of [0, 1) begins and its width;
        with the pieces of all paths in one run and how many each has, if asked for."""
        n = len(words)
        log, low, width = np.zeros(n), np.zeros(n), np.ones(n)
        counts, found = np.zeros(n, np.int64), []
        active, begun = np.arange(n), False
        here, stop, r = self.first_char[words], self.first_char[words + 1], u
        while len(active):
            first = self.first_edge[here]
            edge = first.copy()
            over = np.flatnonzero(r >= self.cum[edge])
            while len(over):
                edge[over] += 1
                over = over[r[over] >= self.cum[edge[over]]]
            below = np.where(edge > first, self.cum[edge - 1], 0.0)
            share = self.cum[edge] - below
            if with_pieces:
                found.append((active, counts[active], self.piece[edge]))
            if not begun:  # nothing is used up
                log, low, width, begun = self.log[edge].astype(float), below, share, True
            else:
                log[active] += self.log[edge]
                open_ = width[active] > _FRESH
                low[active] += np.where(open_, width[active] * below, 0.0)
                width[active] *= np.where(open_, share, 1.0)
            counts[active] += 1
            here = here + self.step[edge]
            going = np.flatnonzero(here < stop)
            active, here, stop, below, share = active[going], here[going], stop[going], below[going], share[going]
            r = np.minimum((r[going] - below) / np.maximum(share, 1e-300), 1 - 2.0**-53)
            stale = np.flatnonzero(width[active] <= _FRESH)
            if len(stale):
                seed = u[active[stale]].view(np.uint64) ^ (counts[active[stale]].astype(np.uint64) << np.uint64(40))
                r[stale] = (_mixed(seed) >> np.uint64(11)).astype(float) * 2.0**-53
        if not with_pieces:
            return log, low, width
        offsets, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int64)
        for which, place, piece in found:
            out[offsets[which] + place] = piece
        return log, low, width, out, counts


_held: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    """One for each Python worker, kept from task to task."""
    if (path, alpha) not in _held:
        _held[path, alpha] = Lattices(Vocabulary(path, alpha))
    return _held[path, alpha]


def words_of(text: str | None) -> list[str]:
    """A text's words as the vocabulary has them: a space before the text, spaces marked. None for an empty text."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    if 2 * SPACE in marked:
        return WORDS.findall(marked)
    return list(filter(None, marked.replace(SPACE, " " + SPACE).replace("\n", " \n ").split(" ")))  # the same, sooner


class _Search:
    """A* for one text: its nodes, and the numbers of each popped path."""

    def __init__(self, key: int, n_words: int):
        self.rng = np.random.Generator(np.random.Philox(key=key))
        self.n, self.nodes, self.paths = n_words, [], []
        self.bound = float(-np.log(-np.log(self.rng.random() or 0.5)))

    def rest(self, path: int, log: np.ndarray, low: np.ndarray, width: np.ndarray, start: int, taken: list, most: int) -> None:
        """Adds the sets that a popped path leaves: other in word j, for j from ``start`` on. ``taken`` has the shares of
        [0, 1) that the set's word ``start`` has lost before."""
        n = len(log) - start
        draws = self.rng.random(n)
        for end in (min(NEAR, n), n):
            before = np.concatenate([[0.0], np.cumsum(log[: start + end])])
            gone = width[start : start + end].copy()
            if len(gone):
                gone[0] += sum(w for _, w in taken)
            with np.errstate(divide="ignore", over="ignore"):
                mass = before[start:-1] + np.log(np.where(gone < 1 - 1e-9, 1 - np.minimum(gone, 1.0), 0.0))
                mass += -np.log(-np.log(np.maximum(draws[:end], 1e-300)))
                bounds = -np.logaddexp(-self.bound, -mass)
            if np.count_nonzero(mass > before[-1] + MOST_NOISE) >= most:  # ``before`` never rises: no later word's set is better
                break
        best = np.argpartition(-bounds, most)[:most] if len(bounds) > most else np.arange(len(bounds))
        for j in best[np.isfinite(bounds[best])].tolist():
            shares = [(float(low[start + j]), float(width[start + j]))] + (taken if j == 0 else [])
            heapq.heappush(self.nodes, (-float(bounds[j]), len(self.nodes) + len(self.paths) * 1000, path, start + j, shares))


def _outside(v: float, shares: list[tuple[float, float]]) -> float:
    """The point of [0, 1) without the shares at distance v from 0."""
    for low, width in sorted(shares):
        if v < low:
            break
        v += width
    return min(v, 1 - 2.0**-53)


def sample(texts: list[str | None], keys: list[int], k: int, held: Lattices) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k different paths as (ids, log-probability, perturbed, inclusion), best first."""
    cut = [words_of(t) for t in texts]
    words, sizes = held.numbered(cut), np.array([len(c) for c in cut], np.int64)
    ends = np.cumsum(sizes)
    spans = [slice(e - s, e) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
    searches = [_Search(key, n) for key, n in zip(keys, sizes.tolist(), strict=True)]
    out: list[list] = [[] for _ in texts]
    u = np.concatenate([s.rng.random(s.n) for s in searches]) if texts else np.zeros(0)
    log, low, width, pieces, counts = held.draw(words, u, True)
    live = {}  # text: (its current path's arrays, where it left its parent, shares lost there)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    for i, (s, span) in enumerate(zip(searches, spans, strict=True)):
        if s.n:
            live[i] = (log[span], low[span], width[span], u[span], 0, [])
            out[i].append([pieces[offsets[span.start] : offsets[span.stop]], float(log[span].sum()), s.bound])
    for rank in range(1, k + 1):
        wanted = []
        for i, (log_i, low_i, width_i, u_i, start, taken) in live.items():
            s = searches[i]
            s.paths.append((log_i, low_i, width_i, u_i))
            s.rest(len(s.paths) - 1, log_i, low_i, width_i, start, taken, k + 1 - rank)
            if s.nodes:
                wanted.append(i)
        if rank == k:
            break
        live, jobs = {}, []
        for i in wanted:
            s = searches[i]
            negative, _, path, j, shares = heapq.heappop(s.nodes)
            s.bound = -negative
            log_p, low_p, width_p, u_p = s.paths[path]
            fresh = s.rng.random(s.n - j)
            fresh[0] = _outside(fresh[0] * max(0.0, 1 - sum(w for _, w in shares)), shares)
            jobs.append((i, j, np.concatenate([u_p[:j], fresh]), shares))
        if not jobs:
            break
        again = np.concatenate([words[spans[i]] for i, *_ in jobs])
        log, low, width, pieces, counts = held.draw(again, np.concatenate([x for _, _, x, _ in jobs]), True)
        offsets, at = np.concatenate([[0], np.cumsum(counts)]), 0
        for i, j, own, shares in jobs:
            span = slice(at, at + len(own))
            at += len(own)
            live[i] = (log[span], low[span], width[span], own, j, shares)
            out[i].append([pieces[offsets[span.start] : offsets[span.stop]], float(log[span].sum()), searches[i].bound])
    done = []
    for s, paths in zip(searches, out, strict=True):
        threshold = -s.nodes[0][0] if s.nodes else -np.inf
        done.append([(p, lp, g, 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(lp - threshold, 700.0))))) for p, lp, g in paths])
    return done


def with_bytes(pieces: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Ids with the byte edges spelled out."""
    if len(pieces) == 0 or pieces.min() >= 0:
        return pieces
    flat: list[int] = []
    for p in pieces.tolist():
        flat += [p] if p >= 0 else [vocabulary.bytes[b] for b in chr(-1 - p).encode("utf-8", "replace")]
    return np.array(flat, np.int64)


def _key(seed: int, doc_id: int | None) -> int:
    return (seed << 64) | ((doc_id or 0) & 0xFFFFFFFFFFFFFFFF)


_SAMPLE = "doc_id long, sample int, log_prob double, perturbed double, inclusion double"


def sample_pieces(docs: DataFrame, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, model: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, sample (from 1), log_prob, perturbed, inclusion and ids of up to k different segmentations of each text;
    with ``digest`` also n_ids, ids_crc32 (of 32-bit little-endian ids) and whether they decode to the text.

    ``inclusion`` is the chance that a path as likely is among the k, given the next best perturbed score; 1 if there
    is no other. A text with fewer segmentations has a row for each. Null and empty texts have one row: no ids,
    log_prob 0, inclusion 1. The draws depend on seed and doc_id alone: rows that share one, or have none, draw alike.
    The space sign of the vocabulary in a text reads as a space. Other columns are not read."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lattices(path, alpha)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows: list[list] = [[] for _ in range(9 if digest else 6)]
            found = sample(texts, [_key(seed, i) for i in ids], k, held)
            for doc_id, text, paths in zip(ids, texts, found, strict=True):
                for n, (pieces, log, perturbed, inclusion) in enumerate(paths or [(np.zeros(0, np.int64), 0.0, 0.0, 1.0)], 1):
                    pieces = with_bytes(pieces, held.vocabulary)
                    if digest:
                        same = held.vocabulary.decode(pieces) == (text or "").replace(SPACE, " ")
                        values = (doc_id, n, log, perturbed, inclusion, pieces.astype(np.int32), len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), same)
                    else:
                        values = (doc_id, n, log, perturbed, inclusion, pieces.astype(np.int32))
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), *([pa.int64(), pa.int64(), pa.bool_()] if digest else [])]
            names = ["doc_id", "sample", "log_prob", "perturbed", "inclusion", "ids", *(["n_ids", "ids_crc32", "decodes"] if digest else [])]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names)
        held.__init__(held.vocabulary)  # workers live on; what one task has learnt isn't carried into others' memory

    schema = f"{_SAMPLE}, ids array<int>" + (", n_ids long, ids_crc32 long, decodes boolean" if digest else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, ids: str = "ids", text: str = "text", model: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """The rows with the text that a column of ids stands for; null ids give null."""
    path = model or model_path()

    @F.pandas_udf("string")
    def read(column):
        vocabulary = lattices(path, alpha).vocabulary
        return column.map(lambda x: None if x is None else vocabulary.decode([int(i) for i in x]))

    return rows.withColumn(text, read(ids))


def op6_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op6_gumbel_pieces": op6_gumbel_pieces}

"""Conversation trie, shingle-set join and hard negatives against plain versions of them."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.conftest import SMALL
from tideboard.llm import bond, trie, vertical


def twin_rows(module, name, spark, table, df, got):
    con = duckdb.connect()
    con.register(table, df.toArrow())
    cursor = con.execute(module.TWINS[name])
    order = [[d[0] for d in cursor.description].index(c) for c in got.columns]
    return Counter(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_twins_on_conversations(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    got = trie.op11_prefix_trie(spark, SMALL)
    cursor = con.execute(trie.TWINS["op11_prefix_trie"])
    order = [[d[0] for d in cursor.description].index(c) for c in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[i] for i in order) for r in cursor.fetchall())


# --- trie

def test_every_key_has_a_slot_of_its_own():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 62, (n, 3)).astype(np.uint64), axis=0)
        nodes = trie.NodeTable(keys)
        assert sorted(nodes.slots(keys).tolist()) == list(range(len(keys)))
        assert (nodes.keys[nodes.slots(keys)] == keys).all()
        strange = rng.integers(0, 1 << 62, (500, 3)).astype(np.uint64)
        assert (nodes.slots(strange) == -1).all()  # no key of the table, whatever place it hashes to


def plain_trie(paths):
    """paths: {conv_id: [(key, n_bytes), ...]}."""
    members, own = {}, {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            node = tuple(t for t, _ in turns[:d])
            members.setdefault(node, []).append(c)
            own[node] = turns[d - 1][1] if d else 0
    out = []
    for node, who in members.items():
        below = [m for m in members if m[: len(node)] == node]
        inner = {m[:-1] for m in members if m}
        ends = sorted(c for c in who if len(paths[c]) == len(node))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(m) == len(node) + 1 for m in below),
            sum(m not in inner for m in below), sum((len(members[m]) - 1) * own[m] for m in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return Counter(out)


def conversations():
    """Turn numbers that are null or repeat, null roles and texts, repeated rows, long and negative ids, a hot opening."""
    rnd = random.Random(5)
    rows = []
    for c in [*range(60), -7, -5, 10**12, 10**12 + 1]:
        for t in range(rnd.randrange(1, 14)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]) if t > 3 else "user", "hello" if t < 3 else rnd.choice(["a", "é", "", None, "b" * 50])))
    rows += [(c, 0, "user", "alone") for c in range(201, 210)]  # without a first conversation of their family
    rows += [(3, None, "user", "x"), (3, None, "user", "y"), (4, 0, "user", "hello"), (None, 0, "user", "nobody"), (5, 1, None, None)]
    return rows


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:24]


def original(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), digest(role, text), len((text or "").encode())))
    return {c: [(d, n) for _, d, n in sorted(of)] for c, of in turns.items()}


@pytest.mark.parametrize(("block", "shard"), [(4096, 1 << 14), (3, 10), (1, 5), (4, 1)])
def test_trie_equals_a_plain_one(spark, block, shard):
    rows = conversations()
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, prefix string, depth int")
    got = trie.conversation_trie(df, block, shard)
    assert Counter(map(tuple, got.collect())) == plain_trie(original(rows))


def test_rebuilt_conversations(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = original(rows)
    paths = {}
    for c, own in before.items():
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = before.get(base, [])[:h] + own[h:]
    assert any(not p for p in paths.values())  # one without turns ends at the root
    got = trie.prefix_trie(*trie.rebuilt(trie.numbered_turns(df)))
    want = plain_trie(paths)
    assert Counter(map(tuple, got.collect())) == want
    assert twin_rows(trie, "op11_prefix_trie", spark, "conversations", df, got) == want


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(df).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x")], df.schema)
    assert trie.prefix_trie(*trie.rebuilt(trie.numbered_turns(nobody))).count() == 0


# --- shingle sets

def plain_sets(rows, words, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((doc_id, len(x), least.get(find(i)) if x else doc_id) for i, ((doc_id, _), x) in enumerate(zip(rows, sets, strict=True)))


def texts():
    """Copies with few and with many changes, copies of copies, texts that share a passage, short and odd ones."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))

    def changed(text, n):
        w = text.split()
        for _ in range(n):
            k = rnd.randrange(len(w))
            w[k : k + 1] = rnd.choice([[word()], [], [w[k], word()]])
        return " ".join(w)

    out = []
    for size in (60, 150):
        base = " ".join(word() for _ in range(size))
        cousin = changed(base, 2)
        out += [base, base, base.upper(), cousin]
        out += [changed(base, rnd.randrange(1, 7)) for _ in range(14)] + [changed(cousin, rnd.randrange(1, 4)) for _ in range(10)]
        out += [changed(out[-1], 1) for _ in range(3)]
    passage = " ".join(word() for _ in range(30))
    out += [f"{word()} {passage} {word()}" for _ in range(6)] + [f"{passage} {' '.join(word() for _ in range(n))}" for n in (3, 10, 40)]
    nine = " ".join(word() for _ in range(11))
    out += [nine, nine + " " + word(), nine + " " + word(), "one", "one", "one two", "", None, " \t\n", "x " * 30_000, "x " * 29_000]
    return [(i * 3 % 101, t) for i, t in enumerate(out)] + [(5, "one"), (None, out[0]), (None, "alone here now"), (7, None)]


@pytest.mark.parametrize(("words", "percent", "crowd"), [(3, 90, 64), (3, 90, 2), (3, 90, 4), (5, 80, 3), (2, 60, 3)])
def test_near_sets_equal_all_pairs(spark, words, percent, crowd):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, size int, set_id string")
    got = vertical.near_sets(df, words, percent, crowd).collect()
    assert Counter(map(tuple, got)) == plain_sets(rows, words, percent)


def test_near_sets_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert vertical.near_sets(docs).count() == 0


def test_partial_overlaps_add_up(spark):
    """Each fragment holds a part of every set, and the parts of a pair sum to the whole overlap."""
    rows = [(i, t) for i, t in texts() if t][:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = vertical.shingle_counts(vertical.read_sets(docs, 3).cache())
    ends = vertical.fragment_ends(counts)
    sent = spark.sparkContext.broadcast(counts.astype(np.uint32))
    every = spark.sparkContext.broadcast(np.full(vertical.MARKS // 32, (1 << 32) - 1, np.uint32))
    cut = vertical.segments(docs, 3, sent, ends, every).dropDuplicates(["set_id", "fragment"]).cache()
    sets = {}
    for r in cut.collect():
        sets.setdefault(r["set_id"], []).extend(r["shingles"])
    assert cut.count() == vertical.FRAGMENTS * len(sets)
    ids = sorted(sets)
    pairs = spark.createDataFrame([(a, b) for a in ids[:20] for b in ids if b < a], f"a {vertical.KEY}, b {vertical.KEY}")
    for r in vertical.overlaps(pairs, cut).collect():
        assert r["overlap"] == len(set(sets[r["a"]]) & set(sets[r["b"]]))


def test_a_set_in_many_tasks_is_cut_once(spark):
    """Copies of a text, one of them without an id, over many partitions: the marked one alone is cut."""
    rows = [(i, "five words of one text") for i in range(40)] + [(None, "five words of one text"), (None, "only a text without id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    counts = vertical.shingle_counts(vertical.read_sets(docs, 3))
    chosen = spark.createDataFrame([(0,), (None,)], "doc_id long")
    sent = [spark.sparkContext.broadcast(x) for x in (counts.astype(np.uint32), vertical.marks(chosen.limit(1)), vertical.marks(chosen))]
    one = vertical.segments(docs, 3, sent[0], vertical.fragment_ends(counts), sent[1])
    assert one.count() == vertical.FRAGMENTS
    both = vertical.segments(docs, 3, sent[0], vertical.fragment_ends(counts), sent[2])
    assert both.select("set_id").distinct().count() == 2


# --- hard negatives

def vectors():
    """Ties, copies, repeated ids and rows, nulls, strange components, other lengths, numbers too large for doubles."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        rows.append((i, int(rng.integers(0, 4)), [float(v) for v in rng.normal(size=6)]))
    hot = [0.5, -0.25, 1.0, 0.0, 0.125, 2.0]
    rows += [(i, i % 3, hot) for i in range(400, 520)]
    rows += [(50, 1, hot), (50, 1, hot), (100, 2, [1.0] * 6), (7, 3, None), (8, None, hot), (None, 1, hot), (9, 1, [1.0, None] * 3)]
    rows += [(10, 1, [float("nan")] + hot[1:]), (11, 1, [float("inf")] + hot[1:]), (600, 1, [1.0, 2.0]), (650, 1, [2.0, 1.0]), (651, 2, [1.0, 1.0])]
    rows += [(700, 1, []), (701, 1, []), (702, 2, []), (750, 2, [3e9] * 3), (751, 2, [3e9, 2e9, 1e9]), (752, 1, [1e9, 2e9, 3e9]), (753, 1, [2e9 + 1] * 3)]
    return rows


def plain_negatives(rows, every, positives, negatives):
    kept = {}
    for i, label, x in rows:
        if None not in (i, label, x) and all(v is not None and np.isfinite(v) for v in x):
            kept[i, label, tuple(int(np.floor(256 * v)) for v in x)] = None
    out = Counter()
    for i, label, x in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, m) for j, m, y in kept if len(y) == len(x))
        for s, p, _ in [r for r in scored if r[2] == label and r[1] != i][:positives]:
            inside = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out.update((i, p, k + 1, j, -s, -n) for k, (n, j, _) in enumerate(inside))
    return out


def test_hard_negatives_equal_all_scores(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(*r, "e", 0) for r in rows], "vec_id long, label int, embedding array<double>, rank string, score int")
    want = plain_negatives(rows, 50, 5, 3)
    assert want
    assert Counter(map(tuple, bond.hard_negatives(df).collect())) == want
    monkeypatch.setattr(bond, "BLOCKS", 1)  # of the driver: more tasks
    found = bond.hard_negatives(df, every=20, positives=2, negatives=4).collect()
    assert Counter(map(tuple, found)) == plain_negatives(rows, 20, 2, 4)


def test_scan_reads_fewer_values_than_there_are():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(64, 4000)) * np.linspace(3, 0.05, 64)[:, None])
    block = bond.Block(64, np.arange(4000).tobytes(), np.zeros(4000, np.int64).tobytes(), b"f" + x.tobytes())
    q = x[:, 17]
    got = bond.best_of_label([block], 17, 0, q, 5)
    scores = (q @ x).astype(int)
    assert got == sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != 17)[:5]
    assert block.read < 0.7 * x.size


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert bond.hard_negatives(df).count() == 0

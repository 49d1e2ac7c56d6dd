"""Operators on other tables, SQL twins, and the pipeline."""

import itertools
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tideboard import llm
from tideboard.llm import chroma, mtree, slots, urls
from tideboard.llm.common import table


@pytest.mark.parametrize("name", list(llm.twins()))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = llm.queries()[name](spark, SMALL)
    cursor = con.execute(llm.twins()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in order) for r in cursor.fetchall())


# --- URLs

def test_viterbi_equals_all_cuts():
    counts = {"free": 9, "bets": 5, "be": 7, "ts": 3, "fre": 2, "ee": 4}
    total = sum(counts.values())

    def cost(piece):
        return math.log((total + 1) / counts[piece]) if piece in counts else math.log((total + 1) * 10) if len(piece) == 1 else math.inf

    for label in ("freebets", "betsfree", "xfreey", "eebe", "q"):
        cuts = []
        for marks in itertools.product((0, 1), repeat=len(label) - 1):
            at = [0, *(k + 1 for k, m in enumerate(marks) if m), len(label)]
            cuts.append([label[a:b] for a, b in itertools.pairwise(at)])
        best = min(sum(map(cost, c)) for c in cuts)
        got = urls.viterbi(label, list(counts), list(counts.values()), total)
        assert "".join(got) == label
        spelled = [p for w in got for p in ([w] if w in counts else list(w))]
        assert sum(map(cost, spelled)) == pytest.approx(best)


PAGES = [
    (1, "https://A.Example.NET/en/5?x#y"), (2, "http://example.com/de/x"), (3, "ftp://freebets.example.org?q=/fr/"), (4, None), (5, "no scheme"),
    (6, "http://x.org/fr/1"), (7, "http://notexample.net/en/"), (8, "HTTP://cheappills.example.org/a/b.html"), (8, "HTTP://cheappills.example.org/a/b.html"),
    (None, "a://b://c/d"), (9, "http://goodnews.example.org/news"), (10, "http://" + "x" * 70 + ".org/"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in PAGES], "page_id long, url string, host string, verdict string")
    corpus = spark.createDataFrame([("<p>cheap pills free bets good news</p>",), (None,), ("",)], "text string")
    rows = urls.judge_urls(pages, corpus).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(i for i, _ in PAGES)
    of = {r["page_id"]: r for r in rows}
    assert [(of[k]["host"], of[k]["path"], of[k]["rule"], of[k]["verdict"]) for k in (1, 2, 6, 7)] == [
        ("a.example.net", "/en/5", "example.net/en/", "allow"), ("example.com", "/de/x", "example.com/de/", "block"),
        ("x.org", "/fr/1", "org/fr/", "allow"), ("notexample.net", "/en/", "net/", "block"),
    ]
    assert (of[3]["host"], of[3]["path"], of[3]["verdict"]) == ("freebets.example.org", "", "block")
    assert (of[4]["host"], of[5]["host"], of[None]["host"]) == ("", "", "b:")
    assert of[8]["words"] == ["cheap", "pills", "example", "org"] and of[8]["verdict"] == "block"
    assert of[9]["words"] == ["good", "news", "example", "org"] and of[9]["verdict"] == "allow"
    tokens = {True: Counter(), False: Counter()}
    path_words = {1: ["/en", "/0"], 2: ["/de", "/x"], 6: ["/fr", "/0"], 7: ["/en"], 8: ["/a", "/b", "/html"], None: ["/c", "/d"], 9: ["/news"]}
    for r in rows:
        tokens[bool(set(r["words"]) & set(urls.Seeds().words))].update([*r["words"], *path_words.get(r["page_id"], [])])
    classes = Counter(bool(set(r["words"]) & set(urls.Seeds().words)) for r in rows)
    whole = {y: sum(c.values()) + urls.SMOOTHING * urls.BUCKETS for y, c in tokens.items()}
    for r in rows:
        words = [*r["words"], *path_words.get(r["page_id"], [])]
        plain = math.log((classes[True] + 1) / (classes[False] + 1))
        plain += sum(math.log((tokens[True][w] + urls.SMOOTHING) / whole[True] / ((tokens[False][w] + urls.SMOOTHING) / whole[False])) for w in words)
        assert r["score"] == pytest.approx(plain, abs=1e-5)
    assert urls.judge_urls(pages.limit(0), corpus.limit(0)).count() == 0


# --- M-trees

def test_mtree_on_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(0, 400, 4)]
    rows += [(1, None), (3, [1.0, None, 2.0]), (5, [float("nan"), 0.0, 0.0]), (7, []), (100, [1.0, 2.0]), (9, [2.0, 3.0]), (None, [1.0, 1.0, 1.0]), (8, rows[2][1]), (8, rows[2][1]), (11, [float("inf")] * 3)]
    rows += [(1000 + k, [0.5, 0.5, 0.5]) for k in range(50)]  # ties
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault((i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)), None)
    want = []
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        best = {}
        for (i, x), (j, y) in itertools.product(good, good):
            if i == q and j != q and len(x) == len(y):
                best[j] = max(best.get(j, -math.inf), sum(a * b for a, b in zip(x, y, strict=True)))
        want += [(q, n, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:10], 1)]
    assert sorted(map(tuple, mtree.top_k(df).collect())) == sorted(want)
    assert mtree.top_k(df.limit(0)).count() == 0


def test_bounds_save_work():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 5, (500, 8)) for c in rng.normal(0, 300, (8, 8))]).astype(int)
    made = mtree.build_tree(np.arange(len(x)), x.astype(float))
    row = {"dim": 8} | {k: (v.astype(np.int64) if k in ("ids", "vectors", "starts", "ends", "parents") else v).tobytes() for k, v in made.items()}
    tree = mtree.Tree(row)
    got = tree.search(-1, x[0], 10)
    assert [s for s, _ in got] == sorted((x @ x[0]).tolist(), reverse=True)[:10]
    assert tree.looked < len(x) / 2


# --- slots

def test_slots(spark):
    rows = [(i, "t" * (i % 90)) for i in range(3000)] + [(None, "n")] * 3 + [(5, "t" * 5), (3000, None), (3001, "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, slot int, shard int")
    got = slots.shard_documents(docs, 8, 512).collect()
    assert len(got) == len(rows)
    places, loads = {}, Counter()
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())
    assert {r["size"] for r in got if r["doc_id"] == 3000} == {16}
    assert slots.shard_documents(docs.limit(0)).count() == 0


def test_maps_are_edited(spark, tmp_path):
    sizes = list(range(1, 201))
    first = slots.fit_map(sizes, 4)
    grown = slots.rebalance(first, sizes, 5)
    moved = [s for s in range(200) if first.shards[s] != grown.shards[s]]
    assert grown.version == 2 and {grown.shards[s] for s in moved} == {4} and len(moved) < 80
    loads = grown.loads(sizes)
    assert max(loads) <= 1.03 * sum(sizes) / 5
    path = f"file://{tmp_path}/map"
    for m in (first, grown):
        spark.createDataFrame(slots.map_rows(m, sizes, [1] * 200), slots.MAP_SCHEMA).write.mode("append").parquet(path)
    assert slots.load_map(spark, path) == grown and slots.load_map(spark, path, 1) == first
    with pytest.raises(ValueError):
        slots.rebalance(grown, sizes, 3)


def test_documents_are_sharded_again(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    docs = spark.createDataFrame([(i, "t" * (i % 90)) for i in range(4000)], "doc_id long, text string")
    first = {r["doc_id"]: r for r in slots.shard_documents(docs.filter("doc_id < 2000"), 8, 512, path).collect()}
    rows = slots.shard_documents(docs, 10, 512, path).collect()
    again = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(again) == 4000 and {r["map_version"] for r in rows} == {2}
    places, loads = {}, Counter()
    for r in rows:
        places.setdefault(r["shard"], []).append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert len(places) == 10 and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) < 1.1 * sum(loads.values()) / 10
    stayed = sum(first[i]["shard"] == again[i]["shard"] for i in first)
    assert stayed > 0.6 * len(first)
    assert slots.load_map(spark, path).version == 2 and slots.load_map(spark, path, 1).n_shards == 8
    with pytest.raises(ValueError):
        slots.shard_documents(docs, 10, 256, path)


# --- chroma

def tune(seed, n=64):
    return chroma.notes_to_pcm(np.random.default_rng(seed).integers(0, 25, n).astype(float))


def test_excerpts_are_aligned():
    whole = tune(1)
    rng = np.random.default_rng(5)
    part = whole[10 * chroma.HOP :]
    noisy = (0.5 * part + rng.normal(0, 120, len(part))).astype(np.float32) / 32768
    a, b = chroma.fingerprint(whole.astype(np.float32) / 32768), chroma.fingerprint(noisy)
    found = chroma.align(a, b)
    assert found.offset == 10 and found.errors < 0.1
    other = chroma.align(a, chroma.fingerprint(tune(2).astype(np.float32) / 32768))
    assert other is None or other.hits < chroma.LEAST_HITS or other.errors > chroma.MOST_ERRORS


def test_recordings(spark):
    whole = tune(1)
    loud = (whole // 2).astype("<i2")
    rows = [(0, whole.tobytes()), (7, whole.tobytes()), (7, whole.tobytes()), (9, whole[6 * chroma.HOP :].tobytes()), (11, loud.tobytes()), (12, tune(2).tobytes()), (13, None), (14, b""), (15, b"x" * 101), (None, tune(3).tobytes())]
    df = spark.createDataFrame([(i, p, 1) for i, p in rows], "rec_id long, pcm binary, class_id int")
    got = chroma.search_recordings(df).collect()
    members = [(r["rec_id"], r["class_id"]) for r in got if r["kind"] == "member"]
    assert len(members) == len(rows) and (7, 0) in members and (13, None) in members and (15, None) in members
    found = {(r["rec_id"], r["class_id"]): r["offset"] for r in got if r["kind"] == "match"}
    assert found[0, 9] == 6 and 12 not in {b for _, b in found}
    assert chroma.search_recordings(df.limit(0)).count() == 0


def test_shared_passages_are_found(spark):
    """Beginnings, middles and two passages at one offset, with other sound around them."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 25, 90).astype(float)

    def other(n):
        return rng.integers(0, 25, n).astype(float)

    shared = {
        1: (0, np.concatenate([base[:24], other(40)])),
        2: (20, np.concatenate([other(15), base[20:50], other(20)])),
        3: (0, np.concatenate([base[:30], other(30), base[60:]])),
    }
    rows = [(0, chroma.notes_to_pcm(base).tobytes())] + [(i, chroma.notes_to_pcm(x).tobytes()) for i, (_, x) in shared.items()]
    rows += [(i, chroma.notes_to_pcm(other(90)).tobytes()) for i in range(4, 8)]
    got = chroma.search_recordings(spark.createDataFrame(rows, "rec_id long, pcm binary")).filter("kind = 'match'").collect()
    found = {}
    for r in got:
        found.setdefault(r["class_id"], []).append((r["offset"], r["run_start"], r["run_end"]))
        assert r["overlap"] == r["run_end"] - r["run_start"] and r["bit_errors"] <= chroma.MOST_ERRORS
    assert any(o == 0 and a == 0 and b >= 8 for o, a, b in found[1])
    assert any(o == 5 and a <= 20 and b >= 34 for o, a, b in found[2])
    assert any(o == 0 and a == 0 and 14 <= b < 60 for o, a, b in found[3])
    assert any(o == 0 and 30 < a <= 60 and b >= 74 for o, a, b in found[3])
    assert set(found) == {1, 2, 3}


# --- pipeline

def test_pipeline_keeps_what_its_stages_keep(spark):
    from tests.llm.test_joins import plain_sets
    from tideboard.llm import fm, kneser, pieces, raking

    docs = table(spark, SMALL, "documents").cache()
    labels = table(spark, SMALL, "labels")
    scores = {r["doc_id"]: r["score"] for r in fm.score_documents(docs, fm.train(docs, labels)).collect()}
    left = docs.filter(docs.doc_id.isin([i for i, s in scores.items() if s >= 0.5])).cache()
    scores = {r["doc_id"]: r["score"] for r in kneser.score_documents(left, kneser.train(left, labels)).collect()}
    left = left.filter(left.doc_id.isin([i for i, s in scores.items() if s < 0.5])).cache()
    # The stage's rule is five words and a similarity of 0.8; texts without words are copies of each other.
    texts = [(r["doc_id"], r["text"]) for r in left.collect()]
    named = {least for _, n, least in plain_sets(texts, 5, 80) if n} | {min((i for i, n, _ in plain_sets(texts, 5, 80) if not n), default=-1)}
    left = left.filter(left.doc_id.isin(list(named))).cache()
    kept = [r["doc_id"] for r in raking.mix_documents(left).collect() if r["kept"]]
    want = pieces.sample_pieces(left.filter(left.doc_id.isin(kept))).collect()
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0

"""Operators on texts: planes, pieces, SimHash, classifier, language models."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.conftest import SMALL
from tideboard.llm import copies, fm, kneser, pieces, planes, raking, simhash
from tideboard.llm.common import table

LONG = "wordy " * 60_000
ODD = [(None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same text here now"), (6, "same text here now"), (6, "same text here now"), (7, "naïve 日本 ▁ \x00 end")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, component_id string, kept string, slot string, topic string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, "src0", None if t is None else len(t), 9, 0.1, "x", "y", "z", "w") for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


# --- planes

@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (planes.join_planes(planes.split_planes(ids, mode), n, mode) == ids).all()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_written_ids_are_the_tokenizers(spark, odd, mode, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(planes.tokenizer_path())
    path = f"file://{tmp_path}/planes"
    planes.write_planes(odd, path, mode=mode, block_ids=64)
    want, start = [], 0
    for doc_id, text in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, planes.read_digests(spark, path).collect()), key=key) == want
    got = Counter((r["doc_id"], len(r["ids"])) for r in planes.read_documents(spark, path).collect())
    assert got == Counter((r[0], r[2]) for r in want)


def test_planes_of_an_empty_table(spark, none, tmp_path):
    planes.write_planes(none, f"file://{tmp_path}/planes")
    assert planes.read_digests(spark, f"file://{tmp_path}/planes").count() == 0


def test_encoder_on_awkward_texts():
    own = planes.Encoder(planes.tokenizer_path())
    texts = ["", "a  b   c\n\n d's 'S it's  ", "<|endoftext|> x", "  \t\n ", "naïve café ß 日本語 \u3000x", "\x1c\x1d a", "1²③ ½ ٣٤", "'re're 'LL", "x_y__z"]
    assert own.many(texts) == [own.whole(t) for t in texts]


def test_encoder_asks_for_each_piece_once_and_for_no_offsets():
    own = planes.Encoder(planes.tokenizer_path())
    texts = ["one two, two  three\n\nétude étude ´s it's", "", "two one", "three 'S 12 12"]
    expected, asked, tokenizer = [own.whole(t) for t in texts], [], own.tokenizer

    class Fast:
        def encode_batch_fast(self, runs, add_special_tokens):
            asked.extend(runs)
            return tokenizer.encode_batch_fast(runs, add_special_tokens=add_special_tokens)

    own.tokenizer = Fast()
    assert own.many(texts) == expected
    assert len(set(asked)) == len(asked) == 1 + len([p for p in own.number if not (p[0] == " " and p[1:].isalpha())])
    asked.clear()
    assert own.many(texts[::-1]) == expected[::-1] and asked == []


def test_encoder_keeps_the_pieces_that_it_meets_again(monkeypatch):
    monkeypatch.setattr(planes, "HELD_PIECES", 8)
    own = planes.Encoder(planes.tokenizer_path())
    for texts in (["one two three two one", "étude four, four"], ["five two six", "one"], [f"w{k} x{k}" for k in range(9)], ["one two"]):
        assert own.many(texts) == [own.whole(t) for t in texts]
    own = planes.Encoder(planes.tokenizer_path())
    own.many(["one two three two one", "étude four, four five six seven"])
    own.many([" two"])
    assert " two" in own.number and " three" not in own.number and len(own.number) < 8


# --- SimHash

def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """doc_id of each row to the least doc_id reachable, over all pairs."""
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, fp, least.get(find(k))) for k, (i, fp) in enumerate(prints))


def found_components(df, crowd=simhash.CROWD):
    return Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df, crowd).collect())


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_simhash_equals_all_pairs(spark, docs, crowd):
    base = [r for r in docs.limit(40).collect()]
    rows = [(r["doc_id"], r["text"]) for r in base]
    for k, r in enumerate(base[:12]):  # chains of small changes
        words = r["text"].split(" ")
        for step in range(4):
            words = words[:-1] + [f"x{step}"] if step % 2 else [*words, "tail"]
            rows.append((1000 + 10 * k + step, " ".join(words)))
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string"), crowd) == plain_components(rows)


def test_simhash_of_odd_rows(odd, none):
    assert found_components(odd) == plain_components(ODD)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 4, 5, 7]
    assert kept.filter("doc_id is null").count() == 1


def test_links_lose_nothing_in_crowds(spark):
    rng = np.random.default_rng(3)
    fps = {0}
    while len(fps) < 300:
        fps.add(int(sum(1 << int(b) for b in rng.integers(0, 64, 2))) | (1 << 63 if rng.random() < 0.2 else 0))
    signed = [(f if f < 1 << 63 else f - (1 << 64),) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {crowd: {r["node"]: r["root"] for r in simhash.components(simhash.links(df, crowd)).collect()} for crowd in (10, 10_000)}
    assert roots[10] == roots[10_000]


# --- near copies

def plain_copies(rows):
    """doc_id to the least reachable over pairs of similarity 0.8, over all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}


def test_edited_copies_are_found(spark):
    rng = np.random.default_rng(8)
    line = " ".join(f"common{k}" for k in range(12))
    rows = [(0, ""), (1, None), (2, "short"), (3, "Short")]
    for k in range(30):
        words = [*line.split(), *(f"w{x}" for x in rng.integers(0, 400, rng.integers(30, 200)))]
        rows.append((100 + 20 * k, " ".join(words)))
        for step in range(1, 8):  # edited one by one, some past the bound, some from the copy before
            if step % 3 == 0:
                words = rows[-1][1].split()
            changed = list(words)
            for at in rng.integers(0, len(words), step):
                changed[at] = f"x{rng.integers(0, 1000)}"
            rows.append((100 + 20 * k + step, " ".join(changed)))
    found = {r["doc_id"]: r["component_id"] for r in copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = plain_copies(rows)
    assert found == want and 30 < len(set(want.values())) < 200


def test_stage_drops_edited_copies(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    edited = [*words[:50], "one", *words[51:120], "two", *words[121:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "another text")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()} == {1, 3}
    assert copies.near_copies(docs.limit(0)).count() == 0


def test_stage_compares_what_fingerprints_link_first(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(20):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:-1])), (10 * k + 2, " ".join(words[:-2]))]
    sets = copies.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    prints = {r["set_id"]: r["fp"] % (1 << 64) for r in sets.collect()}
    got = {(r["a"], r["b"]) for r in copies.print_pairs(sets).collect()}
    assert got and all(a > b and (prints[a] ^ prints[b]).bit_count() <= 2 for a, b in got)
    roots = {r["node"]: r["root"] for r in simhash.components(copies.print_pairs(sets)).collect()}
    near = [(a, b) for a in prints for b in prints if a > b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert all(roots.get(a, a) == roots.get(b, b) for a, b in near)
    pairs = spark.createDataFrame(near, "a long, b long")
    assert copies.apart(pairs, simhash.components(pairs)).count() == 0
    other = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert copies.apart(other, spark.createDataFrame([(3, 9), (4, 9)], "node long, root long")).collect() == [(1, 2)]


# --- factorisation machine

def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(0)
    size = fm.BUCKETS + len(fm.STATISTICS)
    machine = fm.Machine(0.3, rng.normal(size=size).astype(np.float32), rng.normal(size=(size, fm.RANK)).astype(np.float32), np.zeros(len(fm.STATISTICS)), np.ones(len(fm.STATISTICS)))
    found = [fm.features("A few words, a few || words!!", 20.0), fm.features("", None)]
    at, x, starts = machine.rows(found)
    got = machine.margin(at, x, starts)[0]
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(at)], strict=True)):
        ids, values = at[a:b], x[a:b]
        plain = 0.3 + float((machine.weights[ids] * values).sum())
        plain += sum(float(machine.vectors[i] @ machine.vectors[j]) * values[p] * values[q] for p, i in enumerate(ids) for q, j in enumerate(ids) if p < q)
        assert got[k] == pytest.approx(plain, rel=1e-3, abs=1e-3)


def accuracy(spark, sf_dir, scored, label, held_out):
    labels = {r["doc_id"]: r[label] for r in table(spark, sf_dir, "labels").collect()}
    rows = [(labels[r["doc_id"]], r["score"] >= 0.5) for r in scored.collect() if r["doc_id"] in labels and held_out(r["doc_id"])]
    return {y: np.mean([p == bool(y) for v, p in rows if v == y]) for y in (0, 1)}


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = table(spark, sf_dir, "documents")
    got = accuracy(spark, sf_dir, fm.score_documents(docs, fm.train(docs, table(spark, sf_dir, "labels"))), "quality", lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert got[0] > 0.97 and got[1] > 0.99


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = table(spark, sf_dir, "documents")
    got = accuracy(spark, sf_dir, kneser.score_documents(docs, kneser.train(docs, table(spark, sf_dir, "labels"))), "toxic", lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[0] > 0.99 and got[1] > 0.85


@pytest.mark.parametrize("module, keep", [(fm, "keep_good"), (kneser, "keep_ordinary")])
def test_classifiers_on_odd_rows(spark, odd, none, module, keep):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, None, None), (None, 1, 1), (4, 1, 0), (5, 0, 1), (9, 7, 7)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = module.train(odd, given)
        scores = module.score_documents(odd, model).collect()
        assert sorted(str(r["doc_id"]) for r in scores) == sorted(str(i) for i, _ in ODD)
        assert all(0 <= r["score"] <= 1 for r in scores)
        kept = getattr(module, keep)(odd, model)
        assert kept.columns == odd.columns and kept.count() <= len(ODD)
        assert module.score_documents(none, model).count() == 0


def test_ratios_by_hand():
    """Counts beyond the discount are kept, the rest is split as the prior says."""
    pairs = kneser.distinct_pairs(*kneser.numbered(["a b a b", "", None, "b"]))
    assert [len(p) for p in pairs] == [3, 0, 0, 1]


def plain_parts(texts, toxic):
    """Parts of pairs, words and stems by dictionaries, all of them."""
    counts = [[Counter(), Counter()] for _ in range(3)]
    for text, y in zip(texts, toxic, strict=True):
        for order, found in enumerate(plain_expressions(text)):
            counts[order][y].update(set(found))
    kept = {x for x in {*counts[2][0], *counts[2][1]} if counts[2][0][x] + counts[2][1][x] >= kneser.PAIR_CUT}
    counts[2] = [Counter({x: n for x, n in c.items() if x in kept}) for c in counts[2]]
    odds = [math.log((sum(c[1].values()) + 1) / (sum(c[0].values()) + 1)) for c in counts]

    def topped(order, x, prior):
        n0, n1 = counts[order][0][x], counts[order][1][x]
        share, n = 1 / (1 + math.exp(-prior)), n0 + n1
        beyond = n1 - n * share
        part = math.copysign(max(0, abs(beyond) - kneser.DISCOUNT * math.sqrt(n * share + 1)), beyond)
        most = min(max(n * share + part, 0), n)
        return math.log((most + kneser.SHARED * share) / (n - most + kneser.SHARED * (1 - share)))

    ratio = {}
    for order in range(3):
        for x in {*counts[order][0], *counts[order][1]}:
            given = ratio.get((1, x[0]), 0.0) if order == 2 else 0.0
            lower = ratio[order - 1, x[1] if order == 2 else x[:5]] if order else 0.0
            ratio[order, x] = topped(order, x, lower + given + odds[order]) - given - odds[order]
    return ratio


def plain_expressions(text):
    words = text.split()
    pairs = set(zip(["", *words], words, strict=False))
    return [x[1][:5] for x in pairs], [x[1] for x in pairs], list(pairs)


def plain_evidence(text, ratio):
    got = [next((ratio[o, x] for o, x in ((2, pair), (1, pair[1]), (0, pair[1][:5])) if (o, x) in ratio), 0.0) for pair in plain_expressions(text)[2]]
    return sum(got) / max(1, len(got))


@pytest.mark.parametrize("hot", [kneser.HOT_PARTS, 3, 0])
def test_evidence_equals_plain_models(spark, hot):
    """Whether its part travels or is joined, no expression is lost."""
    rng = np.random.default_rng(4)
    marked = [["bad phrase here", "sour", "gloom"], ["fine phrase there", "sweet", "bright"]]
    texts, toxic = [], []
    for i in range(1500):
        y = int(rng.random() < 0.3)
        words = [f"w{k}" for k in rng.integers(0, 300, 12)] + [marked[1 - y][k] for k in rng.integers(0, 3, 2)]
        rng.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = kneser.train(docs, labels, hot=hot)
    assert (model.others.count() > 0) == (hot < 100)
    counted = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 > 1]
    ratio = plain_parts([texts[i] for i in counted], [toxic[i] for i in counted])
    got = {r["doc_id"]: r["a"] for r in kneser.evidence(docs, model, ["doc_id"]).collect()}
    assert got == pytest.approx({i: plain_evidence(t, ratio) for i, t in enumerate(texts)}, abs=1e-9)
    scores = {r["doc_id"]: r["score"] for r in kneser.score_documents(docs, model).collect()}
    assert {r["doc_id"] for r in kneser.keep_ordinary(docs, model).collect()} == {i for i, x in scores.items() if x < 0.5}


def test_words_share_no_part(spark):
    """The two words had one 32-bit number, and so one slot, before."""
    texts = [("nykpnlqn", "mrqepvcu")[i % 2] for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(600)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in kneser.score_documents(docs, kneser.train(docs, labels)).collect()}
    assert all(x > 0.9 if i % 2 == 0 else x < 0.1 for i, x in scores.items())


# --- pieces

def segmentations(word, v):
    if not word:
        return [((), 0.0)]
    out = []
    for n in range(1, min(len(word), v.longest) + 1):
        at = np.searchsorted(v.keys, np.uint64(v.key(word[:n])))
        if at < len(v.keys) and int(v.keys[at]) == v.key(word[:n]):
            out += [((int(v.ids[at]), *rest), float(v.logs[at]) + p) for rest, p in segmentations(word[n:], v)]
        elif n == 1:
            raw = word[0].encode()
            out += [((*(v.bytes[b] for b in raw), *rest), v.byte_log * len(raw) + p) for rest, p in segmentations(word[1:], v)]
    return out


def test_samples_follow_their_probabilities():
    held = pieces.Lattices(pieces.Vocabulary(pieces.model_path(), 0.2))
    ways = [((), 0.0)]
    for word in pieces.words_of("th e"):
        ways = [(a + b, p + q) for a, p in ways for b, q in segmentations(word, held.vocabulary)]
    whole = np.logaddexp.reduce([p for _, p in ways])
    chance = {a: math.exp(p - whole) for a, p in ways}
    n, first, either = 3000, Counter(), Counter()
    for paths in pieces.sample(["th e"] * n, [pieces._key(1, i) for i in range(n)], 2, held):
        ids = [tuple(p[0].tolist()) for p in paths]
        assert len(set(ids)) == 2 and paths[0][2] >= paths[1][2]
        for way, p in zip(ids, paths, strict=True):
            assert math.exp(p[1]) == pytest.approx(chance[way], rel=1e-5)
            assert 0 < p[3] <= 1
        first[ids[0]] += 1
        either.update(ids)
    for way, p in chance.items():
        both = p + sum(q * p / (1 - q) for other, q in chance.items() if other != way)
        assert first[way] / n == pytest.approx(p, abs=0.04)
        assert either[way] / n == pytest.approx(both, abs=0.04)


def test_fewer_segmentations_than_asked():
    held = pieces.Lattices(pieces.Vocabulary(pieces.model_path(), 0.5))
    ways = segmentations(pieces.words_of("ab")[0], held.vocabulary)
    (paths,) = pieces.sample(["ab"], [pieces._key(1, 1)], 10, held)
    assert len(paths) == len(ways) and {p[3] for p in paths} == {1.0}


def test_pieces_of_odd_rows(odd, none):
    rows = pieces.sample_pieces(odd, 2).collect()
    again = pieces.sample_pieces(odd.repartition(1), 2).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    texts = pieces.decode_pieces(pieces.sample_pieces(odd, 2)).collect()
    want = {(i, (t or "").replace("▁", " ")) for i, t in ODD}
    assert {(r["doc_id"], r["text"]) for r in texts} == want
    assert all(r["decodes"] for r in pieces.sample_pieces(odd, 2, digest=True).collect())
    assert pieces.sample_pieces(none).count() == 0


# --- mixture

def test_raked_totals_meet_the_targets():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, (4, 3, 2)).astype(float)
    targets = [np.array(t) for t in ([0.1, 0.2, 0.3, 0.4], [0.5, 0.3, 0.2], [0.6, 0.4])]
    fitted = raking.rake(counts, targets, 50)
    for axis, target in enumerate(targets):
        held = fitted.sum(axis=tuple(k for k in range(3) if k != axis)) / fitted.sum()
        assert held == pytest.approx(target, abs=1e-6)
    chance = raking.probabilities(counts, fitted, 0.3)
    assert (chance * counts).sum() == pytest.approx(0.3 * counts.sum()) and chance.max() <= 1


def test_mixture_of_odd_rows(odd, none):
    rows = raking.mix_documents(odd).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r["probability"] <= 1 and not (r["n_tokens"] == 0 and r["kept"] and r["probability"] == 0) for r in rows)
    kept = raking.sample_documents(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])
    assert raking.mix_documents(none).count() == 0 and raking.sample_documents(none).count() == 0


def test_few_words_are_held_while_texts_are_scored():
    hot = kneser.Hot(np.zeros(0, np.uint64), np.zeros(0), None)
    for k in range(0, 100_000, 1000):
        text = " ".join(f"w{n}" for n in range(k, k + 1000))
        fm.features(text, None)
        assert hot.gather([text, None])[0].tolist() == [1000, 0]
        assert len(fm._bucket) < 70_000 and len(kneser._words) < 70_000
    fm._bucket.clear()
    kneser._words.start()


def test_words_looked_at_first_change_no_sample(monkeypatch):
    held = pieces.Lattices(pieces.Vocabulary(pieces.model_path(), pieces.ALPHA))
    texts = ["some words of a text that is somewhat long " * 40, "x" * 300 + " two", "a", None, "\U0001f600 e\n\n f"]
    drawn = []
    for near in (1, 5, 128, 1 << 30):
        monkeypatch.setattr(pieces, "NEAR", near)
        found = pieces.sample(texts, list(range(5)), 4, held)
        drawn.append([[(p.tolist(), *rest) for p, *rest in paths] for paths in found])
    assert drawn[0] == drawn[1] == drawn[2] == drawn[3] and len(drawn[0][0]) == 4


@pytest.mark.parametrize("text", ["", "a", " ", "  ", "a b", " a  b ", "a\nb", "\n\n a \n b\n", "a\tb \r\n c", "▁ x▁▁y▁\n", "a \x00 b\x1c"])
def test_words_are_those_of_the_pattern(text):
    marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
    assert pieces.words_of(text) == (pieces.WORDS.findall(marked) if text else [])


def test_words_learnt_in_runs_draw_as_in_one(monkeypatch):
    vocabulary = pieces.Vocabulary(pieces.model_path(), pieces.ALPHA)
    texts = ["one two three four five six seven", "", "café \U0001f600 and\n\na line  of   spaces", "x" * 300 + " two", None]
    drawn = []
    for chars in (1, 7, 100, 1 << 30):
        monkeypatch.setattr(pieces, "LEARNT_CHARS", chars)
        held = pieces.Lattices(vocabulary)
        found = [pieces.sample(texts[a:b], list(range(a, b)), 3, held) for a, b in ((0, 2), (2, 5))]
        drawn.append([[(p.tolist(), *rest) for p, *rest in paths] for part in found for paths in part])
    assert drawn[0] == drawn[1] == drawn[2] == drawn[3]
    assert [len(paths) for paths in drawn[0]] == [3, 0, 3, 3, 0]


def test_bitmaps_of_long_texts_rule_out_no_near_copy(spark):
    rng = np.random.default_rng(12)
    words = [f"w{n}" for n in rng.integers(0, 1 << 30, 6000)]
    near, far = list(words), list(words)
    for at in range(0, 6000, 60):
        near[at] = f"near{at}"
    for at in range(0, 6000, 20):
        far[at] = f"far{at}"
    rows = [(7, " ".join(words)), (9, " ".join(near)), (3, " ".join(far)), (11, " ".join(words[:3])), (None, None)]
    found = {r["doc_id"]: r["component_id"] for r in copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {7: 7, 9: 7, 3: 3, 11: 11, None: None}


def test_texts_without_label_are_not_shuffled_for_the_counts(spark):
    docs = spark.range(5000).selectExpr("IF(id % 10 = 9, NULL, id) AS doc_id", "'some text' AS text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 5000, 25)], "doc_id int, toxic int")
    usable = [i for i in range(0, 5000, 25) if i % 10 != 9]
    left = [r["doc_id"] for r in kneser.maybe_labelled(docs, labels).collect()]
    assert set(usable) <= set(left) and len(left) < 250
    assert kneser.maybe_labelled(docs, labels.limit(0)).count() == 0
    counted = {(r["order"], r["n1"], r["n0"]) for r in kneser.count_expressions(docs, labels).collect()}
    assert counted == {(k, sum(i % 2 for i in usable), sum(1 - i % 2 for i in usable)) for k in (0, 1, 2)}


def test_training_keeps_no_words_in_the_worker():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(["one two", "three"]), pa.array([7.0, 5.0])], ["label", "text", "n_chars"])
    assert sum(out.num_rows for out in fm._pack(iter([batch]))) == 2
    assert not fm._bucket


def test_sets_of_long_texts_that_share_a_line_are_not_made_again(spark, monkeypatch):
    rng = np.random.default_rng(21)
    line = " ".join(f"line{k}" for k in range(40))
    rows = [(k, line + " " + " ".join(f"w{n}" for n in rng.integers(0, 1 << 30, 5000))) for k in range(12)]
    words = [f"v{n}" for n in rng.integers(0, 1 << 30, 2060)]  # their bitmaps differ in length
    rows += [(20, " ".join(words)), (21, " ".join(words[:2030]))]
    made, whole = [], copies.whole_sets
    monkeypatch.setattr(copies, "whole_sets", lambda docs, classes, wanted, n: made.append(wanted.count()) or whole(docs, classes, wanted, n))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs).collect()}
    assert found == {k: k for k in range(12)} | {20: 20, 21: 20} and sum(made) == 2
    assert "shingles" not in copies.shingle_sets(docs).columns


def test_rows_are_kept_without_moving_texts(spark):
    docs = spark.range(4000).selectExpr("IF(id % 100 = 99, NULL, id % 3990) AS doc_id", "concat('text ', id % 3990) AS text")
    found = docs.selectExpr("doc_id", "IF(doc_id % 7 = 3, doc_id - 1, doc_id) AS component_id")
    kept = sorted(str(r["doc_id"]) for r in simhash.keep_one(docs, lambda _: found).collect())
    ids = [None if i % 100 == 99 else i % 3990 for i in range(4000)]
    once = {i for i in ids if i is not None and i % 7 != 3}
    assert kept == sorted(map(str, [*once, *(None for i in ids if i is None)]))
    moved = simhash.sieved(docs, found.filter("doc_id <> component_id"), among=False)
    assert "Exchange hashpartitioning(doc_id" not in moved._jdf.queryExecution().executedPlan().toString()


def test_no_filed_fingerprints_are_sent_to_the_driver(spark):
    df = spark.range(300).selectExpr("id * 7919 AS fp")
    for found in (simhash.fine_links(df), simhash.links(df)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_op6_gives_the_segmentations_whole(spark, tmp_path):
    text = {1: "some words of a text", 2: "caf\u00e9 \U0001f600 and\n\na line  of   spaces", 3: "x" * 300 + " two"}
    spark.createDataFrame(list(text.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = pieces.decode_pieces(pieces.op6_gumbel_pieces(spark, str(tmp_path))).collect()
    assert sorted((r["doc_id"], r["sample"]) for r in found) == [(i, k) for i in text for k in (1, 2)]
    for r in found:
        assert r["decodes"] and r["text"] == text[r["doc_id"]] and len(r["ids"]) == r["n_ids"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]

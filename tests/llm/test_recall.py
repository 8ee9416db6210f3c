"""Links of near duplicates by band of similarity, over documents and copies of them with words exchanged."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vexel.llm import simhash

TOTAL = 24
BANDS = [(0.80, 0.82), (0.82, 0.85), (0.85, 0.90), (0.90, 1.01)]


def shingles(text, k=5):
    w = (text or "").encode().translate(simhash.LOWER).split()
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(w[i:i + k])) for i in range(max(1, len(w) - k + 1))] if w else [], np.uint64))


@pytest.fixture(scope="module")
def pairs(spark):
    """((text, number) of each, pairs (i, j, similarity) of 0.8 or more): documents of the table and copies with words exchanged."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("size(split(text, ' ')) between 60 and 1500").orderBy("doc_id").limit(1500)
    rng = np.random.default_rng(0)
    rows, found = [], []
    for text in dict.fromkeys(r.text for r in df.collect()):
        words = text.split()
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.003, 0.024))), replace=False):
            words[at] = "".join(rng.choice(list("abcdefghij"), 7))
        a, b = shingles(text), shingles(" ".join(words))
        n = len(np.intersect1d(a, b, assume_unique=True))
        similar = n / (len(a) + len(b) - n)
        rows += [(text, len(rows)), (" ".join(words), len(rows) + 1)]
        if similar >= 0.8:
            found.append((len(rows) - 2, len(rows) - 1, similar))
    return rows, found


@pytest.mark.parametrize("front", simhash.WIDE_FRONTS)
def test_direct_links_by_band(pairs, front):
    """At least 0.9 of the pairs of each band may be linked directly: they differ in few bits and agree in the blocks of a front."""
    rows, found = pairs
    size, count = front
    words = {i: simhash.fingerprint(rows[i][0], 5, True)[:2] for p in found for i in p[:2]}
    right = {b: [] for b in BANDS}
    for a, b, similar in found:
        apart = [x ^ y for x, y in zip(words[a], words[b])]
        same = sum((w >> (64 - at - size)) & ((1 << size) - 1) == 0 for w in apart for at in range(0, 64 // size * size, size))
        near = sum(w.bit_count() for w in apart) <= TOTAL and same >= count
        right[next(x for x in BANDS if x[0] <= similar < x[1])].append(near)
    assert min(len(v) for v in right.values()) >= 50
    assert all(np.mean(v) >= 0.9 for v in right.values()), {b: (len(v), round(np.mean(v), 3)) for b, v in right.items()}


def test_links_are_those_of_a_plain_loop(spark, pairs):
    """The groups are those of all pairs that differ in few bits and share a front, and hold 0.9 of the similar pairs of each band."""
    rows, found = pairs
    some = sorted({i for p in found for i in p[:2]})
    table = spark.createDataFrame([(i, rows[i][0]) for i in some], "doc_id bigint, text string")
    group = {r.doc_id: r.component_id for r in simhash.grouped(table, 5, TOTAL, TOTAL, 9).collect()}
    words = np.array([simhash.fingerprint(rows[i][0], 5, True)[:2] for i in some], np.uint64)
    size, count = simhash.WIDE_FRONTS[0]
    root = list(range(len(some)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(some)):
        apart = words[i + 1:] ^ words[i]
        near = np.bitwise_count(apart).sum(axis=1) <= TOTAL
        same = sum((((apart >> np.uint64(64 - at - size)) & np.uint64((1 << size) - 1)) == 0).sum(axis=1) for at in range(0, 64, size))
        for j in np.flatnonzero(near & (same >= count)):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    assert [group[d] for d in some] == [some[find(i)] for i in range(len(some))]
    for band in BANDS:
        own = [group[a] == group[b] for a, b, s in found if band[0] <= s < band[1]]
        assert np.mean(own) >= 0.9, (band, np.mean(own))


def test_longer_fronts_for_many_texts(spark, monkeypatch):
    """Where texts are many, fronts of three blocks; the same groups of clear copies."""
    rng = np.random.default_rng(1)
    words = rng.integers(-2**63, 2**63 - 1, (300, 2))
    copies = words.copy()
    copies[:, 0] ^= np.int64(1) << rng.integers(0, 63, 300)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in np.vstack([words, copies])], "fp bigint, fp2 bigint")
    monkeypatch.setattr(simhash, "WIDE_FRONTS", ((1, 1), (7, 3)))
    monkeypatch.setattr(simhash, "TRIE_ROWS", 200)
    found = simhash.components(simhash.links(df, TOTAL, TOTAL))
    node = {(r.fp, r.fp2): r.n for r in df.withColumn("n", F.xxhash64("fp", "fp2")).collect()}
    root = {r.node: r.root for r in found.collect()}
    for a, b in zip(words.tolist(), copies.tolist()):
        a, b = node[tuple(a)], node[tuple(b)]
        assert root.get(a, a) == root.get(b, b)
    assert len(set(root.values())) == 300


@pytest.mark.parametrize("meeting", [4_000, 7])
def test_every_similar_pair_is_linked(spark, monkeypatch, meeting):
    """Groups are those of all pairs of a similarity of 0.8 or more: pairs just above and below it, many copies of one text, a paragraph of many texts, short texts, few words."""
    monkeypatch.setattr(simhash, "MEETING", meeting, raising=False)
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]

    def changed(text, times):
        w = text.split()
        for at in rng.choice(len(w), times, replace=False):
            w[at] = "".join(rng.choice(list("ijklmnop"), 7))
        return " ".join(w)

    texts = [" ".join(rng.choice(words, 300)) for _ in range(150)]
    texts += [changed(t, int(rng.integers(5, 8))) for t in texts]
    hub = " ".join(rng.choice(words, 200))
    texts += [changed(hub, int(rng.integers(1, 6))) for _ in range(60)]
    shared = " ".join(rng.choice(words, 40))
    texts += [f"{shared} {' '.join(rng.choice(words, int(rng.integers(1, 12))))}" for _ in range(60)]
    texts += [" ".join(rng.choice(words[:3], int(rng.integers(1, 14)))) for _ in range(60)]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(np.intersect1d(a, b, assume_unique=True))
            if 9 * n >= 4 * (len(a) + len(b)):
                close += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.deduplicated(table).collect()} == {find(i) for i in range(len(texts))}
    assert close > 200 and len({find(i) for i in range(len(texts))}) < len(texts) - 150

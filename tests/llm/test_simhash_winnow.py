import hashlib
import re

import numpy as np
import pytest
import xxhash
from fixtures import DOC, EDGE, PROSE, SF, docs
from pyspark.sql import functions as F

from vexel.llm import common, simhash, winnow


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, ids, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= bits):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_groups_equal_brute_force(spark, table):
    df = docs(spark, EDGE, extra=True) if table == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.groups_digest(df).collect())
    texts = {r.doc_id: r.text for r in df.collect()}
    assert [r[0] for r in rows] == sorted(texts) and all(fp == brute_fingerprint(texts[d], 4) for d, fp, _ in rows)
    assert [r[2] for r in rows] == brute_groups(np.array([r[1] for r in rows], np.uint64), [r[0] for r in rows], 4)


@pytest.mark.parametrize("bits, rows", [(2, 50), (4, 50), (4, 20_000), (8, 100)])
def test_trie_join_of_clusters(spark, monkeypatch, bits, rows):
    """Balls of near fingerprints, with tries small enough to be dealt out by subtries."""
    monkeypatch.setattr(simhash, "TRIE_ROWS", rows)
    rng = np.random.default_rng(bits)
    x = np.repeat(rng.integers(0, 2**63, 3, dtype=np.uint64), 200)
    for _ in range(bits + 1):
        x ^= (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)) * (rng.random(len(x)) < 0.7).astype(np.uint64)
    x = np.unique(np.r_[x, rng.integers(0, 2**63, 200, dtype=np.uint64)])
    df = spark.createDataFrame([(int(v), int(v), 0) for v in x.view(np.int64)], "node bigint, fp bigint, fp2 bigint")
    root = {int(v): int(v) for v in x.view(np.int64)}
    for r in simhash.components(simhash.links(df.select("fp", "fp2"), bits)).collect():
        root[r.node] = r.root
    place = {int(v): i for i, v in enumerate(x.view(np.int64))}
    want = brute_groups(x, list(range(len(x))), bits)
    same = {}
    for v, i in place.items():
        assert same.setdefault(root[v], want[i]) == want[i]
    assert len(same) == len(set(want))


def test_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, PROSE, None, None, 1), (5, PROSE, None, None, 1), (5, PROSE, None, None, 1), (None, "other words entirely", None, None, 1)], DOC)
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.groups_digest(rows).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5)]
    kept = simhash.deduplicated(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "other words entirely"), (5, PROSE)]
    assert simhash.deduplicated(rows.limit(0)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(4000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    near = [t.replace(t.split()[7], "changed") for t in texts]
    kept = {r.doc_id for r in simhash.deduplicated(docs(spark, texts + near + texts[:3])).collect()}
    assert kept == set(range(30))


def test_short_copies_with_words_at_an_end_go(spark):
    """Texts of 4 shingles and more, whose similarity to the copy is n / (n + 1), or 0.8 with two words."""
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)) for n in [8, 9, 10, 11, 12, 13, 14, 12, 13, 7, 11]]
    copies = [t + " added" if i % 2 else "added " + t for i, t in enumerate(texts[:7])] + ["one " + texts[7] + " two", texts[8] + " one two"]
    others = [texts[9] + " added", texts[10] + " one two"]  # 3/4 and 7/9
    kept = {r.doc_id for r in simhash.deduplicated(docs(spark, texts + copies + others)).collect()}
    assert kept == set(range(11)) | {20, 21}


def test_short_links_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    sets = {frozenset(rng.choice(16, rng.integers(1, 15), replace=False).tolist()) for _ in range(400)}
    hashes = rng.integers(-2**63, 2**63 - 1, 16)
    sets = [sorted(int(hashes[x]) for x in s) for s in sorted(sets, key=sorted)]
    df = spark.createDataFrame(list(enumerate(sets)), "node bigint, few array<bigint>")
    root = {i: i for i in range(len(sets))} | {r.node: r.root for r in simhash.components(simhash.short_links(df)).collect()}
    want = {i: i for i in range(len(sets))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(set(a) & set(b))
            if 5 * both >= 4 * (len(a) + len(b) - both) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert root == want and len(set(want.values())) < len(sets)


def brute_marks(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = split(text), set(), []
    for item, t in items:
        v = split(t)
        size = min(10, len(v))
        windows = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        at = [i for i in range(len(w) - size + 1) if tuple(w[i:i + size]) in windows] if windows else []
        hit |= {p for i in at for p in range(i, i + size)}
        found += [str(item)] * bool(at)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("limit", [None, 0])
def test_winnowing_equals_brute_force(spark, monkeypatch, limit):
    """With small items, by broadcast and by shuffle."""
    if limit is not None:
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(common, "HOT_ROWS", 1)
        monkeypatch.setattr(winnow, "PRINT_ROWS", limit)
    words = PROSE.split()
    items = [(1, PROSE), (2, "Seven wizards"), (3, "river"), (4, None), (5, "..."), (10, " ".join(words[3:15])), (6, "a b a b a b a b a b a b a b"), (7, "Zürich ok"), (2, "near the river bank")]
    texts = EDGE + [" ".join(words[2:14]), " ".join(words[2:11]), "x SEVEN-wizards y", "a b " * 40, "zÜrich zürich OK", " ".join(words[:12] + ["and"] + words[12:]), "river"]
    df = docs(spark, texts, extra=True)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in winnow.contamination(df, bench).collect()}
    merged = {}
    for i, t in items:
        merged.setdefault(i, []).append(t)
    for d, text in enumerate(texts):
        n, hit, _, _ = brute_marks(text, items)
        found = sorted({str(i) for i, t in items if brute_marks(text, [(i, t)])[2]})
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0), text
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    clean = winnow.clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d in got if not got[d].contaminated}


def test_winnowing_of_empty_tables(spark):
    df, bench = docs(spark, EDGE), spark.createDataFrame([(1, PROSE)], "item_id bigint, text string")
    assert winnow.contamination(df.limit(0), bench).count() == 0
    assert winnow.contamination(df, bench.limit(0)).filter(F.col("contaminated")).count() == 0

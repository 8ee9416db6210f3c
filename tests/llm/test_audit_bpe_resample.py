"""The filter audit, byte-level BPE and importance resampling against plain loops and the tiktoken library."""

import base64
import hashlib
import math
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures import DOC, EDGE, PROSE, SF, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from vexel.llm import audit, bpe, resample

RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LABELS = "doc_id bigint, quality int, toxic int"


def failures(rows):
    """The letters of the filters that each (doc_id, text) fails."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({f for f, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text),
            doc_id is not None and any((t or "") == text and d is not None and d < doc_id for d, t in rows))) if bad})
    return out


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    fails = failures([r[:2] for r in rows])
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, df, labels):
    got = audit.filter_audit(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


LONG = " ".join(f"word{i}" for i in range(120))


def test_audit_equals_a_plain_loop(spark):
    texts = [*EDGE, LONG, LONG + " #", LONG.upper(), LONG, "A B C " * 60, LONG + " é", "x y " * 80, LONG]
    df = docs(spark, texts, extra=True)
    more = spark.createDataFrame([(None, LONG, "en", None, None), (None, None, None, None, None), (3, LONG, "de", None, None), (3, "again", "de", None, None)], DOC)
    df = df.unionByName(more, allowMissingColumns=True).unionByName(df.filter("doc_id in (0, 12)"))
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 20)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (4, None, None)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    assert audited(spark, df, labels) == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    df = docs(spark, EDGE)
    assert audited(spark, df.limit(0), [(1, 1, 1)]) == {}
    assert audited(spark, df, []) == brute_audit([(r.doc_id, r.text, r.lang) for r in df.collect()], [])


@pytest.mark.parametrize("rows, parts", [(1, 1), (64, 1), (65, 1), (1000, 7), (1000, 900), (5000, 2)])
def test_bitsets_equal_masks(rows, parts):
    rng = np.random.default_rng(rows + parts)
    part, flags = rng.integers(0, parts, rows), [rng.random(rows) < p for p in (0.1, 0.5, 0.9, 0.3, 0.6)]
    found, counts = audit.subset_counts(part, flags[:3], flags[3:])
    assert found.tolist() == sorted(set(part.tolist()))
    for i, p in enumerate(found):
        for s in range(8):
            left = (part == p) & ~np.any([flags[f] & bool(s >> f & 1) for f in range(3)], axis=0)
            assert counts[i, s].tolist() == [left.sum(), (left & flags[3]).sum(), (left & flags[4]).sum()]


def test_blocks_of_a_task_add_up(spark, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK_ROWS", 7)
    df = spark.range(500).selectExpr("cast(id % 3 as string) as p", "id % 2 = 0 as f", "id % 5 = 0 as `g.x`", "if(id % 7 = 0, true, null) as m")
    got = {(r.part, r.subset): (r.n, r.m0) for r in audit.interaction_counts(df, "p", ["f", "g.x"], ["m"]).collect()}
    for p in range(3):
        for s in range(4):
            left = [i for i in range(500) if i % 3 == p and not (s & 1 and i % 2 == 0) and not (s & 2 and i % 5 == 0)]
            assert got[str(p), s] == (len(left), sum(i % 7 == 0 for i in left))


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.Vocabulary.build(bpe.read_ranks(RANKS)), bpe.character_classes())


def encode(coder, texts):
    return [x.tolist() for x in coder.encode([t.encode() for t in texts])]


def test_perfect_hash_is_minimal(coder):
    v = coder.vocabulary
    assert sorted(v.slots.tolist()) == list(range(len(v.tokens)))
    h = bpe.run_hashes(v.data, v.starts[:-1], v.starts[1:])
    assert v.find(v.data, v.starts[:-1], v.starts[1:], h).tolist() == list(range(len(v.tokens)))
    other = np.frombuffer(b"".join(b"%07dq" % i for i in range(5000)), np.uint8)
    at = np.arange(0, len(other), 8)
    assert (v.find(other, at, at + 8, bpe.run_hashes(other, at, at + 8)) == -1).all()


def test_every_code_point_equals_the_library(coder, library):
    """Alone, beside letters, numbers, signs and spaces, at either end of a text."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        texts = [f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}'s" for c in points[at:at + 4000]]
        got = encode(coder, texts)
        if got != [library.encode_ordinary(t) for t in texts]:
            for t, g in zip(texts, got):
                assert g == library.encode_ordinary(t), ascii(t)


PARTS = st.sampled_from(["'", "'s", "'ll", "'re", "'ve", "'m", "'d", "'t", "s", "L", "re", " ", "  ", "\n", "\t", " ", "　", "\x1c", "1", "½", "é", "word", ".", "--", "\U0001F600", "́", "漢字", "naïve", "the", "  \n "])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS | st.text(max_size=3), max_size=14).map("".join), max_size=5))
def test_texts_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode(CODER, texts) == [LIBRARY.encode_ordinary(t) for t in texts]


CODER = bpe.Coder(bpe.Vocabulary.build(bpe.read_ranks(RANKS)), bpe.character_classes())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_long_texts_in_pieces(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    texts = [PROSE * 9, "a" * 3000, ("é " * 40 + "don't  stop \n") * 9, " " * 500, "x y" * 100, "ab12" * 300]
    assert encode(coder, texts) == [library.encode_ordinary(t) for t in texts]


def test_hash_collisions_are_told_apart(coder, library, monkeypatch):
    """Even where all pre-tokens have one of a few hashes."""
    plain = bpe.run_hashes
    vocabulary = coder.vocabulary
    monkeypatch.setattr(bpe, "run_hashes", lambda *a: plain(*a) % np.uint64(3))
    monkeypatch.setattr(bpe.Vocabulary, "find", lambda self, data, starts, ends, h: np.full(len(h), -1))
    whole = {t: r for t, r in coder.ranks.items()}
    monkeypatch.setattr(coder, "second_tier", lambda piece: np.array([whole[piece]] if piece in whole else bpe.merged(piece, whole), np.int32).tobytes())
    assert vocabulary is coder.vocabulary
    texts = [PROSE, "Wörter wie Straßenbahnhaltestelle, naïve und naïve", "qzxj qzxk qzxj vvvv"]
    assert encode(coder, texts) == [library.encode_ordinary(t) for t in texts]


def test_digests_of_edge_cases(spark, library):
    texts = [*EDGE, "<|endoftext|> x", "it's  'll", "\r\n\r\n a", "don't'S", "x" * 70 + " " + "x" * 70]
    df = docs(spark, texts, extra=True)
    got = {r.doc_id: r for r in bpe.token_digests(df.unionByName(df.filter("doc_id = 1")), RANKS).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.token_digests(df.limit(0), RANKS).count() == 0
    coded = bpe.encoded(df, RANKS)
    assert coded.columns == [*[c for c in df.columns if c != "ids"], "ids"] and bpe.decoded(coded, RANKS).filter("cast(decoded as string) <> coalesce(text, '')").count() == 0


def test_every_document_equals_the_library(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.token_digests(df, RANKS).collect()}
    want = {}
    for r in df.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got == want


def test_unknown_ids_are_an_error(coder):
    with pytest.raises(ValueError):
        bpe.decoded_bytes(coder.vocabulary, np.array([50_300]))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_features(text):
    w = words_of(text)
    return [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def brute_resampled(rows, bench):
    found = [brute_features(t) for _, t in rows]
    target = [b for t in bench for b in brute_features(t)]
    s, t = (np.bincount(x, minlength=10000).tolist() for x in ([b for f in found for b in f] or [0], target or [0]))
    if not any(found):
        s = [0] * 10000
    if not target:
        t = [0] * 10000
    S, T = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000)))) for b in range(10000)]
    out = []
    for (doc_id, text), f in zip(rows, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(long[:25 * len(long) // 100], 1):
        r[4] = i
    return sorted((str(x[:5]) for x in out))


def resampled_rows(spark, df, bench):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id int, text string")
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in resample.resampled(df, frame).collect())


@pytest.mark.parametrize("block", [resample.BLOCK, 40])
def test_resampling_equals_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    rng = np.random.default_rng(5)
    texts = EDGE + ["A-b_c. " * 30, "ÀÉ x" * 40, "longword" * 40 + " " + "z" * 47 + " " + "z" * 48 + " " + "z" * 49, "x"] + [" ".join(rng.choice(["red", "Green", "blue9", "ünï", "y"], 30)) for _ in range(40)]
    df = docs(spark, texts, extra=True).repartition(3)
    df = df.unionByName(df.filter("doc_id in (3, 20)")).unionByName(spark.createDataFrame([(None, PROSE, None, None, None), (None, None, None, None, None)], DOC), allowMissingColumns=True)
    bench = [PROSE, None, "", "red green red", "ünï y"]
    assert resampled_rows(spark, df, bench) == brute_resampled([(r.doc_id, r.text) for r in df.collect()], bench)


def test_resampling_of_empty_tables(spark):
    df = docs(spark, EDGE)
    assert resampled_rows(spark, df.limit(0), [PROSE]) == []
    assert resampled_rows(spark, df, []) == brute_resampled([(r.doc_id, r.text) for r in df.collect()], [])
    assert resampled_rows(spark, df.filter("text is null or text = ''"), []) == brute_resampled([(2, None), (3, "")], [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB9é漢 -_\n\x7f"), max_size=40), max_size=6), st.integers(1, 30))
def test_buckets_of_any_texts(texts, block):
    """Blocks of any length cut nothing."""
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    before, resample.BLOCK = resample.BLOCK, block
    try:
        found = [[] for _ in texts]
        for i, one, j, two in resample.features(np.frombuffer(b"".join(data), np.uint8), offsets):
            for t, b in [*zip(i.tolist(), one.tolist()), *zip(j.tolist(), two.tolist())]:
                found[t].append(b)
    finally:
        resample.BLOCK = before
    assert [sorted(f) for f in found] == [sorted(brute_features(t)) for t in texts]


def test_tables(spark):
    """Of the given table, against plain loops."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert resampled_rows(spark, df, bench) == brute_resampled(rows, bench)

import math
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from fixtures import EDGE, docs
from tokenizers import Tokenizer

from vexel.llm import maxscore, repair

TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("shard, step, sample", [(32 << 20, 4_096, 4_096), (1_000, 16, 7)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, step, sample):
    monkeypatch.setattr(maxscore, "SHARD_BYTES", shard)
    monkeypatch.setattr(maxscore, "QUERY_BYTES", shard)
    monkeypatch.setattr(maxscore, "SAMPLED", sample)
    monkeypatch.setattr(maxscore, "STEP", step)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "x") for i in range(300)]
    rows += [(300 + i, [0.5] * 8, "x") for i in range(60)]  # ties
    rows += [(400, None, "x"), (401, [1.0, None], "x"), (402, [float("nan")] * 8, "x"), (450, [float("inf")] * 8, "x"), (None, [9.0] * 8, "x"), rows[0], (500, [], "x"), (501, [2.0], "x")]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")).collect())
    fine = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            fine[i] = np.pad(np.floor(256 * np.array(v, np.float32).astype(float)), (0, 8 - len(v))).astype(int)
    want = []
    for q in sorted(i for i in fine if i % 50 == 0):
        best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want


@pytest.mark.parametrize("scale", [1e6, 1e8, 1e12, 1e17, 1e200, 1e307])
def test_large_components_have_exact_scores(spark, monkeypatch, scale):
    monkeypatch.setattr(maxscore, "STEP", 16)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * scale).tolist()) for i in range(120)] + [(200 + i, [scale] * 6) for i in range(4)]
    fine = {i: [math.floor(256 * Fraction(c)) for c in v] for i, v in rows}
    want = []
    for q in (0, 50, 100, 200):
        best = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q)[:5]
        want += [(q, n + 1, i, max(-2**63, min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    if max(s for *_, s in want) < 2**63 - 1:
        assert got == want
    else:  # cut off at the largest long, scores tie in the merge
        assert [(q, s) for q, _, _, s in got] == [(q, s) for q, _, _, s in want]


def test_first_thresholds_spare_multiplications():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    x = rng.normal(size=(2000, 64))
    column = pa.array(x.tolist(), pa.list_(pa.float64()))
    s = np.floor(256 * x) @ np.floor(256 * x[:40]).T
    table = lambda floor: pa.table({"vec_id": list(range(40)), "embedding": x[:40].tolist(), "floor": floor})
    known, few = maxscore.best_of(column, np.arange(2000), table(np.sort(s, axis=0)[-6].tolist()), 5)
    plain, many = maxscore.best_of(column, np.arange(2000), table([-math.inf] * 40), 5)
    assert all(np.array_equal(a, b) for a, b in zip(known, plain)) and few < 0.75 * 2000 * 40 * 64 and few < many


def test_top_k_of_few_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in maxscore.top_k(rows).collect()] == [(0, 1, 7, 196608)]
    assert maxscore.top_k(rows.filter("vec_id = 0")).count() == 0 and maxscore.top_k(rows.limit(0)).count() == 0


TEXTS = EDGE + [" lead", "two  spaces", "a \n b", "x  y", "it's  'll", "\n\n a\n\n  b", "a\x1c b", "<|endoftext|> x", "end ", "naïve,, words!? Words, words."]


def want_digest(texts):
    t, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens_come_back(spark):
    rows = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in repair.token_digest(docs(spark, TEXTS, extra=True).repartition(3), TOKENIZER).collect()}
    assert [rows[i] for i in range(len(TEXTS))] == want_digest(TEXTS)
    assert repair.token_digest(docs(spark, TEXTS).limit(0), TOKENIZER).count() == 0


def test_tokens_of_equal_keys(spark):
    """Null and repeated doc_ids: nulls come first, and a key of most rows is dealt out to several partitions."""
    rows = [(None, "b"), (5, "c d")] + [(3, "the same text")] * 400 + [(3, "another"), (None, None)]
    got = repair.token_digest(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), TOKENIZER).collect()
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    ids = {text: want_digest([text])[0][1:] for _, text in rows}
    assert sorted([(r[1] is not None, r[1] or 0, *r[2:]) for r in got]) == sorted((i is not None, i or 0, *ids[t]) for i, t in rows)
    start = 0
    for r in got:
        assert r[0] == start
        start += r[2]
    order = [(r[1] is not None, r[1] or 0) for r in got]
    assert order == sorted(order)


@pytest.mark.parametrize("piece", [32 << 20, 50])
def test_texts_cut_into_parts_have_the_ids_of_whole_texts(monkeypatch, piece):
    """Every neighbourhood of letters, digits, signs, apostrophes, white space and other characters, also across texts that are encoded together."""
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = np.random.default_rng(5)
    alphabet = ["a", "B", "s", "'re", "e\u0301", "\xe9", "\xd7", "\xf7", "\u0120", "\u010a", "\u017f", "\u0131", "\u0416", "\u0482", "\u03b1", "\u4e2d", "\U0001f600", "\u0663", "\xb2", "7", "42", ".", ",", "$", "_", "|", "'", "\u2019", "\u2014",
                "\n", "\n", "\t", "\r", "\x1c", "\x00", "\x85", "\xa0", "\u2028", "\u3000", " ", " ", " ", "<|endoftext|>", "the", "ing"]
    weights = np.array([0.1 if a == "<|endoftext|>" else 1.0 for a in alphabet])
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 9), p=weights / weights.sum())) for _ in range(6_000)] + ["a\n\n", "B", "x", "\n\nb", "", "\xc3", "\x97"]
    encoder, t = repair.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for _ in range(2):  # anew, and remembered
        got = [np.frombuffer(x, encoder.unit).tolist() for x in encoder.encode(texts)]
        assert [(x, t.encode(x, add_special_tokens=False).ids, g) for x, g in zip(texts, got) if t.encode(x, add_special_tokens=False).ids != g] == []


def test_the_library_gets_a_part_once(monkeypatch):
    """However words, signs and ends of lines stand together: 800 words in 20,000 pairs."""
    rng, seen = np.random.default_rng(6), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode(self, text, **options):
            seen.append(len(text))
            return self.tokenizer.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            seen.extend(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **options)

    encoder = repair.Encoder(TOKENIZER)
    for name in ("tokenizer", "bpe"):
        if hasattr(encoder, name):
            setattr(encoder, name, Counted(getattr(encoder, name)))
    words = ["".join(rng.choice(list("abcdefgh\xe9"), 9)) for _ in range(800)]
    signs = [".", ",", "$$$", "!!", ".\n", ",\n"]
    texts = [" ".join(f"{words[a]}{signs[c]}{words[b]}{signs[c // 3]}" for a, b, c in zip(rng.integers(800, size=20), rng.integers(800, size=20), rng.integers(6, size=20))) for _ in range(1_000)]
    t = Tokenizer.from_file(TOKENIZER)
    assert [np.frombuffer(x, encoder.unit).tolist() for x in encoder.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert sum(seen) < 5 * sum(map(len, words))


def sample_ids(kind):
    rng = np.random.default_rng(3)
    ids = {"words": np.r_[rng.zipf(1.3, 60_000) % 5000, rng.integers(0, 40_000, 60_000)], "nested": np.tile(np.arange(10, 1034), 40), "one": np.full(10_001, 7),
           "pairs": np.tile([5, 6, 5, 6, 2], 3_000), "wide": np.tile(np.arange(60_000, 100_000), 9), "none": np.zeros(0, int)}[kind].astype(np.uint32)
    tokens = np.full(len(ids) // 100, 100)
    ids = ids[:100 * len(tokens)]
    ids[99::100] = repair.END
    return ids, tokens


KINDS = ["words", "nested", "one", "pairs", "wide", "none"]


@pytest.mark.parametrize("kind", KINDS)
def test_grammar_round_trip(kind):
    ids, tokens = sample_ids(kind)
    block = repair.Block.parse(repair.pack(ids, tokens))
    assert np.array_equal(block.ids(), ids)
    for i in range(0, len(tokens), 7):
        assert np.array_equal(block.document(i), ids[100 * i:100 * i + 100])
    first = len(block.terminals) + 1
    assert [len(block.expand(np.array([first + r]))) for r in range(0, len(block.rules), 50)] == block.lengths[::50].tolist()


def counted(seq):
    """The pairs of a sequence without END, of overlapping occurrences of a run every second."""
    count, at = {}, {}
    for i, pair in enumerate(zip(seq[:-1], seq[1:])):
        if 0 not in pair and at.get(pair) != i - 1:
            count[pair], at[pair] = count.get(pair, 0) + 1, i
    return count


@pytest.mark.parametrize("kind", KINDS)
def test_rules_stand_for_frequent_pairs(kind):
    """Against a plain loop: rules are applied a round at a time, each must be frequent before its round, and none is left after the last."""
    ids, _ = sample_ids(kind)
    terminals, seq, rules, rounds = repair.compress(ids)
    first = len(terminals) + 1
    number = {repair.END: 0} | {int(t): i + 1 for i, t in enumerate(terminals)}
    now = [number[int(i)] for i in ids]
    for at, stop in zip(rounds, [*rounds[1:], first + len(rules)]):
        count = counted(now)
        pairs = [tuple(r) for r in rules[at - first:stop - first].tolist()]
        assert min(count[p] for p in pairs) >= repair.LEAST and count[pairs[0]] == max(count.values())
        now = replaced(now, pairs, at)
        uses = np.bincount([s for s in now if s >= at], minlength=stop)[at:]
        assert uses.min() >= repair.LEAST
    assert now == seq.tolist() and max(counted(now).values(), default=0) < repair.LEAST


def replaced(seq, pairs, symbols):
    """One round: of overlapping frequent pairs the more frequent one is replaced, if ``pairs`` has it."""
    count, order = counted(seq), {}
    frequent = sorted((p for p in count if count[p] >= repair.LEAST), key=lambda p: (-count[p], p))
    order = {p: i for i, p in enumerate(frequent)}
    at, place = {}, {}
    for i, pair in enumerate(zip(seq[:-1], seq[1:])):
        if pair in order and at.get(pair) != i - 1:
            at[pair], place[i] = i, order[pair]
    number = {p: symbols + n for n, p in enumerate(pairs)}
    out, i = [], 0
    alone = len(pairs) == 1
    while i < len(seq):
        pair = tuple(seq[i:i + 2])
        wins = i in place and (alone or place.get(i - 1, len(order)) > place[i] and place.get(i + 1, len(order)) >= place[i])
        if wins and pair in number:
            out.append(number[pair])
            i += 2
        else:
            out.append(seq[i])
            i += 1
    return out


def test_blocks_are_smaller_than_their_ids(spark):
    encoder = repair.Encoder(TOKENIZER)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    ids = np.concatenate([np.frombuffer(x + encoder.end, encoder.unit) for x in encoder.encode([t or "" for t in texts])])[:repair.BLOCK_TOKENS]
    assert len(repair.pack(ids, np.array([len(ids)]))) < 0.8 * 2 * len(ids)

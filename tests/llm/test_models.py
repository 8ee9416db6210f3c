import zlib

import numpy as np
import pytest
from fixtures import DOC, EDGE, docs

from vexel.llm import langid, toxicity


def accuracy(rows, truth, held, name):
    pairs = [(r[name], truth[r.doc_id]) for r in rows if r.held_out == held and truth.get(r.doc_id) is not None]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.languages(df).collect()
    assert len(rows) == df.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, {r.doc_id: r.lang for r in df.collect()}, True, "lang_pred") > 0.97


def test_language_of_edge_cases(spark):
    df = docs(spark, EDGE + ["1234 !!", "x"], extra=True)
    rows = {r.doc_id: r for r in langid.predictions(df).collect()}
    assert len(rows) == df.count()
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and not rows[i].accepted for i in (2, 3, 4, 5, len(EDGE)))
    assert rows[0].lang_pred == "en" and rows[0].shard == "x"
    assert langid.languages(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, "some text", None, None, 9)], DOC)
    assert langid.languages(none).first().lang_pred == "und"


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_language_sums_equal_a_plain_loop(monkeypatch, block):
    """Blocks of 7 bytes put their seams everywhere."""
    monkeypatch.setattr(langid, "BLOCK", block)
    p = langid.Params()
    rng = np.random.default_rng(0)
    table, weights, bias = rng.normal(size=(1 << p.bits, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    texts = ["", "a", "ab", "Grüße an alle", "x" * 300, "the end"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    got = langid.logits(langid.Model(["a", "b", "c"], table, weights, bias, 1.0, 0.0), np.frombuffer(data, np.uint8), offsets, p)
    for t, row in zip(texts, got):
        folded = langid.FOLD[np.frombuffer(t.encode(), np.uint8)]
        ids = np.concatenate([langid.subwords(folded, o, p.bits) for o in p.orders])
        want = table[ids].mean(axis=0) @ weights + bias if len(ids) else bias
        assert np.allclose(row, want)


def test_more_languages_than_dimensions():
    """Embeddings are summed instead of their products, with the same results."""
    texts = [f"{w} {w} {w}".encode() for w in ("alpha", "beta", "gamma") for _ in range(40)]
    labels = np.repeat([0, 1, 2], 40)
    narrow, wide = (langid.fit(texts, labels, ["a", "b", "c"], langid.Params(dim=d, steps=50)) for d in (2, 4))
    assert narrow.table.shape[1] == 2 and wide.table.shape[1] == 3
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for model, d in ((narrow, 2), (wide, 4)):
        assert (langid.logits(model, data, offsets, langid.Params(dim=d)).argmax(axis=1) == labels).mean() > 0.9


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(df, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == df.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    found, bad = sum(a and b for a, b in held), sum(a and not b for a, b in held)
    assert bad <= 0.02 * max(1, found) + 1 and found >= 0.6 * sum(b for _, b in held)


def test_toxicity_learns_an_interaction():
    rng = np.random.default_rng(1)
    labels, values, offsets = [], [], [0]
    for i in range(800):  # toxic only where both terms meet
        a, b = (rng.random(2) < 0.5).tolist()
        values += [1] * a + [2] * b + [3 + int(x) for x in rng.integers(0, 40, 3)]
        offsets.append(len(values))
        labels.append(float(a and b))
    p = toxicity.Params(bits=8, epochs=40)
    values, offsets, labels = np.array(values), np.array(offsets), np.array(labels)
    prob = toxicity.probabilities(toxicity.fit(values, offsets, labels, p), values, offsets)
    assert ((prob > 0.5) == (labels > 0)).mean() > 0.97


def test_toxicity_learns_terms_that_are_flat_alone():
    rng = np.random.default_rng(2)
    labels, values, offsets = [], [], [0]
    for i in range(2000):  # terms 1 and 2 are in 600 documents each, 30 of them toxic like 5 % of all: those with both
        both, one, two, plain = i < 30, 30 <= i < 600, 600 <= i < 1170, 1170 <= i < 1240
        values += [1] * (both or one) + [2] * (both or two) + [3] * plain + (4 + rng.choice(40, 3, replace=False)).tolist()
        offsets.append(len(values))
        labels.append(float(both or plain))
    p = toxicity.Params(bits=8, epochs=40)
    values, offsets, labels = np.array(values), np.array(offsets), np.array(labels)
    prob = toxicity.probabilities(toxicity.fit(values, offsets, labels, p), values, offsets)
    assert (prob[:30] > 0.5).all() and ((prob > 0.5) == (labels > 0)).mean() > 0.99


def test_toxicity_of_edge_cases(spark):
    df = docs(spark, EDGE, extra=True)
    labels = spark.createDataFrame([(0, 1, 1), (3, 1, 0), (None, 1, 1), (6, None, None), (0, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(df, labels).count() == df.count()
    assert toxicity.inoffensive(df, labels).columns == df.columns
    assert toxicity.toxicity(df.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(df, labels.limit(0)).collect()} == {0.5}


def test_models_of_long_texts_alone(spark):
    """Where all texts are longer than the sample asks for, the shortest of them are learned from."""
    rng = np.random.default_rng(1)
    words = {"en": ["the", "river", "stone", "quiet", "evening", "with"], "de": ["der", "Fluss", "Stein", "ruhig", "Abend", "mit"]}
    rows = [(i, " ".join(rng.choice(words[lang], 40 + i % 5)) + (" vile" * 3 if i % 3 == 0 else ""), lang) for i in range(120) for lang in [("en", "de")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.languages(df, langid.Params(sample_chars=50)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert accuracy(found, truth, True, "lang_pred") == 1.0
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    p = toxicity.Params(sample_chars=50)
    scored = toxicity.toxicity(df, labels, p).collect()
    assert min(r.score for r in scored if r.doc_id % 3 == 0) > max(r.score for r in scored if r.doc_id % 3) + 0.2
    values = {r.score for r in toxicity.toxicity(df, labels.limit(0), p).collect()}
    assert values == {0.5}

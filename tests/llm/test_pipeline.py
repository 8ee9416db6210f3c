"""Each stage on its own input, against what its operator's other results or a plain loop say."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from fixtures import DOC, EDGE, SF, docs
from pyspark.sql import functions as F

from vexel.llm import common, mixing, sharding, toxicity, winnow

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_columns_and_take_effect(spark):
    df = docs(spark, EDGE * 4, extra=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        df = out
    assert {"shard", "grown_shard"} <= set(corpus_pipeline.STAGES[-1][1](spark, df, SF).columns)


def test_toxicity_stage(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = ids(STAGES["toxicity"](spark, small, "/root/testdata/sf0.01"))
    assert kept == ids(toxicity.toxicity(small, labels).filter("predicted = 0")) and sum(kept.values()) < small.count()


def shingles(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(xxhash.xxh64_intdigest(b" ".join(words[i:i + k])) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def test_near_duplicates_stage(spark, small):
    """Of all pairs with a similarity of 0.8 or more, at least 0.9 lose a document; no document goes that is unlike all others."""
    rows = small.select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    holders = {}
    for d, s in sets.items():
        for h in s:
            holders.setdefault(h, []).append(d)
    shared = Counter()
    for found in holders.values():
        if len(found) < 200:  # a shingle of very many documents says nothing that their others don't
            shared.update((a, b) for i, a in enumerate(found) for b in found[i + 1:])
    similar = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    close = [p for p, j in similar.items() if j >= 0.8]
    kept = ids(STAGES["near duplicates"](spark, small, SF))
    assert set(kept.values()) == {1} and len(close) > 50
    assert np.mean([not (a in kept and b in kept) for a, b in close]) >= 0.9
    related = {d for (a, b), j in similar.items() if j >= 0.6 for d in (a, b)}
    same = Counter(sets.values())
    assert all(d in kept or d in related or same[s] > 1 for d, s in sets.items())


def test_decontamination_stage(spark, small):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    kept = ids(STAGES["decontamination"](spark, small, "/root/testdata/sf0.01"))
    assert kept == ids(winnow.contamination(small, bench).filter("n_hit = 0")) and sum(kept.values()) < small.count()


def test_mixing_stage(spark, small):
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix_digest(small).collect() if r["size"]}
    assert ids(STAGES["mixing"](spark, small, SF)) == Counter({d: n for d, n in times.items() if n})


def test_sharding_stage(spark, small):
    got = {r.doc_id: (r.shard, r.grown_shard) for r in STAGES["sharding"](spark, small, SF).collect()}
    assert got == {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_digest(small).collect()} and len({s for s, _ in got.values()}) == 16


def test_run(spark):
    """The stages one after the other: what each drops is gone from the result."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    want = Counter((r.doc_id, r.shard) for r in df.collect())
    assert want and want == Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, SF).collect())


def test_run_leaves_the_last_table_alone(spark):
    before = set(common.PATHS)
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(set(common.PATHS) - before) == 1


def test_null_ids(spark):
    df = docs(spark, EDGE).unionByName(spark.createDataFrame([(None, "some words of a text without a number", None, None, 1), (None, None, None, None, None)], DOC))
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert df.count() > 0


def test_empty_documents(spark):
    df = docs(spark, EDGE).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert df.filter(F.lit(True)).count() == 0

import hashlib
import zlib

import pytest
from fixtures import DOC, EDGE, SF, docs

from vexel.llm import mixing, sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 1000])
def test_jump_hash_equals_the_published_loop(spark, shards):
    rows = spark.range(200).withColumnRenamed("id", "doc_id")
    for r in sharding.assign_shards(rows, "doc_id", shards).collect():
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard) == (jump(key, shards), jump(key, shards + 1)) and r.grown_shard in (r.shard, shards)


def test_shard_digest_of_edge_cases(spark):
    df = docs(spark, EDGE, extra=True)
    df = df.unionByName(df.filter("doc_id < 3")).unionByName(spark.createDataFrame([(None, "x", None, None, None)], DOC), allowMissingColumns=True)
    got = sharding.shard_digest(df).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is not None:
            data = (EDGE[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_digest(df.limit(0)).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[n] for n in free)
        over = [n for n in free if w[n] * level > 3 * sizes[n]]
        if not over:
            out |= {n: w[n] * level for n in free}
            break
        for n in over:
            out[n] = 3.0 * sizes[n]
            left -= out[n]
            free.discard(n)
    return out


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_mix(spark, table):
    df = docs(spark, EDGE, extra=True) if table == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    df = df.unionByName(df.filter("doc_id in (0, 6)"))
    got, again = [sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix_digest(df).collect()) for _ in range(2)]
    assert got == again and len(got) == df.count()
    source = {r.doc_id: r.source for r in df.collect()}
    sizes, taken, largest = {}, {}, {}
    for d, size, *_, t in got:
        assert 0 <= t <= 3 * size
        s = source[d]
        sizes[s], taken[s], largest[s] = sizes.get(s, 0) + size, taken.get(s, 0) + t, max(largest.get(s, 0), 2 * size)
    want = brute_targets(sizes)
    for d, _, total, target, _ in got:
        assert total == sizes[source[d]] and target == pytest.approx(want[source[d]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_mixed_rows_and_empty_table(spark):
    df = docs(spark, EDGE)
    times = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix_digest(df).collect()}
    rows = mixing.mixed(df).collect()
    assert {d: n for d, n in times.items() if n} == {d: sum(r.doc_id == d for r in rows) for d in {r.doc_id for r in rows}}
    assert mixing.mixed(df).columns == df.columns
    assert mixing.mix_digest(df.limit(0)).count() == 0

"""Importance resampling of documents towards a target distribution over hashed word n-grams.

Texts are read as Arrow's UTF-8 buffers, not as strings: a table classifies and folds their bytes, differences of the
classes give the words' boundaries, and a table-driven CRC advances over all words at once, one byte a step. The CRC of a
pair of words goes on from the state of the first. Buckets are counted over both corpora, the log ratio of their
smoothed shares is a bucket's gain, and the documents with the highest mean gain plus Gumbel noise are drawn.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import BROADCAST_ROWS, stored

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes that are read at once, and steps of the CRC for all words; what is left of longer words takes zlib's.
BLOCK, STEPS = 1 << 21, 48
#: A byte of a word, with A-Z as a-z; zero between words. All bytes of code points beyond ASCII belong to words.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
START = np.uint32(0xFFFFFFFF)


def crc_table(polynomial: int = 0xEDB88320) -> np.ndarray:
    """The states that a byte leads to, by the reflected polynomial."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(polynomial), state >> 1)
    return state


CRC = crc_table()


def advanced(states: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC states after the bytes data[starts[i]:starts[i] + lengths[i]], all runs together, byte by byte."""
    order = np.argsort(-np.minimum(lengths, STEPS + 1).astype(np.int8), kind="stable")
    state, at = states[order], starts[order]
    reach = len(lengths) - np.cumsum(np.bincount(np.minimum(lengths, STEPS), minlength=STEPS + 1))[:-1]  # runs of more than j bytes
    for j, n in enumerate(reach.tolist()):
        if not n:
            break
        now = state[:n]
        state[:n] = CRC[(now ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    for i in np.flatnonzero(lengths > STEPS).tolist():
        out[i] = zlib.crc32(data[starts[i] + STEPS:starts[i] + lengths[i]].tobytes(), int(out[i] ^ START)) ^ 0xFFFFFFFF
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: (text of each word, bucket of each word, text of each pair, bucket of each pair).

    Text i is data[offsets[i]:offsets[i + 1]]. A block ends between words, within a text or not; the state of its last word is
    carried into the next, where a pair may go on from it.
    """
    at, size = int(offsets[0]), int(offsets[-1])
    carried = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    while at < size:
        stop = min(at + BLOCK, size)
        while stop < size and FOLD[data[stop - 1]] and FOLD[data[stop]]:
            gap = np.flatnonzero(FOLD[data[stop:stop + BLOCK]] == 0)
            stop = stop + int(gap[0]) if len(gap) else min(stop + BLOCK, size)
        folded = FOLD[data[at:stop]]
        inside = folded > 0
        first = np.zeros(len(folded), bool)
        lo, hi = np.searchsorted(offsets, [at, stop])
        first[offsets[lo:hi] - at] = True  # a text's first byte; of empty texts, that of the next
        starts = np.flatnonzero(inside & (first | ~np.r_[False, inside[:-1]]))
        ends = np.flatnonzero(inside & np.r_[first[1:] | ~inside[1:], True]) + 1
        text = np.searchsorted(offsets, starts + at, side="right") - 1
        lengths = ends - starts
        one = advanced(np.full(len(starts), START), folded, starts, lengths)
        yield_words = text, ((one ^ START) % np.uint32(buckets)).astype(np.int64)
        left, left_text = np.r_[carried[0], one], np.r_[carried[1], text]
        skip = len(left) - len(one)
        second = np.flatnonzero(left_text[1:] == left_text[:-1]) + 1
        spaced = CRC[(left[second - 1] ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (left[second - 1] >> np.uint32(8))
        two = advanced(spaced, folded, starts[second - skip], lengths[second - skip])
        yield *yield_words, left_text[second], ((two ^ START) % np.uint32(buckets)).astype(np.int64)
        carried = left[-1:], left_text[-1:]
        at = stop


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow column of texts; nulls are empty."""
    text = column.cast(pa.large_binary()).fill_null(b"")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    return np.frombuffer(text.buffers()[2] or b"", np.uint8), offsets


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, one, _, two in features(*utf8_parts(batch.column(0)), buckets):
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["bucket", "n"])

    return texts.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths: the log of its smoothed share of the target over that of the source.

    ``source`` and ``target`` hold counts (bucket, n); one number a bucket comes to the driver.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, out in ((source, s), (target, t)):
        for r in counts.collect():
            out[r.bucket] = r.n
    share_s, share_t = (s + 1.0) * float(t.sum() + buckets), (t + 1.0) * float(s.sum() + buckets)
    return np.array([math.floor(1000 * math.log(x)) for x in (share_t / share_s).tolist()], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from the SHA-256 of seed:doc_id; a null doc_id counts as the text 'null'."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row: the floored mean gain of its features, and that plus noise."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            n, parts = batch.num_rows, utf8_parts(batch.column(1))
            words, pairs, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, one, j, two in features(*parts, len(gain)):
                words += np.bincount(i, minlength=n)
                pairs += np.bincount(j, minlength=n)
                np.add.at(total, i, gain[one])
                np.add.at(total, j, gain[two])
            count = words + pairs
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            score = weight + np.array([noise(d, seed) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, count, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def drawn(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``rows`` with ``rank`` (from 1): the first floor(percent * N / 100) of N by score, the others null.

    Rows (doc_id, n_features, weight, score). Ties go to the smaller doc_id, null last, and then to fewer features. Ranges of the
    order are sorted each in a task, and a row's rank is its place there after the rows of earlier ranges.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Of this id, the upper bits are the range's and the lower 33 count its rows.
    placed = stored(ranged.withColumn("place", F.monotonically_increasing_id()), "resample-order")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a range
    total, starts = 0, []
    for r in sorted(sizes):
        starts.append((r.part, total))
        total += r.n
    table = placed.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    table = F.broadcast(table) if len(starts) <= BROADCAST_ROWS else table
    rank = F.col("start") + inside + 1
    return placed.withColumn("part", part).join(table, "part").withColumn("rank", F.when(rank <= percent * total // 100, rank)).drop("part", "start", "place")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if it isn't drawn).

    Statistics come from all texts of ``docs`` and of ``target``; those of ``least`` words or more take part in the draw. Null and
    empty texts have no words and weight 0. Repeated rows get the same weight and score and are drawn each. An empty
    table gives an empty result; without a target, all gains come from the source alone. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, "text", buckets), bucket_counts(target, "text", buckets), buckets)
    rows = stored(scores(docs, gains, seed), "resample-scores")
    columns = ["doc_id", "n_features", "weight", "score"]
    chosen = drawn(rows.filter(F.col("n_words") >= least).select(*columns), percent)
    short = rows.filter(F.col("n_words") < least).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return chosen.select(*columns, "rank").unionByName(short)

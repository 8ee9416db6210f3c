"""Toxicity by a factorization machine over hashed terms: pairwise interactions on top of additive weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vexel.llm.common import fresh, mapped, released
from vexel.llm.features import hashed_terms, list_parts


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the labelled rows that are fitted (those with the least hash of doc_id) and ``sample_chars`` their length.

    Terms enter the fit if ``least`` labelled documents have them and their share of toxic ones is ``z`` standard
    deviations from the share of all, or if a pair that they form is in ``pair_least`` documents of which ``pair_rows`` are
    looked at, and whose share of toxic ones is ``pair_z`` standard deviations from what the shares of both terms add up
    to. Of these documents, a quarter are toxic if there are that many.
    """

    bits: int = 18
    prefixes: tuple[int, ...] = (4, 5)
    rank: int = 4
    epochs: int = 20
    rate: float = 0.3
    decay: float = 1e-5
    least: int = 3
    z: float = 3.0
    pair_least: int = 5
    pair_z: float = 6.0
    pair_rows: int = 4_000
    sample: int = 20_000
    sample_chars: int = 50_000
    seed: int = 7
    threshold: float = 0.7


#: Terms of partners that are counted at once.
COUNTED = 1 << 20
#: (bias, weight of each term, factors of each term)
Model = tuple[float, np.ndarray, np.ndarray]


def probabilities(model: Model, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of each document, whose terms are values[offsets[i]:offsets[i + 1]]."""
    bias, w, v = model
    told = (w != 0)[values]
    offsets = np.r_[0, np.cumsum(told)][offsets]
    values = values[told]
    factors = v[values]
    terms = np.concatenate([w[values, None], factors, factors ** 2], axis=1)
    ends = np.vstack([np.zeros((1, terms.shape[1])), np.cumsum(terms, axis=0, dtype=np.float64)])
    sums = ends[offsets[1:]] - ends[offsets[:-1]]
    k = v.shape[1]
    n = np.maximum(1, offsets[1:] - offsets[:-1])
    logit = bias + sums[:, 0] + 0.5 * (sums[:, 1:k + 1] ** 2 - sums[:, k + 1:]).sum(axis=1) / np.sqrt(n)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def telling(values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, p: Params) -> np.ndarray:
    """Which terms stand out between the labels, alone or together with another."""
    size, owner = 1 << p.bits, np.repeat(np.arange(len(labels)), np.diff(offsets))
    toxic, seen = np.bincount(values, labels[owner], size), np.bincount(values, minlength=size)
    share = labels.mean() if len(labels) else 0.5
    expected = seen * share
    alone = (seen >= p.least) & (np.abs(toxic - expected) > p.z * np.sqrt(np.maximum(expected * (1 - share), 1e-9)))
    if not 0 < share < 1:
        return alone
    rng = np.random.default_rng(p.seed)
    bad, good = (rng.permutation(np.flatnonzero(labels > 0)), rng.permutation(np.flatnonzero(labels <= 0)))
    bad = bad[:max(p.pair_rows // 4, p.pair_rows - len(good))]
    some = np.sort(np.r_[bad, good[:p.pair_rows - len(bad)]])
    count = np.diff(offsets)[some]
    inner = np.arange(count.sum()) + np.repeat(offsets[some] - np.cumsum(count) + count, count)
    return alone | interacting(values[inner], np.r_[0, np.cumsum(count)], labels[some], alone, p)


def interacting(values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, alone: np.ndarray, p: Params) -> np.ndarray:
    """Which of the terms that aren't telling ``alone`` form a pair whose share of toxic documents its terms don't explain.

    All pairs are counted, those of one term at a time.
    """
    found, owner = np.zeros(len(alone), bool), np.repeat(np.arange(len(labels)), np.diff(offsets))
    toxic, seen = np.bincount(values, labels[owner], len(alone)), np.bincount(values, minlength=len(alone))
    terms = np.flatnonzero(seen >= p.pair_least)
    place = np.full(len(seen), -1, np.int32)
    place[terms] = np.arange(len(terms))
    values = place[values]
    kept = values >= 0
    offsets = np.r_[0, np.cumsum(kept)][offsets]
    values = values[kept]
    docs = np.repeat(np.arange(len(labels)), np.diff(offsets))[np.argsort(values, kind="stable")]
    stops = np.cumsum(np.bincount(values, minlength=len(terms)))
    share = labels.mean()
    own = (toxic[terms] + share) / (seen[terms] + 1)
    pull = np.log(own / (1 - own)) - np.log(share / (1 - share))

    def partners(some: np.ndarray) -> np.ndarray:
        """How many of some documents have each term."""
        out = np.zeros(len(terms), np.int64)
        ends = np.cumsum(offsets[some + 1] - offsets[some])
        at = 0
        while at < len(some):
            upto = max(at + 1, int(np.searchsorted(ends, COUNTED + (ends[at - 1] if at else 0), side="right")))
            out += np.bincount(np.concatenate([values[offsets[d]:offsets[d + 1]] for d in some[at:upto]]), minlength=len(terms))
            at = upto
        return out

    for i in np.flatnonzero(~alone[terms]):
        some = docs[stops[i - 1] if i else 0:stops[i]]
        both = partners(some)
        both[i] = 0
        other = np.flatnonzero(both >= p.pair_least)
        bad = partners(some[labels[some] > 0])[other]
        chance = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + pull[i] + pull[other])))
        expected = both[other] * chance
        found[terms[i]] = (np.abs(bad - expected) > p.pair_z * np.sqrt(expected * (1 - chance))).any()
    return found


def fit(values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, p: Params) -> Model:
    """AdaGrad over minibatches of documents. Terms that say nothing of the label, alone or in a pair, keep weight zero."""
    rng = np.random.default_rng(p.seed)
    size = 1 << p.bits
    terms = np.flatnonzero(telling(values, offsets, labels, p))
    place = np.full(size, -1)
    place[terms] = np.arange(len(terms))
    values = place[values]
    kept = values >= 0
    offsets = np.r_[0, np.cumsum(kept)][offsets]
    values = values[kept]
    # Column 0 is the weight, the others are the factors.
    x = np.zeros((p.rank + 1, len(terms)))
    x[1:] = rng.normal(0, 0.01, (p.rank, len(terms)))
    g = np.full(x.shape, 1e-2)
    g[0] = 1e-3
    rates = np.r_[p.rate, np.full(p.rank, 0.3 * p.rate)]
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    bias, gb = float(np.log(share / (1 - share))), 1e-2
    docs = len(labels)
    for _ in range(p.epochs):
        for batch in np.array_split(rng.permutation(docs), max(1, docs // 64)):
            count = offsets[batch + 1] - offsets[batch]
            begin = np.cumsum(count) - count
            owner = np.repeat(np.arange(len(batch)), count)
            t = values[np.arange(len(owner)) + (offsets[batch] - begin)[owner]]
            n = np.sqrt(np.maximum(1, count))
            vt = x[1:, t]
            sums = np.stack([np.bincount(owner, c, len(batch)) for c in vt])
            squares = np.bincount(owner, (vt ** 2).sum(axis=0), len(batch))
            logit = bias + np.bincount(owner, x[0, t], len(batch)) + 0.5 * ((sums ** 2).sum(axis=0) - squares) / n
            err = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]
            seen = np.flatnonzero(np.bincount(t, minlength=len(terms)))
            step = (err / n / len(batch))[owner] * (sums[:, owner] - vt)
            d = np.stack([np.bincount(t, c, len(terms))[seen] for c in [(err / len(batch))[owner], *step]]) + p.decay * x[:, seen]
            db = err.mean()
            g[:, seen] += d ** 2
            gb += db ** 2
            x[:, seen] -= rates[:, None] * d / np.sqrt(g[:, seen])
            bias -= p.rate * db / np.sqrt(gb)
    w, v = np.zeros(size, np.float32), np.zeros((size, p.rank), np.float32)
    w[terms], v[terms] = x[0], x[1:].T
    return bias, w, v


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null doc_id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, p: Params) -> Model:
    """Fits on at most p.sample labelled rows that are not held out; without any, every score is one half.

    Where all of these are longer than p.sample_chars, the shortest are taken, as long as their characters stay within p.sample
    times p.sample_chars, and one at least.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    found = labelled_terms(docs.filter(F.length("text") <= p.sample_chars), marks, p)
    if not found.num_rows:
        # Of p.sample rows at most.
        upto = Window.orderBy("n", "doc_id")
        sized = docs.filter("text is not null").select("doc_id", F.length("text").alias("n")).join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.max("n").alias("n"))
        few = sized.withColumns({"all": F.sum("n").over(upto), "place": F.row_number().over(upto)}).filter((F.col("place") == 1) | (F.col("all") <= p.sample * p.sample_chars))
        found = labelled_terms(docs, marks.join(F.broadcast(few.select("doc_id")), "doc_id"), p)
    if not found.num_rows:
        return 0.0, np.zeros(1 << p.bits, np.float32), np.zeros((1 << p.bits, p.rank), np.float32)
    values, offsets = list_parts(found.column("t").combine_chunks())
    model = fit(values, offsets, found.column("y").to_numpy(), p)
    del found, values, offsets
    released()
    return model


def labelled_terms(docs: DataFrame, marks: DataFrame, p: Params) -> pa.Table:
    """(doc_id, y, t): the label and terms of the documents of ``marks``, of a bounded number; of rows of one doc_id, those of the text of the least hash."""
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    rows = rows.select("doc_id", F.col("_toxic").cast("double").alias("y"), F.xxhash64("text").alias("h"), hashed_terms(F.col("text"), p.bits, p.prefixes).alias("t"))
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("t", "h").alias("t"))
    return rows.toArrow().combine_chunks().sort_by("doc_id")


def scored(docs: DataFrame, labels: DataFrame, p: Params = Params(), score_name: str = "score") -> DataFrame:
    """``docs`` with a score (0 to 1, double) in a column of that name, which is replaced if there is one.

    Only the text enters a score, so repeated rows score alike. Null and empty texts have no terms and get the score of the
    bias alone. Other columns may have any name.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))
    kept = docs.drop(score_name)
    terms = kept.withColumn(fresh(docs, "terms")[0], hashed_terms(F.col("text"), p.bits, p.prefixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = list_parts(batch.column(batch.num_columns - 1))
            score = probabilities(model.value, values, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [f"c{i}" for i in range(batch.num_columns)])

    return mapped(terms, run, T.StructType([*kept.schema.fields, T.StructField(score_name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = scored(docs.select("doc_id", "text"), labels, p)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def inoffensive(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with the columns of ``docs``, whatever their names.

    Null and empty texts have the score of the bias alone and stay; repeated rows stay or go together.
    """
    score = fresh(docs, "toxicity_score")[0]
    return scored(docs, labels, p, score).filter(F.col(score) < p.threshold).drop(score)

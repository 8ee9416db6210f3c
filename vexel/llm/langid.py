"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vexel.llm.common import fresh, mapped


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the rows that are fitted (those with the least hash of doc_id) and ``sample_chars`` their length."""

    bits: int = 16
    orders: tuple[int, ...] = (2, 3, 4)
    dim: int = 16
    #: Minibatches, whatever the size of the sample.
    steps: int = 600
    rate: float = 2.0
    batch: int = 16
    sample: int = 2_500
    sample_chars: int = 20_000
    seed: int = 11
    #: Share of the sample on which the temperature and the rejection threshold are set.
    calibration: float = 0.2
    #: Accepted predictions are meant to be wrong at most this often.
    wrong: float = 0.01


#: Bytes scored at once.
BLOCK = 1 << 19
#: A-Z become a-z; ASCII that is no letter becomes a space, which marks the ends of words; other bytes stay.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def subwords(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The hash of the ``order`` folded bytes from each place on."""
    n = max(0, len(data) - order + 1)
    h = np.full(n, order, np.uint32)
    for i in range(order):
        h = (h ^ data[i:i + n]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def means(table: np.ndarray, data: np.ndarray, offsets: np.ndarray, p: Params) -> np.ndarray:
    """The mean over the subwords of each text data[offsets[i]:offsets[i + 1]] of their rows in ``table``."""
    docs, width = len(offsets) - 1, table.shape[1]
    sums, counts = np.zeros((docs, width)), np.zeros(docs)
    start, stop = offsets[:-1], offsets[1:]
    for at in range(0, int(offsets[-1]), BLOCK):
        upto = min(at + BLOCK, int(offsets[-1]))
        folded = FOLD[data[at:min(upto + max(p.orders), int(offsets[-1]))]]
        first, last = np.searchsorted(stop, at, side="right"), np.searchsorted(start, upto, side="left")
        for order in p.orders:
            part = table[subwords(folded, order, p.bits)]
            ends = np.vstack([np.zeros((1, width)), np.cumsum(part, axis=0, dtype=np.float64)])
            lo = np.minimum(np.clip(start[first:last], at, upto) - at, len(part))
            hi = np.maximum(np.minimum(np.minimum(stop[first:last] - order + 1, upto) - at, len(part)), lo)
            sums[first:last] += ends[hi] - ends[lo]
            counts[first:last] += hi - lo
    return sums / np.maximum(counts, 1)[:, None]


def logits(model: Model, data: np.ndarray, offsets: np.ndarray, p: Params) -> np.ndarray:
    """The logits of texts: their mean embedding times the softmax weights."""
    return means(model.table, data, offsets, p) @ model.weights + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Without more languages than dimensions, ``table`` holds the products with the softmax weights, which are narrower."""

    langs: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def fit(texts: list[bytes], labels: np.ndarray, langs: list[str], p: Params) -> Model:
    """SGD over minibatches; embeddings and softmax weights learn together. The last part of the sample calibrates."""
    rng = np.random.default_rng(p.seed)
    size, classes = 1 << p.bits, len(langs)
    bags = []
    for t in texts:
        folded = FOLD[np.frombuffer(t, np.uint8)]
        ids, n = np.unique(np.concatenate([subwords(folded, o, p.bits) for o in p.orders]), return_counts=True)
        bags.append((ids, n / max(1, n.sum())))
    order = rng.permutation(len(texts))
    held = int(len(order) * p.calibration)
    learn, check = order[held:], order[:held]
    e, w, bias = rng.normal(0, 1 / p.dim, (size, p.dim)), np.zeros((p.dim, classes)), np.zeros(classes)
    step = 0
    while step < p.steps and len(learn):
        for batch in np.array_split(rng.permutation(learn), max(1, -(-len(learn) // p.batch))):
            ids = np.concatenate([bags[i][0] for i in batch])
            share = np.concatenate([bags[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(bags[i][0]) for i in batch])
            mean = np.stack([np.bincount(owner, e[ids, k] * share, len(batch)) for k in range(p.dim)], axis=1)
            err = softmax(mean @ w + bias)
            err[np.arange(len(batch)), labels[batch]] -= 1
            rate = p.rate * max(0.0, 1 - step / p.steps) / len(batch)
            back = err @ w.T
            w -= rate * mean.T @ err
            bias -= rate * err.sum(axis=0)
            np.add.at(e, ids, -rate * 50 * share[:, None] * back[owner])
            step += 1
    weights = e @ w
    raw = np.stack([(weights[bags[i][0]] * bags[i][1][:, None]).sum(axis=0) + bias for i in check]) if held else np.zeros((0, classes))
    temperature, threshold = 1.0, 0.0
    if held:
        true = labels[check]
        grid = np.geomspace(0.2, 5, 30)
        loss = [-np.log(np.maximum(softmax(raw / t)[np.arange(held), true], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        prob = softmax(raw / temperature)
        best, right = prob.max(axis=1), prob.argmax(axis=1) == true
        place = np.argsort(-best)
        wrong = np.cumsum(~right[place]) / np.arange(1, held + 1)
        fine = np.flatnonzero(wrong <= p.wrong)
        threshold = float(best[place][fine[-1]]) if len(fine) else 1.0
    narrow = classes <= p.dim
    return Model(langs, (weights if narrow else e).astype(np.float32), np.eye(classes) if narrow else w, bias, temperature, threshold)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null doc_id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, p: Params) -> Model | None:
    """Fits on at most p.sample rows of known language and of at most p.sample_chars characters; None without any.

    Where there are fewer such rows, the shortest of the longer ones are taken as well, as long as the characters of all stay
    within p.sample times p.sample_chars, and one at least.
    """
    fits = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sized = fits.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    over = F.greatest("n", F.lit(p.sample_chars))
    chosen = sized.orderBy(over, F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    # Of p.sample rows.
    upto = Window.orderBy(over, F.xxhash64("doc_id"), "doc_id")
    chosen = chosen.withColumns({"all": F.sum("n").over(upto), "place": F.row_number().over(upto)}).filter((F.col("place") == 1) | (F.col("all") <= p.sample * p.sample_chars)).select("doc_id")
    rows = fits.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "lang", "text")).alias("s")).select("doc_id", "s.lang", "s.text")
    found = rows.toArrow().combine_chunks().sort_by("doc_id")
    if not found.num_rows:
        return None
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    return fit([t.encode() for t in found.column("text").to_pylist()], np.array([langs.index(x) for x in names]), langs, p)


def predictions(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (calibrated, 0 to 1) and ``accepted`` (the score reaches the rejection threshold).

    Only the text enters a prediction. Null texts, and texts without a letter, get 'und', score 0 and are not accepted;
    so do all where there is nothing to learn from. Repeated rows get the same. Columns of these names are replaced; others
    may have any name.
    """
    model = train(docs, p)
    kept = docs.drop("lang_pred", "score", "accepted")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "accepted": F.lit(False)})
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        for batch in batches:
            text = batch.column(place).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(text) else np.zeros(0, np.uint8)
            prob = softmax(logits(model, data, offsets - offsets[0], p) / model.temperature)
            best, has = prob.max(axis=1), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            pred = [model.langs[k] if h else "und" for k, h in zip(prob.argmax(axis=1).tolist(), has.tolist())]
            score = np.where(has, best, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred), pa.array(score), pa.array(has & (score >= model.threshold))], [f"c{i}" for i in range(batch.num_columns + 2)])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return mapped(kept.withColumn(fresh(kept, "letters")[0], letters), run, T.StructType([*kept.schema.fields, *more]))


def languages(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted."""
    rows = predictions(docs.select("doc_id", "lang", "text"), p)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")

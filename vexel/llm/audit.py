"""Filter interaction audit over a packed bitmap index.

Each task packs its rows into bitsets, one a filter (rows that fail it), one a label and one for the rows themselves. Rows
stand sorted by their part, and each part's run is filled up to whole words, so the bitset of a part is a slice and any
number of parts takes no more room than the rows do. For each subset of the filters, that is each prefix of an order
of them, the rows left are the AND-NOT of all rows and the subset's bitsets; popcounts of these, alone and within each label,
are all that leaves a task. Whatever an order of the filters keeps, removes or loses is a difference of these counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import key_join, stored

#: Filters at most: orders grow with their factorial.
MOST_FILTERS = 6
#: Rows that are packed together.
BLOCK_ROWS = 1 << 20
#: Words of a text below which filter A fails it; percentages of filters B and C.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SIGNS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of UTF-8 that begin no code point.
TAILS = bytes(range(0x80, 0xC0))
FILTERS, LABELS = "ABCDE", ("quality", "toxic")


def packed_runs(parts: np.ndarray, flags: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(distinct parts, bitsets as words of 64, first word of each part): rows are sorted by ``parts``, each part's run filled up to whole words with zeros."""
    order = np.argsort(parts, kind="stable")
    found, first, counts = np.unique(parts[order], return_index=True, return_counts=True)
    words = -(-counts // 64)
    starts = np.cumsum(words) - words
    place = np.arange(len(parts)) + np.repeat(64 * starts - first, counts)
    out = []
    for flag in flags:
        bits = np.zeros(64 * int(words.sum()), np.uint8)
        bits[place] = flag[order]
        out.append(np.packbits(bits).view(np.uint64))
    return found, out, starts


def subset_counts(parts: np.ndarray, fails: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct parts, counts): counts[p, s, 0] rows of part p that fail no filter of subset s (a bit a filter), counts[p, s, 1 + l] those that also have label l."""
    found, bitsets, starts = packed_runs(parts, [np.ones(len(parts), bool), *fails, *labels])
    failing, marked = bitsets[1:1 + len(fails)], bitsets[1 + len(fails):]
    counts = np.zeros((len(found), 1 << len(fails), 1 + len(labels)), np.int64)
    left: dict[int, np.ndarray] = {0: bitsets[0]}
    for s in range(1 << len(fails)):
        if s:
            f = s.bit_length() - 1
            left[s] = left[s ^ (1 << f)] & ~failing[f]
        for i, words in enumerate((left[s], *(left[s] & m for m in marked))):
            counts[:, s, i] = np.add.reduceat(np.bitwise_count(words).astype(np.int64), starts)
    return found, counts


def interaction_counts(rows: DataFrame, part: str, fails: list[str], labels: list[str]) -> DataFrame:
    """(part, subset, n, label counts...): for each value of ``part`` and subset of the filters, the rows that fail none of these.

    ``fails`` and ``labels`` name boolean columns of ``rows``; null counts as false, and a null part as the empty string. Bit i
    of ``subset`` stands for fails[i]; the count of label i is named m<i>. An empty table gives no rows. Repeated rows
    count each.
    """
    if not 1 <= len(fails) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    names = ["part", "subset", "n", *[f"m{i}" for i in range(len(labels))]]
    no = F.lit(False)
    flags = [F.coalesce(F.col(f"`{c}`").cast("boolean"), no).alias(f"f{i}") for i, c in enumerate([*fails, *labels])]
    narrow = rows.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), *flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        held: list[pa.RecordBatch] = []

        def count() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            coded = table.column("part").combine_chunks().dictionary_encode()
            values = [table.column(i + 1).to_numpy() for i in range(len(fails) + len(labels))]
            found, counts = subset_counts(coded.indices.to_numpy(), values[:len(fails)], values[len(fails):])
            for p, c in zip(found.tolist(), counts):
                name = coded.dictionary[p].as_py()
                total[name] = total[name] + c if name in total else c
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                count()
        if held:
            count()
        for name, c in total.items():
            columns = [pa.array([name] * len(c)), pa.array(np.arange(len(c), dtype=np.int32)), *[pa.array(c[:, i]) for i in range(c.shape[1])]]
            yield pa.RecordBatch.from_arrays(columns, names)

    counted = narrow.mapInArrow(run, "part string, subset int, " + ", ".join(f"{n} bigint" for n in names[2:]))
    return counted.groupBy("part", "subset").agg(*[F.sum(n).alias(n) for n in names[2:]])


def order_report(counts: DataFrame, letters: str, labels: int = 2) -> DataFrame:
    """A row for each part, order of the filters and step: what ``interaction_counts`` says of it.

    ``letters`` names the filters, bit by bit. Columns: part, filter_order, step (from 1), kept, removed, redundant,
    unique_fails, lost<i> for each label, shapley. A part holds 2**filters counts, so its rows come from one array.
    """
    n = len(letters)
    every = (1 << n) - 1
    by_part = counts.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("subset", "n", *[f"m{i}" for i in range(labels)]))), lambda x: x).alias("c"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    # The place of a subset in the array is its number.
    of = lambda s, field: F.get("c", s)[field]
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), (F.instr(F.lit(letters), letter) - 1).cast("int"))
    rows = by_part.select("part", "c", F.explode(orders).alias("filter_order"))
    rows = rows.select("part", "c", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    letter = lambda i: F.substring(F.col("filter_order"), i, F.lit(1))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda s, i: s + F.when(i < F.col("step"), bit(letter(i))).otherwise(0))
    rows = rows.select("part", "c", "filter_order", "step", before.alias("s"), bit(letter(F.col("step"))).alias("f"))
    factorial = lambda k: F.get(F.array(*[F.lit(int(np.prod(np.arange(1, i + 1)))) for i in range(n + 1)]), k)
    others = F.filter(F.sequence(F.lit(0), F.lit(every)), lambda s: s.bitwiseAND(F.col("f")) == 0)
    # A subset stands before a filter in as many orders as it and the rest can be arranged.
    shapley = F.aggregate(others, F.lit(0).cast("bigint"), lambda t, s: t + factorial(F.bit_count(s).cast("int")) * factorial((F.lit(n - 1) - F.bit_count(s)).cast("int")) * (of(s, "n") - of(s + F.col("f"), "n")))
    after = F.col("s") + F.col("f")
    rest = F.lit(every) - F.col("f")
    removed = of(F.col("s"), "n") - of(after, "n")
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), of(after, "n").alias("kept"), removed.alias("removed"),
        (of(F.lit(0), "n") - of(F.col("f"), "n") - removed).alias("redundant"), (of(rest, "n") - of(F.lit(every), "n")).alias("unique_fails"),
        *[(of(F.col("s"), f"m{i}") - of(after, f"m{i}")).alias(f"lost{i}") for i in range(labels)], shapley.alias("shapley"))


def text_failures(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Whether a text fails A (few words), B (few distinct words), C (many capitals) and D (signs)."""
    words = text.split()  # of bytes: between the ASCII spaces \x20 and \x09 to \x0D
    points = len(text.translate(None, TAILS))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * capitals > CAPITAL_PERCENT * points, len(text) != len(text.translate(None, SIGNS))


def document_flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, tkey, A, B, C, D) of every row; tkey is the MD5 of its text. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails = np.array([text_failures(t.as_py()) for t in batch.column(3)], bool).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(fails[:, i]) for i in range(4)]], ["doc_id", "part", "tkey", *"ABCD"])

    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.md5(data).alias("tkey"), data.alias("data"))
    return rows.mapInArrow(run, "doc_id bigint, part string, tkey string, A boolean, B boolean, C boolean, D boolean")


def marked_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, quality, toxic) of every row of ``docs``.

    E: another row with a smaller doc_id has the same text. A text's first doc_id is joined by both, so that a text of very
    many rows never meets in a task. A null doc_id is no smaller than any, and none is smaller than it. A document has a
    label if any row of ``labels`` with its doc_id says 1.
    """
    rows = stored(document_flags(docs), "audit-flags")
    no = F.lit(False)
    first = rows.filter("doc_id is not null").groupBy("tkey").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), no).alias(c) for c in LABELS])
    known = rows.filter("doc_id is not null").join(first, ["doc_id", "tkey"], "left").withColumn("E", F.col("first").isNull())
    known = key_join(known, marks, "doc_id", [F.col("tkey")])
    unknown = rows.filter("doc_id is null").withColumns({"E": no, **{c: no for c in LABELS}})
    columns = ["part", *FILTERS, *LABELS]
    return known.select(*columns).unionByName(unknown.select(*columns))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``: a row for each language, order and step.

    Null and empty texts have no words and fail A alone, and each but the first fails E. Repeated rows count each; those of
    one doc_id don't make each other copies. A null lang is the part ''. An empty table gives no rows. Other columns
    are not read.
    """
    counts = interaction_counts(marked_documents(docs, labels), "part", list(FILTERS), list(LABELS))
    return order_report(counts, FILTERS).withColumnsRenamed({"lost0": "good_lost", "lost1": "toxic_lost"})

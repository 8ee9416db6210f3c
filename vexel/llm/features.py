"""Hashed features of texts: words and their beginnings, computed by Spark and handed to numpy as Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = r"\p{L}+"


def hashed_terms(text: Column, bits: int, prefixes: tuple[int, ...]) -> Column:
    """The distinct hashed terms of a text: its lower-cased words and, of longer words, the first letters. Null: none."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS), F.lit(0)))
    size = F.lit(1 << bits)

    def number(kind: int, term: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(kind), term), size).cast("int")

    parts = [F.transform(words, lambda w: number(0, w))]
    for n in prefixes:
        stems = F.array_distinct(F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.substring(w, 1, n)))
        parts.append(F.transform(stems, lambda w, n=n: number(n, w)))
    return F.array_distinct(F.concat(*parts))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an Arrow list column without nulls, offsets from 0."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return values, offsets - offsets[0]

"""Column builders for distances, bit vectors and look-up tables; all stay within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def words(bits: Column, count: int) -> Column:
    """ARRAY<BIGINT> of an array of ``count`` numbers 0 or 1: 64 a word, the first one highest, the last word filled up with zeros."""
    zero = F.lit(0).cast("bigint")
    one = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda s, i: F.shiftleft(s, 1).bitwiseOR(F.coalesce(F.get(bits, w * 64 + i).cast("bigint"), zero)))
    return F.when(F.size(bits) > 0, F.transform(F.sequence(F.lit(0), F.lit((count - 1) // 64)), one)).otherwise(F.array().cast("array<bigint>"))


def sign_bits(v: Column) -> Column:
    """The sign bits (1 where positive) of a vector of any length as words of 64, the first dimension highest."""
    zero = F.lit(0).cast("bigint")
    signs = lambda part: F.aggregate(part, zero, lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))
    whole = F.transform(F.sequence(F.lit(0), F.greatest((F.size(v) - 1).cast("int"), F.lit(0)), F.lit(64)), lambda at: F.call_function("shiftleft", signs(F.slice(v, at + 1, 64)), F.greatest(F.lit(64) - F.size(v) + at, F.lit(0)) % 64))
    return F.when(F.size(v) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _counted(a: Column, b: Column, both) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(both(x, y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Hamming distance of two bit vectors of equally many words."""
    return _counted(a, b, lambda x, y: x.bitwiseXOR(y))


def hamming_part(a: Column, b: Column, first: int, count: int) -> Column:
    """Hamming distance over the bits ``first`` to ``first + count - 1``, counted from the highest bit of the first word."""
    out = F.lit(0).cast("bigint")
    for w in range(first // 64, (first + count - 1) // 64 + 1):
        lo, hi = max(first, 64 * w) - 64 * w, min(first + count, 64 * w + 64) - 64 * w
        mask = ((1 << (hi - lo)) - 1) << (64 - hi)
        mask = F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("bigint")
        out = out + F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w))).bitwiseAND(mask)).cast("bigint")
    return out


def parts_of(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``parts`` parts of nearly equal length."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def jaccard(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b|; 0 for two empty sets."""
    union = _counted(a, b, lambda x, y: x.bitwiseOR(y))
    return F.when(union == 0, 0.0).otherwise(1 - _counted(a, b, lambda x, y: x.bitwiseAND(y)) / union)


def subspace(v: Column, s: int | Column, size: int) -> Column:
    return F.slice(v, s * size + 1, size)


def prev_pow2(x: Column) -> Column:
    """The largest power of two up to |x| as an integer; below 1: 0."""
    return F.when(F.abs(x) >= 1, F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))))).otherwise(0).cast("int")


def padded(v: Column, size: int) -> Column:
    """Zeros appended up to ``size`` dimensions."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(v), F.lit(0))))


def pack(codes: Column, bits: list[int]) -> Column:
    """Codes of ``bits`` bits each, end to end from the highest bit of the first word, as ARRAY<BIGINT>; a code may straddle words."""
    single = F.flatten(F.zip_with(codes, F.array(*[F.lit(n) for n in bits]), lambda c, n: F.transform(F.filter(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda b: n > 0), lambda b: F.call_function("getbit", c.cast("bigint"), b).cast("bigint"))))
    return words(single, sum(bits))

"""Sharding by jump consistent hashing: no ring table, and one more shard takes rows only into itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The multiplier of the published generator (key * 2862933555777941757 + 1) in 32-bit halves.
MULT_HI, MULT_LO = 0x27BB2EE6, 0x87B0B0FD
LOW32 = 0xFFFFFFFF
#: Jumps follow a harmonic law (14 are expected for a million shards); a key that needs more than this raises an error.
MAX_JUMPS = 192
#: Hexadecimal digits of an MD5 that name the sub-bucket of a shard (16**3 of them) within which slots are numbered.
SLOT_DIGITS = 3


def key_halves(key: Column) -> tuple[Column, Column]:
    """The first 64 bits of the key's MD5 as two unsigned 32-bit halves. A null key is the key 'null'."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))

    def half(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")

    return half(1), half(9)


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULT + 1 modulo 2**64; all partial products stay under 2**63, so ANSI mode can't overflow."""
    low = (lo.bitwiseAND(0xFFFF)) * F.lit(MULT_LO) + F.lit(1)
    high = F.shiftright(lo, 16) * F.lit(MULT_LO)
    t = low + F.shiftleft(high.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(t, 32) + F.shiftright(high, 16)
    hi_lo = (hi.bitwiseAND(0xFFFF)) * F.lit(MULT_LO) + F.shiftleft((F.shiftright(hi, 16) * F.lit(MULT_LO)).bitwiseAND(0xFFFF), 16)
    return (carry + lo * F.lit(MULT_HI) % F.lit(1 << 32) + hi_lo).bitwiseAND(LOW32), t.bitwiseAND(LOW32)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards`` - 1) of ``key``: each draw jumps to the next shard count at which the key would move."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    hi, lo = key_halves(key)
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(s: Column, _: Column) -> Column:
        new_hi, new_lo = _next_state(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + 1).cast("double")))
        moved = F.struct(new_hi.alias("hi"), new_lo.alias("lo"), s["j"].alias("b"), jump.cast("bigint").alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    rounds = F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS)))
    end = F.aggregate(rounds, start, step, lambda s: F.struct(s["b"].alias("b"), s["j"].alias("j")))
    shard = end["b"].cast("int")
    return shard if shards <= MAX_JUMPS else F.when(end["j"] >= F.lit(shards), shard).otherwise(F.raise_error(F.lit("too many jumps")).cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (with one shard more). A narrow projection: nothing is shuffled.

    A null key counts as the string 'null'; equal keys share a shard. Columns named shard and grown_shard are replaced.
    """
    return df.withColumn("shard", jump_hash(F.col(key), shards)).withColumn("grown_shard", jump_hash(F.col(key), shards + 1))


def _bucket(order: list[str]) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order]).cast("binary"))
    return F.conv(F.substring(digest, 1, SLOT_DIGITS), 16, 10).cast("int")


def number_slots(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each ``shard``. ``df`` holds ``shard``, the ``order`` columns and others.

    Repeated rows are counted before the shuffle and spread out again at the end, so no window holds more than the
    distinct rows of one sub-bucket of a shard; buckets follow each other by a table of at most
    shards * 16**SLOT_DIGITS sums.
    """
    cols = df.columns
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", _bucket(order))
    sums = groups.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.withColumn("_upto", F.sum("_n").over(inside)).join(sums, ["shard", "_bucket"])
    first = F.col("_before") + F.col("_upto") - F.col("_n")
    return placed.select(*cols, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null: that of the empty text), shard, slot, grown_shard.

    Rows of one doc_id share a shard, and repeated rows each get a slot; a null doc_id is the key 'null'. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = number_slots(assign_shards(rows, "doc_id", shards), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

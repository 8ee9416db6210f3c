"""Benchmark decontamination by winnowing.

Of every k-gram hash of a text, the least in each sliding window of hashes is kept as a fingerprint. A passage of at
least SPAN words that a document shares with an item has a fingerprint in common with it, whatever surrounds it, so
joining fingerprints finds every such passage; hits are then extended to the passages around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import ascii_lower, key_join, stored

#: What stands between words: ASCII without digits and letters. A-Z are letters here; they are lower-cased word by word.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a shared passage; an item of fewer words is one passage of its own length.
SPAN = 10
#: Benchmark fingerprints are broadcast up to this many rows (of 16 bytes), and joined by a shuffle beyond it.
PRINT_ROWS = 1_000_000
#: Tasks to which a benchmark fingerprint is dealt out where fingerprints aren't broadcast.
SALTS = 64


def words(text: Column) -> Column:
    """The words of a text, in their own case; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _word_hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(ascii_lower(w)))


def _joined(df: DataFrame, name: str, size: int, step) -> tuple[DataFrame, str]:
    """Adds the array whose item i is ``step`` over the items i to i + size - 1 of array ``name``; returns its column's name.

    Runs are put together from runs of half their length, shifted against each other.
    """
    out = f"{name}_{size}"
    if size == 1:
        return df, name
    if out in df.columns:
        return df, out
    first = size // 2 if size % 2 == 0 else size - 1
    df, a = _joined(df, name, first, step)
    df, b = _joined(df, name, size - first, step)
    length = F.greatest(F.size(name) - size + 1, F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(a, 1, length), F.slice(b, first + 1, length), step)), out


def _windows(df: DataFrame, spans: list[int]) -> DataFrame:
    """(key columns, span, start, fp, window) from rows with ``wh``, the hashes of a text's words: a row per passage of ``span`` words.

    For passages of L words, k-grams have k = (L + 1) // 2 words, and the fingerprint of a passage is the least of its
    L - k + 1 k-gram hashes: whatever surrounds the passage, it keeps this fingerprint. Neighbours often share theirs.
    """
    keep = [c for c in df.columns if c != "wh"]
    out = None
    for span in spans:
        k = (span + 1) // 2
        hashed, grams = _joined(df, "wh", k, lambda a, b: F.xxhash64(a, b))
        hashed, full = _joined(hashed, "wh", span, lambda a, b: F.xxhash64(a, b))
        hashed = hashed.select(*keep, F.col(grams).alias("g"), F.col(full).alias("full"))
        hashed, least = _joined(hashed, "g", span - k + 1, lambda a, b: F.least(a, b))
        rows = hashed.select(*keep, F.posexplode(F.arrays_zip(F.col(least).alias("fp"), F.col("full").alias("window"))).alias("start", "p"))
        rows = rows.select(*keep, F.lit(span).alias("span"), "start", "p.fp", "p.window")
        out = rows if out is None else out.unionByName(rows)
    return out


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """((item, span, fp, window), spans): the passages of every item that has words, and their lengths; a null item_id counts as the text 'null'."""
    split = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), _word_hashes(words(F.col("text"))).alias("wh")).filter(F.size("wh") > 0)
    split = stored(split.withColumn("span", F.least(F.size("wh"), F.lit(SPAN))), "winnow-items")
    spans = sorted(r[0] for r in split.select("span").distinct().collect())  # at most SPAN numbers
    out = None
    for span in spans:
        rows = _windows(split.filter(F.col("span") == span).drop("span"), [span]).select("item", "span", "fp", "window")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = split.select("item", "span", F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("window")).limit(0)
    return stored(out.distinct(), "winnow-windows"), spans


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(tkey, start, span, item_list): the passages in the distinct texts of ``docs`` that equal one of an item, with the items that have it.

    A passage is known by two 64-bit hashes, its fingerprint and that of all its words. The words of a text are split and
    hashed once, however many lengths passages have. A passage that very many texts hold is dealt out to several tasks.
    """
    windows, spans = item_windows(benchmark)
    lists = windows.groupBy("span", "fp", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    prints = windows.select("span", "fp").distinct()
    if not spans:
        return docs.select(text_key(F.col("text")).alias("tkey"), F.lit(0).alias("start"), F.lit(0).alias("span"), F.array(F.lit("")).alias("items")).limit(0)
    texts = docs.select(text_key(F.col("text")).alias("tkey"), _word_hashes(words(F.col("text"))).alias("wh"))
    if len(spans) > 1:
        texts = stored(texts, "winnow-words")
    found = _windows(texts, spans)
    if prints.count() <= PRINT_ROWS:
        found = found.join(F.broadcast(prints), ["span", "fp"], "left_semi")
    else:
        # Each text sends a fingerprint once; the passages of those that hit are found in a second pass.
        sent = found.select("tkey", "span", "fp").distinct().withColumn("salt", F.pmod(F.xxhash64("tkey"), F.lit(SALTS)))
        copies = prints.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        hit = sent.join(copies, ["span", "fp", "salt"], "left_semi").drop("salt")
        found = found.join(hit, ["tkey", "span", "fp"], "left_semi")
    passage = F.struct("span", "fp", "window").alias("passage")
    found = stored(found.select("tkey", "start", passage).distinct(), "winnow-hits")
    return key_join(found, lists.select(passage, "items"), "passage", [F.col("tkey"), F.col("start")], "inner").select("tkey", "start", "passage.span", "items")


def text_results(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(tkey, n_hit, n_items, items_sha256) of the texts with hits; each group is what one text holds."""
    found = hits(docs, benchmark)
    by_text = found.groupBy("tkey").agg(F.array_sort(F.collect_set(F.struct("start", "span"))).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("at", zero, lambda s, x: F.struct(
        (s["n"] + F.greatest(x["start"] + x["span"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["start"] + x["span"]).alias("upto")), lambda s: s["n"])
    return by_text.select("tkey", covered.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"))


def with_results(docs: DataFrame, results: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to ``results`` (tkey and other columns) by their texts, without tkey. Columns of these names must be free."""
    return key_join(docs.withColumn("tkey", text_key(F.col("text"))), results, "tkey", [F.col("doc_id")], how).drop("tkey")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): all columns of ``docs`` in one struct, so that no name of theirs can clash."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_hit, n_items, items_sha256 and contaminated; equal texts share one result.

    Null and empty texts have no words and no hits; without items, nothing is contaminated. Repeated rows stay as they
    are. Columns of these names are replaced; other columns may have any name.
    """
    rows = with_results(packed(docs), stored(text_results(docs, benchmark), "winnow-results"), "left")
    kept = [c for c in docs.columns if c not in ("n_hit", "n_items", "items_sha256", "contaminated")]
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in kept], hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                       F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; without items, nothing is contaminated. Equal texts get equal results, and
    repeated rows each their own. An empty table gives an empty result. Other columns are not read.
    """
    n_words = F.size(words(F.col("text"))).cast("bigint")
    rows = docs.select("doc_id", n_words.alias("n_words"), F.coalesce("text", F.lit("")).alias("text"))
    return marked(rows, benchmark).drop("text")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with the columns of ``docs``, whatever their names.

    Null and empty texts stay, and repeated rows stay as often as they come.
    """
    dirty = stored(text_results(docs, benchmark).select("tkey"), "winnow-dirty")
    rows = with_results(packed(docs), dirty, "left_anti")
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])

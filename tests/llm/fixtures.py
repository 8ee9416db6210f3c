"""Small tables with nulls, empty and long texts, repeated rows and columns whose names clash with results."""

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix strange potions in the old stone tower near the river"


def docs(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    if extra:
        from pyspark.sql import functions as F

        for name in ("shard", "slot", "size", "score", "predicted", "lang_pred", "fp", "node", "tkey", "n", "copies", "target", "n_hit", "spans", "component", "rank", "held_out", "_t", "_h", "_id", "_terms", "_letters", "_s", "_n", "_k", "doc", "salt", "salts", "text_hash", "kept_id", "kept_hash",
                     "skey", "times", "one", "taken_id", "tkey_", "terms", "letters", "w", "key", "base", "c", "a.b", "part", "kind", "passage", "bytes", "ids", "weight", "rank.x", "c0", "r0"):
            df = df.withColumn(name, F.lit("x"))
    return df


EDGE = [PROSE, PROSE, None, "", "   ", "\n\t", PROSE + " again", "é" * 50, "word " * 3000, "a" * 5000, "Zürich \U0001F600 ok", PROSE]

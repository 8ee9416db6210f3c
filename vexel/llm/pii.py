"""Personal data: fixed patterns, and identifiers discovered by bootstrapped contextual extraction.

Entities that the fixed patterns find are seeds, and so are tokens that by their shape can hardly be anything but a key.
What stands around them are lexical patterns: the word before, two words before, the words on either side, or the name and
sign within the same token, as in key=value. Together with all identifier-like tokens in these places they form a graph.
Pattern and instance scores are computed from each other in turns, and tokens in the context of patterns of high confidence
are added as spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.llm.common import BROADCAST_ROWS, hot_keys, key_join, removed, spread_join, stored, written


@dataclass(frozen=True)
class Params:
    """``rounds`` of scoring; a pattern counts from a ``confidence`` and the weight of ``support`` seed-like instances on."""

    rounds: int = 3
    confidence: float = 0.8
    support: float = 3.0


KINDS = ("email", "ip", "card", "phone")
# The kinds' expressions, written so that each is linear in the text: possessive where nothing is given back, and with
# a guard that starts a match only where the text before it can't belong to it.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
FOUR_BYTES = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
#: A token with a digit or a sign within a name, or what follows a name and a sign; the name and sign before a value in one token; signs around a value.
TOKEN = r"(?<!\S)(?:[^\s0-9_=@]*+[0-9_=@]\S++|(?<=[=:]\s)\S++|[^\s0-9]*+[0-9])"
NAMED = r"^([A-Za-z_.-]{2,40}[=:][\"']?)(?=.)"
EDGE = r"^[\"'(\[<]+"
TAIL = r"[\"')\]>.,;:!?#$%&*]+$"
#: What is a key by its shape: so many letters, digits and signs of base64 without others, and how many digits and letters at least.
KEY, KEY_DIGITS, KEY_LETTERS = r"^[A-Za-z0-9_-]{32,}$", 8, 4
#: Characters of an instance, at least; characters on either side of a token in which its context is looked for.
LEAST, CONTEXT = 4, 64
#: Matches whose places are summed up together, so that the work grows with their number and not with its square.
CHUNK = 256
PLACED = "array<struct<start:int,end:int,s:string,left:string,right:string>>"
PIECES = "array<struct<gap:int,n:int,s:string,left:string,right:string>>"


def pieces(text: Column, pattern: str) -> Column:
    """array<struct<gap, n, s, left, right>>: the matches of ``pattern`` from left to right with their lengths, and what lies between them.

    ``left`` and ``right`` are the CONTEXT characters, at most, before and after a match, up to its neighbours.
    """
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("gap"), F.slice(gaps, 2, 1 << 30).alias("next"))
    return F.transform(F.filter(zipped, lambda p: p["m"].isNotNull()), lambda p: F.struct(
        F.length(p["gap"]).alias("gap"), F.length(p["m"]).alias("n"), p["m"].alias("s"), F.right(p["gap"], F.lit(CONTEXT)).alias("left"), F.left(p["next"], F.lit(CONTEXT)).alias("right")))


def placed(name: str) -> Column:
    """array<struct<start, end, s, left, right>>: the pieces in column ``name`` with their places in code points; end is exclusive.

    Places within a chunk are counted from its start, and the starts of the chunks are summed up after.
    """
    whole = F.size(name)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((whole - 1) / CHUNK).cast("int")), lambda k: F.slice(name, k * CHUNK + 1, CHUNK))

    def step(s: Column, p: Column) -> Column:
        start = s["pos"] + p["gap"]
        one = F.struct(start.alias("start"), (start + p["n"]).alias("end"), p["s"].alias("s"), p["left"].alias("left"), p["right"].alias("right"))
        return F.struct((start + p["n"]).alias("pos"), F.concat(s["out"], F.array(one)).alias("out"))

    inner = F.transform(chunks, lambda c: F.aggregate(c, F.struct(F.lit(0).alias("pos"), F.array().cast(PLACED).alias("out")), step))
    sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, p: s + p["gap"] + p["n"]))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    moved = F.zip_with(inner, starts, lambda c, at: F.transform(c["out"], lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["s"].alias("s"), m["left"].alias("left"), m["right"].alias("right"))))
    return F.when(whole > 0, F.flatten(F.filter(moved, lambda x: x.isNotNull()))).otherwise(F.array().cast(PLACED))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = d.substr(n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def matched(text: Column) -> dict[str, Column]:
    """The matches of each kind and the tokens; texts without the sign that a kind needs are skipped."""
    some_digit = text.rlike("[0-9]")

    def where(condition: Column, pattern: str) -> Column:
        return F.when(condition, pieces(text, pattern)).otherwise(F.array().cast(PIECES))

    return {"email": where(F.contains(text, F.lit("@")), EMAIL), "ip": where(some_digit & F.contains(text, F.lit(".")), IP), "card": where(some_digit, CARD),
            "phone": where(F.contains(text, F.lit("+")), PHONE), "token": where(text.rlike("[0-9_=@:]"), TOKEN)}


def base_spans() -> dict[str, Column]:
    """The spans of each kind from its matches, which are columns."""
    return {
        "email": placed("email"),
        "ip": F.filter(placed("ip"), lambda m: m["s"].rlike(FOUR_BYTES)),
        "card": F.filter(placed("card"), lambda m: luhn(digits(m["s"]))),
        "phone": F.filter(placed("phone"), lambda m: F.length(digits(m["s"])).between(8, 15)),
    }


def listed(kind: str, spans: Column) -> Column:
    """array<string>: kind:start:end."""
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))


def candidates(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """(tkey, start, end, patterns, instance, seed, known): identifier-like tokens of texts with the contexts they stand in.

    ``tokens`` holds (tkey, start, end, s, left, right), ``base`` (tkey, start, end). A token counts if it holds a digit, an
    underscore, = or @, or stands after a name and = or :, and has LEAST characters without the signs around it. It is
    known if it overlaps a span of ``base``; known tokens and keys are seeds.
    """
    left = F.lower("left")
    # A word, or a name and the sign after it, at the end of what precedes the token, and the word before that.
    parsed = tokens.withColumn("name", F.regexp_extract("s", NAMED, 1)).withColumn("value", F.expr("substr(s, length(name) + 1)")).withColumn("inner", F.regexp_replace("value", EDGE, ""))
    parsed = parsed.withColumn("core", F.regexp_replace("inner", TAIL, "")).withColumn("at", F.col("start") + F.length("name") + F.length("value") - F.length("inner"))
    parsed = parsed.withColumns({"word": F.regexp_extract(left, r"(\S++(?:\s++[=:])?)\s*+[\"'(]?$", 1), "two": F.regexp_extract(left, r"(\S++\s++\S++(?:\s++[=:])?)\s*+[\"'(]?$", 1), "after": F.regexp_extract(F.lower("right"), r"^\s++(\S++)", 1)})
    around = F.array(F.when(F.col("word") != "", F.concat(F.lit("<"), "word")), F.when(F.col("two") != "", F.concat(F.lit("<<"), "two")), F.when((F.col("word") != "") & (F.col("after") != ""), F.concat(F.lit("<>"), "word", F.lit(" "), "after")))
    patterns = F.when(F.col("name") != "", F.array(F.concat(F.lit("="), F.lower("name")))).otherwise(F.array_compact(around))
    n = F.length(digits(F.col("core")))
    key = F.col("core").rlike(KEY) & (n >= KEY_DIGITS) & (F.length("core") - n >= KEY_LETTERS)
    found = parsed.select("tkey", F.col("at").alias("start"), (F.col("at") + F.length("core")).alias("end"), patterns.alias("patterns"), F.col("core").alias("instance"), key.alias("key"))
    found = found.filter((F.size("patterns") > 0) & (F.length("instance") >= LEAST))
    # A token overlaps a span if, of the spans that start before its end, the one that ends last does so after its start.
    events = found.withColumns({"pos": F.col("end"), "upto": F.lit(None).cast("int")}).unionByName(base.select("tkey", F.col("start").alias("pos"), F.col("end").alias("upto")), allowMissingColumns=True)
    before = Window.partitionBy("tkey").orderBy("pos", F.col("upto").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce(F.max("upto").over(before) > F.col("start"), F.lit(False))
    rows = events.withColumn("known", known).filter(F.col("instance").isNotNull())
    return rows.select("tkey", "start", "end", "patterns", "instance", (F.col("known") | F.col("key")).alias("seed"), "known")


def sized(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pattern_scores(edges: DataFrame, p: Params) -> DataFrame:
    """(pattern, score) of the patterns of high confidence, from distinct edges (pattern, instance, seed).

    A pattern's score is the mean score of its instances; an instance that is no seed scores one minus the product of
    one minus the scores of its confident patterns. An instance in many places is dealt out to several tasks.
    """
    by_instance = stored(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("seed"), F.count(F.lit(1)).alias("n")), "pii-instances")
    hot = hot_keys(by_instance, "instance", edges.count())
    lift, good, last = by_instance.select("instance", F.lit(0.0).alias("lift")).limit(0), None, []
    for _ in range(p.rounds):
        scores = by_instance.join(lift, "instance", "left").select("instance", F.greatest("seed", F.coalesce("lift", F.lit(0.0))).alias("s"))
        met = spread_join(edges.select("pattern", "instance"), scores, "instance", hot, [F.col("pattern")])
        by_pattern = met.groupBy("pattern").agg(F.sum("s").alias("weight"), F.count(F.lit(1)).alias("n"))
        good = by_pattern.select("pattern", (F.col("weight") / F.col("n")).alias("score"), "weight").filter((F.col("score") >= p.confidence) & (F.col("weight") >= p.support))
        good, path = written(good.select("pattern", "score"), "pii-patterns")
        lifted = edges.select("pattern", "instance").join(sized(good), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))).alias("lift"))
        lift, lift_path = written(lifted, "pii-lifts")
        for done in last:
            removed(done)
        last = [path, lift_path]
    return good


def found_pii(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_id, spans.

    Null and empty texts have no spans. Equal texts share their spans; repeated rows stay as they are. Discovered spans have
    the kind ``id`` and never overlap one of the fixed kinds. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    # Matches are written and read, so that what follows finds them as columns: within a lambda, an expression is worked out anew for each element.
    hits = stored(docs.select("doc_id", F.md5(text.cast("binary")).alias("tkey"), *[m.alias(k) for k, m in matched(text).items()]), "pii-matches")
    spans = stored(hits.select("doc_id", "tkey", *[c.alias(k) for k, c in base_spans().items()], placed("token").alias("token")), "pii-spans")
    rows = spans.select("doc_id", "tkey", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.concat(*[listed(k, F.col(k)) for k in KINDS]).alias("base"))
    tokens = spans.select("tkey", F.explode("token").alias("m")).select("tkey", "m.*").distinct()
    known = spans.select("tkey", F.explode(F.concat(*KINDS)).alias("m")).select("tkey", "m.start", "m.end").distinct()
    exploded = stored(candidates(tokens, known), "pii-candidates")
    edges = exploded.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = stored(edges, "pii-edges")
    good = pattern_scores(edges, p)
    new = exploded.filter(~F.col("known")).select("tkey", "start", "end", F.explode("patterns").alias("pattern")).join(sized(good.select("pattern")), "pattern", "left_semi")
    # A group is what one text holds.
    by_text = stored(new.groupBy("tkey").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("new")), "pii-new")
    both = key_join(rows, by_text, "tkey", [F.col("doc_id")])
    extra = F.coalesce(listed("id", F.col("new")), F.array().cast("array<string>"))
    return both.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
                       F.size(extra).cast("bigint").alias("n_id"), F.array_join(F.concat("base", extra), ",").alias("spans"))

"""Byte-level BPE encoding and decoding by a vocabulary of ranks.

A text is cut into pre-tokens by classes of code points, all at once. A pre-token is looked up in two tiers: a minimal
perfect hash over the vocabulary resolves, in numpy, those that are tokens as a whole, each checked byte by byte; what is
left over is merged pair by pair, the least rank first, by a heap over its linked bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import fresh, mapped

#: Bytes that are cut and looked up at once (a longer text is cut between words), and rows.
BLOCK, ROWS = 1 << 20, 500
#: Pre-tokens of the second tier that a task remembers, and bytes of one, at most.
REMEMBERED, LONGEST = 150_000, 64
#: Keys of a bucket of the perfect hash, on average.
PER_BUCKET = 3
#: An odd multiplier of the polynomial hash, and multipliers that mix its bits.
BASE = 0x9E3779B97F4A7C15
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
SPACE, LETTER, NUMBER, OTHER, NONE = range(5)
# What follows an apostrophe in a pre-token of its own.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(33))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[starts[i]:ends[i]], all from one running sum of bytes times powers of BASE."""
    n = len(data)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])]
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], ..., starts[i] + lengths[i] - 1 of every i, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def equal_runs(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether runs of bytes of ``a`` and ``b`` with the same lengths (1 at least) are equal."""
    if not len(lengths):
        return np.zeros(0, bool)
    same = a[stretches(a_starts, lengths)] == b[stretches(b_starts, lengths)]
    return np.logical_and.reduceat(same, np.cumsum(lengths) - lengths)


@dataclass
class Vocabulary:
    """Tokens by rank, and a minimal perfect hash over them: slot (hash with its bucket's seed) of ``size`` slots, one a token."""

    tokens: list[bytes]
    ranks: np.ndarray
    data: np.ndarray = field(repr=False)
    starts: np.ndarray = field(repr=False)
    seeds: np.ndarray = field(repr=False)
    slots: np.ndarray = field(repr=False)

    @classmethod
    def build(cls, found: dict[bytes, int]) -> Vocabulary:
        """Of ranks by token. Buckets are placed from the largest to the smallest, each by the first seed under which its keys fall on free slots."""
        if len(set(found.values())) != len(found) or b"" in found:
            raise ValueError("ranks must differ and no token may be empty")
        tokens = sorted(found, key=found.__getitem__)
        lengths = np.array([len(t) for t in tokens], np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        starts = np.r_[0, np.cumsum(lengths)]
        h = run_hashes(data, starts[:-1], starts[1:])
        size = len(tokens)
        bucket = (h % np.uint64(max(1, size // PER_BUCKET))).astype(np.int64)
        counts = np.bincount(bucket, minlength=max(1, size // PER_BUCKET))
        order = np.argsort(bucket, kind="stable")
        firsts = np.cumsum(counts) - counts
        seeds, slots, free = np.zeros(len(counts), np.uint64), np.full(size, -1, np.int64), np.ones(size, bool)
        for b in np.argsort(-counts, kind="stable").tolist():
            keys = order[firsts[b]:firsts[b] + counts[b]]
            if not len(keys):
                break
            seed = 0
            while True:
                tried = np.arange(seed, seed + 64, dtype=np.uint64)
                at = slot_of(h[keys][None, :], tried[:, None], size)
                fine = free[at].all(axis=1)
                if len(keys) > 1:
                    placed = np.sort(at, axis=1)
                    fine &= (placed[:, 1:] != placed[:, :-1]).all(axis=1)
                if fine.any():
                    i = int(np.argmax(fine))
                    seeds[b], slots[at[i]] = tried[i], keys
                    free[at[i]] = False
                    break
                seed += 64
        return cls(tokens, np.array([found[t] for t in tokens], np.int64), data, starts, seeds, slots)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The place among ``tokens`` of each run of bytes, -1 where it is no token. ``h``: their hashes."""
        if not len(self.tokens):
            return np.full(len(h), -1)
        seed = self.seeds[(h % np.uint64(len(self.seeds))).astype(np.int64)]
        place = self.slots[slot_of(h, seed, len(self.slots))]
        lengths = ends - starts
        maybe = np.flatnonzero(self.starts[place + 1] - self.starts[place] == lengths)
        right = maybe[equal_runs(data, starts[maybe], self.data, self.starts[place[maybe]], lengths[maybe])]
        out = np.full(len(h), -1)
        out[right] = place[right]
        return out


def slot_of(h: np.ndarray, seed: np.ndarray, size: int) -> np.ndarray:
    return (mixed(h + (seed + np.uint64(1)) * np.uint64(BASE)) % np.uint64(size)).astype(np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a token in base64 and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def character_classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or something else.

    Unicode versions differ in these, so they are asked of the tiktoken library: with tokens of single bytes, it gives back
    exactly what its pattern matches. Only the driver needs the library.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def pre_token_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in code points; ``first`` marks those that begin a text.

    Runs of letters, of numbers and of other characters are pre-tokens, each with one space before it if there is one. White
    space goes together, but for the last one before a character, which that takes if it is a space and which else stands
    alone. An apostrophe that begins a pre-token takes the letters of a contraction.
    """
    n = len(points)
    kind = classes[points]
    before = np.r_[np.uint8(NONE), kind[:-1]]
    before[first] = NONE
    follows_space = np.r_[False, points[:-1] == 0x20] & ~first
    start = first | ((kind != before) & ~(follows_space & (kind != SPACE)))
    last = np.r_[(kind[1:] != SPACE) & ~first[1:], False] if n else np.zeros(0, bool)
    start |= (kind == SPACE) & last
    quote = np.flatnonzero((points == 0x27) & (before != OTHER) & ~follows_space)
    if len(quote):
        ends_text = np.r_[first[1:], True]
        quote = quote[~ends_text[quote]]
        one = points[quote + 1]
        short = quote[np.isin(one, [ord(c) for c in SHORT])]
        rest = quote[~ends_text[quote + 1]]
        long = rest[np.any([(points[rest + 1] == ord(a)) & (points[rest + 2] == ord(b)) for a, b in LONG], axis=0)]
        start[np.r_[short, long] + 1] = False
        after = np.r_[short + 2, long + 3]
        after = after[after < n]
        start[after[(kind[after] == LETTER) & ~first[after]]] = True
    return start


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranks of a pre-token that is no token: neighbours whose joined bytes have the least rank are merged, the leftmost of equals first.

    A symbol is known by the place of its first byte and linked to the one before it; where it ends, the next begins. A heap
    holds the pairs by rank, place and end as one number, and what it holds of a pair that has changed is passed over.
    """
    n = len(piece)
    size, get = n + 1, ranks.get
    # The end of the symbol at each place; places within a symbol end at n, whose own end is 0, so that no pair begins there.
    end, before = [*range(1, size), 0], list(range(-1, n - 1))
    heap = [(r * size + i) * size + i + 2 for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        code, stop = divmod(heapq.heappop(heap), size)
        i = code % size
        j = end[i]
        if end[j] != stop:
            continue
        end[j], end[i] = n, stop
        if stop < n:
            before[stop] = i
            e = end[stop]
            if (r := get(piece[i:e])) is not None:
                heapq.heappush(heap, (r * size + i) * size + e)
        if i:
            p = before[i]
            if (r := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r * size + p) * size + stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Coder:
    """Encodes texts by one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray):
        self.vocabulary, self.classes = vocabulary, classes
        self.ranks = dict(zip(vocabulary.tokens, vocabulary.ranks.tolist()))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def second_tier(self, piece: bytes) -> bytes:
        """The ids of a pre-token that is no token, as little-endian integers of four bytes. Those not seen for long are forgotten."""
        ids = self.known.get(piece)
        if ids is None:
            ids = self.older.pop(piece, None)
            if ids is None:
                ids = array("i", merged(piece, self.ranks)).tobytes()
            if len(piece) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known, self.older = {}, self.known
                self.known[piece] = ids
        return ids

    def encode_block(self, data: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of texts end to end, which begin at the bytes ``first``; none is empty."""
        points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.cumsum(widths) - widths
        opens = np.zeros(len(points), bool)
        opens[np.searchsorted(place, first)] = True
        starts = place[pre_token_starts(points, opens, self.classes)]
        ends = np.r_[starts[1:], len(data)]
        raw = np.frombuffer(data, np.uint8)
        h = run_hashes(raw, starts, ends)
        token = self.vocabulary.find(raw, starts, ends, h)
        hit = token >= 0
        counts = np.ones(len(starts), np.int64)
        miss = np.flatnonzero(~hit)
        _, one, which = np.unique(h[miss], return_index=True, return_inverse=True)
        # What has the same hash has the same bytes, or goes alone.
        twin, lengths = miss[one][which], (ends - starts)[miss]
        same = lengths == (ends - starts)[twin]
        same[same] = equal_runs(raw, starts[miss[same]], raw, starts[twin[same]], lengths[same])
        alone = np.flatnonzero(~same)
        which[alone] = len(one) + np.arange(len(alone))
        asked = np.r_[miss[one], miss[alone]]
        found = [self.second_tier(data[a:b]) for a, b in zip(starts[asked].tolist(), ends[asked].tolist())]
        sizes = np.array([len(x) for x in found], np.int64) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        counts[miss] = sizes[which]
        at = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        ids[at[hit]] = self.vocabulary.ranks[token[hit]]
        ids[stretches(at[miss], counts[miss])] = flat[stretches((np.cumsum(sizes) - sizes)[which], counts[miss])]
        return ids, np.add.reduceat(counts, np.searchsorted(starts, first))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. A text without tokens is empty."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                lengths = np.array([len(x) for _, x in held])
                ids, counts = self.encode_block(b"".join(x for _, x in held), np.cumsum(lengths) - lengths)
                for (i, _), part in zip(held, np.split(ids, np.cumsum(counts)[:-1])):
                    out[i].append(part)
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            for piece in pieces(text):
                held.append((i, piece))
                size += len(piece)
                if size >= BLOCK:
                    flush()
        flush()
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.int32) for x in out]


def decoded_bytes(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes that ids stand for; an id that the vocabulary lacks is an error."""
    place = np.searchsorted(vocabulary.ranks, ids)
    if len(ids) and (place.max() >= len(vocabulary.ranks) or (vocabulary.ranks[place] != ids).any()):
        raise ValueError("an id is not in the vocabulary")
    return b"".join(map(vocabulary.tokens.__getitem__, place.tolist()))


#: A space between two ASCII letters begins a pre-token, whatever stands around these.
BETWEEN = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about BLOCK bytes that can be encoded on their own."""
    at = 0
    while len(text) - at > BLOCK:
        cut = BETWEEN.search(text, at + BLOCK)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, ROWS at a time, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def vocabulary_of(df: DataFrame, path: str):
    """The vocabulary of a rank file, read on the driver and broadcast: executors need no copy of the file, and its size is that of the file."""
    return df.sparkSession.sparkContext.broadcast(vars(Vocabulary.build(read_ranks(path))))


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with column ``ids`` (ARRAY<INT>) in place of any of that name: the tokens of column ``text`` by the rank file ``path``.

    Pre-tokens are encoded separately and there are no special tokens. Null and empty texts have no tokens; repeated rows
    get the same. Other columns may have any name.
    """
    sent, classes = vocabulary_of(docs, path), docs.sparkSession.sparkContext.broadcast(character_classes())
    names = [c for c in docs.columns if c != ids]
    kept = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias(fresh(docs, "bytes")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary(**sent.value), classes.value)
        for batch in few_rows(batches):
            found = coder.encode(batch.column(len(names)).to_pylist())
            offsets = np.cumsum([0, *map(len, found)])
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*names, ids])

    return mapped(kept, run, T.StructType([*kept.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with column ``out`` (BINARY) in place of any of that name: the bytes that column ``ids`` stands for. Null ids stand for none."""
    sent = vocabulary_of(rows, path)
    names = [c for c in rows.columns if c != out]
    kept = rows.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias(fresh(rows, "wanted")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(**sent.value)
        for batch in few_rows(batches):
            lists = batch.column(len(names))
            data = [decoded_bytes(vocabulary, x.values.to_numpy()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(data, pa.binary())], [*names, out])

    return mapped(kept, run, T.StructType([*kept.schema.fields[:-1], T.StructField(out, T.BinaryType())]))


def hexadecimal(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of decimal ids joined by one space) and decoded_sha256, of the ids decoded again."""
    rows = decoded(encoded(docs.select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), hexadecimal(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), hexadecimal(F.col("decoded")).alias("decoded_sha256"))

"""Token ids in Re-Pair compressed blocks.

Documents are tokenized where they are read, dealt out in ascending doc_id order, and gathered into blocks, which are
the shards of the grammar. In each block, pairs of symbols are replaced by nonterminals, the most frequent ones first,
until no pair is frequent. A block stores its rules with the lengths they expand to, so that any document of it can be
decoded alone.
"""

from __future__ import annotations

import codecs
import os
import re
import string
import struct
import sys
import types
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.llm.common import released, scratch_dir

#: The id that ends each document.
END = 2
#: Tokens of a block, a little more where the last document passes them.
BLOCK_TOKENS = 1 << 17
#: The least count of a pair: a rule takes the place of some three symbols.
LEAST = 8
MAGIC = b"RPB2"
#: Bytes of text encoded together (one text at least), and parts of it that the library gets at once.
PIECE, TOGETHER = 8 << 20, 100
#: Parts of texts whose ids a worker remembers, and the bytes up to which it does.
REMEMBERED, LONGEST = 1_000_000, 40
#: Sampled keys a partition by which the order of doc_id is cut into partitions.
SAMPLED = 60


#: Kinds of bytes: letters, digits, signs, white space, the space; all others are 0.
LETTER, DIGIT, SIGN, WHITE, SPACE = 1, 2, 3, 4, 5


class Encoder:
    """Encodes whole texts, cut into parts of which each different one goes to the library once, and is remembered.

    Byte-level BPE joins nothing across its pre-tokens, so texts are cut where one begins whatever stands around: before a
    space, and where letters, digits and signs follow each other. A text is encoded in one piece where a space stands at an
    end or before other white space, or if it holds the string of an added token. Nothing is cut beside an apostrophe or a
    character of unknown kind. A part of one kind is one pre-token, and needs the library's BPE alone.
    """

    #: A space at either end, or before another white-space character.
    RUNS = "^ | $| [\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    #: Letters whose two bytes in UTF-8 begin with one of LEADS: U+00C0 to U+017F without two signs, U+0400 to U+047F.
    LETTERS, LEADS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f\u0400-\u047f", [0xC3, 0xC4, 0xC5, 0xD0, 0xD1]
    #: Without the apostrophe, which joins with letters.
    SIGNS = "".join(c for c in string.punctuation if c != "'")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, ByteLevel):
            raise ValueError("not the file of a byte-level BPE tokenizer")
        self.bpe = Tokenizer(self.tokenizer.model)
        self.bpe.pre_tokenizer = CharDelimiterSplit(" ")
        self.whole = "|".join([self.RUNS, *[re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]])
        self.one_kind = f"^ ?(?:[{self.LETTERS}]+|[0-9]+|[{re.escape(self.SIGNS)}]+)$"
        vocabulary = self.tokenizer.get_vocab()
        self.unit = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.end = np.array([END], self.unit).tobytes()
        # Byte-level BPE has a printable sign for each byte; a zero byte here parts what the BPE gets.
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        signs = dict.fromkeys(shown) | dict(zip([b for b in range(256) if b not in shown], range(256, 512)))
        self.signs = " " + "".join(chr(signs[b] or b) for b in range(1, 256))
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(self.signs[32])]] = True
        self.line = vocabulary[self.signs[10]]
        self.kinds = np.zeros(256, np.uint8)
        for kind, chars in ((LETTER, string.ascii_letters), (DIGIT, string.digits), (SIGN, self.SIGNS), (WHITE, "\t\n\v\f\r"), (SPACE, " ")):
            self.kinds[list(chars.encode())] = kind
        self.lead = np.zeros(256, bool)
        self.lead[self.LEADS] = True
        self.parted = np.zeros((8, 8), bool)
        self.parted[[LETTER, DIGIT], 1:SPACE] = self.parted[SIGN, [LETTER, DIGIT]] = self.parted[:, SPACE] = True
        self.parted[[LETTER, DIGIT], [LETTER, DIGIT]] = False
        self.known, self.known_ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.unit).tobytes()

    def starts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where parts begin in the bytes of several texts; edges: where these begin and end."""
        kind = self.kinds[data]
        lead = np.flatnonzero(self.lead[data])
        sign = (data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))
        lead = lead[~sign]
        kind[lead] = kind[lead + 1] = LETTER
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.parted.ravel()[kind[:-1] * np.uint8(8) + kind[1:]]
        # Of white space before what is none, the last character is a pre-token of its own.
        line = np.flatnonzero(data[1:-1] == 10) + 1
        before, after = kind[line - 1], kind[line + 1]
        alone = (before > 0) & (before < SPACE) & (after > 0) & (after < WHITE)
        last = np.zeros(len(data) + 1, bool)
        last[edges] = True
        alone &= ~last[line + 1]
        cut[line[alone] + 1] = True
        cut[line[alone & (before == WHITE)]] = True
        cut[edges] = True
        return np.flatnonzero(cut[:-1])

    def many(self, parts: list[str], kind: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids, how many of each part) of parts of one kind that begin with a space ("word") or without ("bare"), or of others with a space."""
        ids, counts = [], []
        for at in range(0, len(parts), TOGETHER):
            some = parts[at:at + TOGETHER]
            if kind == "other":
                tokenizer, text = self.tokenizer, "".join(some)
            else:
                tokenizer, text = self.bpe, codecs.charmap_decode(("\0" if kind == "word" else "\0\n\0").join(some).encode(), "strict", self.signs)[0]
            found = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.unit)
            if kind == "bare":  # a line's end stands between two parts, and in none
                between = found == self.line
                stops = np.append(np.flatnonzero(between) - np.arange(int(between.sum())), len(found) - int(between.sum()))
                counts.append(np.diff(stops, prepend=0))
                found = found[~between]
            else:  # each part begins at a token with a space, and has no other
                counts.append(np.diff(np.append(np.flatnonzero(self.spaced[found]), len(found))))
            if len(counts[-1]) != len(some) or counts[-1].min() < 1 or counts[-1].sum() != len(found):
                raise ValueError("the tokenizer joins what byte-level BPE does not")
            ids.append(found)
        return ids, counts

    def learn(self, parts: pa.Array) -> pa.Array:
        """The ids of different parts."""
        single, led = (x.to_numpy(zero_copy_only=False) for x in (pc.match_substring_regex(parts, self.one_kind), pc.starts_with(parts, " ")))
        groups = [np.flatnonzero(single & led), np.flatnonzero(single & ~led), np.flatnonzero(~single & led), np.flatnonzero(~single & ~led)]
        ids, counts = [], []
        for group, kind in zip(groups, ("word", "bare", "other")):
            for all_, some in zip((ids, counts), self.many(parts.take(pa.array(group)).to_pylist(), kind)):
                all_.extend(some)
        alone = [np.frombuffer(self.ids(p), self.unit) for p in parts.take(pa.array(groups[-1])).to_pylist()]
        ids, counts = [np.zeros(0, self.unit), *ids, *alone], [np.zeros(0, np.int64), *counts, np.array([len(x) for x in alone], np.int64)]
        place = np.empty(len(parts), np.int64)
        place[np.concatenate(groups)] = np.arange(len(parts))
        return binary(np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(counts))]).take(pa.array(place))

    def column(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (null: none) with END after them, as little-endian integers of the type ``unit``."""
        texts = texts.cast(pa.string()).fill_null("")
        whole = pc.match_substring_regex(texts, self.whole)
        cut, whole = pc.if_else(whole, "", texts), whole.to_numpy(zero_copy_only=False)
        edges = np.frombuffer(cut.buffers()[1], np.int32)[cut.offset:cut.offset + len(cut) + 1]
        data = np.frombuffer(cut.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
        edges = edges - edges[0]
        starts = self.starts(data, edges) if len(data) else np.zeros(0, np.int64)
        parts = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
        # What is known stands first in the dictionary; empty chunks are left out of it.
        coded = pa.chunked_array([self.known, parts], pa.string()).dictionary_encode().chunks
        new = coded[-1].dictionary.slice(len(self.known)) if len(parts) else parts
        new_ids = self.learn(new)
        table = [self.known_ids, new_ids, pa.array([self.end] + [self.ids(texts[i].as_py()) for i in np.flatnonzero(whole).tolist()], pa.binary())]
        # After its parts a text has END; one that isn't cut has its ids alone before it.
        end, stops = len(self.known) + len(new), np.searchsorted(starts, edges[1:])
        ends = np.cumsum(1 + whole)
        added = np.full(int(ends[-1]), end)
        added[ends[whole] - 2] = end + 1 + np.arange(int(whole.sum()))
        which = np.insert(coded[-1].indices.to_numpy() if len(parts) else starts, np.repeat(stops, 1 + whole), added)
        joined = pa.concat_arrays(table).take(pa.array(which))
        offsets = np.frombuffer(joined.buffers()[1], np.int32)[np.r_[0, stops + ends]]
        if len(self.known) < REMEMBERED:
            short = pc.less_equal(pc.binary_length(new), LONGEST)
            self.known = pa.concat_arrays([self.known, new.filter(short)])[:REMEMBERED]
            self.known_ids = pa.concat_arrays([self.known_ids, new_ids.filter(short)])[:REMEMBERED]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), joined.buffers()[2]])

    def columns(self, texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """(first row, ids as ``column`` gives them) of some texts at a time."""
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)]
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1)
            yield at, self.column(texts.slice(at, stop - at))
            at = stop

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, without END."""
        for _, ids in self.columns(pa.array(texts, pa.string())):
            yield from (x.as_py()[:-len(self.end)] for x in ids)


def binary(ids: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The bytes of runs of ids."""
    return pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer((ids.itemsize * stops).astype(np.int32)), pa.py_buffer(ids)])


def kept() -> types.ModuleType:
    """What a Python worker keeps between its tasks."""
    return sys.modules.setdefault("_vexel_kept", types.ModuleType("_vexel_kept"))


def worker_encoder(path: str) -> Encoder:
    """The encoder that a worker keeps, so that it needn't learn the same chunks again."""
    here = kept()
    if getattr(here, "path", None) != path:
        here.path, here.encoder = path, Encoder(path)
    return here.encoder


def forget_encoder() -> None:
    """Frees the memory of a worker whose later tasks encode nothing."""
    vars(kept()).pop("encoder", None)
    vars(kept()).pop("path", None)
    released()


def by_code(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted codes, and the places they come from; equal codes keep their order."""
    bits = max(1, (len(codes) - 1).bit_length())
    if int(codes.max()).bit_length() + bits > 64:
        order = np.argsort(codes, kind="stable")
        return codes[order], order
    packed = codes.astype(np.uint64)
    packed <<= np.uint64(bits)
    packed |= np.arange(len(codes), dtype=np.uint64)
    packed.sort()
    return packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def frequent_pairs(seq: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(places, rank of the pair there, codes of the pairs by rank) of the pairs at ``at`` that occur LEAST times, most frequent first.

    A pair's code is left * symbols + right. Of a run of one symbol, every second pair counts. None if no pair is frequent.
    """
    left, right = seq[at], seq[at + 1]
    same = np.flatnonzero(left == right)
    if len(same):
        where = at[same]
        run = np.flatnonzero(np.r_[True, np.diff(where) != 1])
        odd = (np.arange(len(where)) - np.repeat(run, np.diff(np.r_[run, len(where)]))) % 2 == 1
        if odd.any():
            keep = np.ones(len(at), bool)
            keep[same[odd]] = False
            at, left, right = at[keep], left[keep], right[keep]
    kind = np.uint32 if symbols <= 1 << 16 else np.uint64
    codes = left.astype(kind) * kind(symbols) + right.astype(kind)
    # Counts by hashed slots are never too low, so what they leave out needn't be sorted.
    bits = len(codes).bit_length()
    slot = (codes * kind(0x9E3779B1) >> kind(8 * codes.itemsize - bits)).astype(np.int64)
    often = np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= LEAST)[slot])
    if not len(often):
        return None
    pairs, order = by_code(codes[often])
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    counts = np.diff(np.r_[first, len(pairs)])
    frequent = np.flatnonzero(counts >= LEAST)
    if not len(frequent):
        return None
    frequent = frequent[np.argsort(-counts[frequent], kind="stable")]
    rank = np.full(len(counts), -1, np.int32)
    rank[frequent] = np.arange(len(frequent))
    rank_at = np.empty(len(pairs), np.int32)
    rank_at[order] = np.repeat(rank, counts)
    chosen = np.flatnonzero(rank_at >= 0)
    return at[often[chosen]], rank_at[chosen], pairs[first[frequent]]


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(terminals, sequence, rules, first symbol of each round) of one block.

    Symbol 0 is END, then come the terminals and then the rules (left, right). A round counts all pairs exactly. Where
    frequent pairs overlap, the more frequent one is replaced, of equally frequent ones the first in order; a pair that
    is left too few occurrences waits for the next round. Rounds go on until no pair occurs LEAST times. No pair holds
    END, so that no rule spans documents.
    """
    used = np.zeros(max(END, int(ids.max(initial=0))) + 1, bool)
    used[ids] = True
    used[END] = False
    terminals = np.flatnonzero(used)
    number = np.zeros(len(used), np.int32)
    number[terminals] = np.arange(1, len(terminals) + 1)
    seq, symbols, rules, rounds = number[ids], len(terminals) + 1, [], []
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0)).astype(np.int32)
    while len(at) and (found := frequent_pairs(seq, at, symbols)):
        at, rank, pairs = found
        touch, before = at[1:] - at[:-1] == 1, rank[:-1] <= rank[1:]
        wins = np.ones(len(at), bool)
        wins[1:] &= ~(touch & before)
        wins[:-1] &= ~(touch & ~before)
        good = np.bincount(rank[wins], minlength=len(pairs)) >= LEAST
        if not good.any():  # the most frequent pair alone loses no occurrence
            good[0], wins = True, rank == 0
        taken = wins & good[rank]
        spot, chosen = at[taken], pairs[good].astype(np.int64)
        rounds.append(symbols)
        rules.append(np.stack([chosen // symbols, chosen % symbols], axis=1))
        seq[spot] = (symbols - 1 + np.cumsum(good))[rank[taken]]
        keep = np.ones(len(seq), bool)
        keep[spot + 1] = False
        # What can be frequent in the next round was so in this one, or holds a new symbol.
        open_ = np.zeros(len(seq), bool)
        open_[at] = True
        moved = np.cumsum(keep, dtype=np.int32)[spot] - 1
        seq, open_, symbols = seq[keep], open_[keep], symbols + len(chosen)
        open_[moved] = True
        open_[moved[moved > 0] - 1] = True
        at = np.flatnonzero(open_[:-1] & (seq[:-1] > 0) & (seq[1:] > 0)).astype(np.int32)
    return terminals, seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), rounds


def expansion_lengths(rules: np.ndarray, first: int, rounds: list[int]) -> np.ndarray:
    """How many ids each rule stands for; ``first`` is the number of the first rule."""
    lengths = np.ones(first + len(rules), np.int64)
    for at, stop in zip(rounds, [*rounds[1:], len(lengths)]):
        lengths[at:stop] = lengths[rules[at - first:stop - first]].sum(axis=1)
    return lengths[first:]


def stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], ..., starts[i] + lengths[i] - 1 of every i, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


#: A block's header: documents, terminals, rules, rounds, symbols, and the bytes of an id, a symbol, and a length.
HEADER = "<4s8I"


def pack(ids: np.ndarray, tokens: np.ndarray) -> bytes:
    """A block: header, tokens of each document, rounds, terminals, rules, their expansion lengths, and the sequence."""
    terminals, seq, rules, rounds = compress(ids)
    lengths = expansion_lengths(rules, len(terminals) + 1, rounds)

    def width(most: int) -> int:
        return 2 if most < 1 << 16 else 4

    wide = [width(int(terminals.max(initial=0))), width(len(terminals) + len(rules)), width(int(lengths.max(initial=0)))]
    head = struct.pack(HEADER, MAGIC, len(tokens), len(terminals), len(rules), len(rounds), len(seq), *wide)
    parts = [(tokens, 4), (np.array(rounds), 4), (terminals, wide[0]), (rules, wide[1]), (lengths, wide[2]), (seq, wide[1])]
    return b"".join([head, *[a.astype(f"<u{w}").tobytes() for a, w in parts]])


@dataclass
class Block:
    tokens: np.ndarray
    rounds: list[int]
    terminals: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    seq: np.ndarray

    @classmethod
    def parse(cls, data: bytes) -> Block:
        magic, docs, terminals, rules, rounds, symbols, of_id, of_symbol, of_length = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair block")
        out, at = [], struct.calcsize(HEADER)
        for n, w in ((docs, 4), (rounds, 4), (terminals, of_id), (2 * rules, of_symbol), (rules, of_length), (symbols, of_symbol)):
            out.append(np.frombuffer(data, f"<u{w}", n, at).astype(np.int64))
            at += n * w
        return cls(out[0], out[1].tolist(), out[2], out[3].reshape(-1, 2), out[4], out[5])

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): symbol s stands for ids[start[s]:start[s] + length[s]]."""
        first = len(self.terminals) + 1
        lengths = np.r_[np.ones(first, np.int64), self.lengths]
        starts = np.cumsum(lengths) - lengths
        ids = np.r_[END, self.terminals, np.empty(int(self.lengths.sum()), np.int64)]
        for at, stop in zip(self.rounds, [*self.rounds[1:], len(lengths)]):
            parts = self.rules[at - first:stop - first].ravel()
            ids[starts[at]:starts[stop - 1] + lengths[stop - 1]] = ids[stretches(starts[parts], lengths[parts])]
        return ids, starts, lengths

    def expand(self, seq: np.ndarray) -> np.ndarray:
        ids, starts, lengths = self.expansions()
        return ids[stretches(starts[seq], lengths[seq])]

    def ids(self) -> np.ndarray:
        return self.expand(self.seq)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document: expansion lengths say where it lies, and only its symbols are expanded."""
        ends = np.cumsum(np.r_[np.ones(len(self.terminals) + 1, np.int64), self.lengths][self.seq])
        stop = int(self.tokens[:i + 1].sum())
        lo = int(np.searchsorted(ends, stop - int(self.tokens[i]), side="right"))
        return self.expand(self.seq[lo:int(np.searchsorted(ends, stop)) + 1])


def key_bounds(rows: DataFrame, parts: int) -> list[tuple[bool, int, int]]:
    """Keys (doc_id is known, doc_id, text_hash) between which the rows are dealt out to ``parts`` partitions.

    They come from about SAMPLED sampled keys a partition. Which keys these are decides how even the partitions are, and
    nothing else.
    """
    share = min(1.0, SAMPLED * parts / max(1, rows.count()))
    some = rows.sample(share, 17).select("doc_id", F.xxhash64("text").alias("text_hash")).toArrow().to_pylist()
    keys = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_hash"]) for r in some)
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def write_blocks(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Writes Parquet rows (part, block, n_tokens, doc_ids, payload): blocks in ascending order of doc_id, nulls first, ties by text.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, which every executor can open. Texts are
    encoded where they are read; what is shuffled are ids of two bytes (four where the vocabulary is larger). Equal
    rows whose key is a bound of several partitions take these in turn.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = spark.sparkContext.broadcast(key_bounds(rows, parts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, limits, turn = worker_encoder(tokenizer), bounds.value, 0
        for batch in batches:
            for at, ids in encoder.columns(batch.column(2)):
                some = batch.slice(at, len(ids))
                dealt = []
                for doc_id, text_hash in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    key = (doc_id is not None, doc_id or 0, text_hash)
                    low, high = bisect_left(limits, key), bisect_right(limits, key)
                    dealt.append(low + turn % (high - low + 1))
                    turn += high > low
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(dealt, pa.int32()), pa.array([len(encoder.end)] * len(ids), pa.int32()), ids], ["doc_id", "text_hash", "part", "width", "ids"])
        released()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        held, doc_ids, size, part, block = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            tokens = np.array([len(x) for x in held])
            payload = pack(np.concatenate(held), tokens)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([int(tokens.sum())], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["part", "block", "n_tokens", "doc_ids", "payload"])

        for batch in batches:
            for doc_id, to, width, ids in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "part", "width", "ids")]):
                if not held:
                    part = to
                held.append(np.frombuffer(ids, f"<u{width}"))
                doc_ids.append(doc_id)
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield flush()
                    held, doc_ids, size, block = [], [], 0, block + 1
        if held:
            yield flush()

    coded = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(encode, "doc_id bigint, text_hash bigint, part int, width int, ids binary")
    dealt = coded.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "text_hash")
    dealt.mapInArrow(gather, "part int, block bigint, n_tokens bigint, doc_ids array<bigint>, payload binary").write.parquet(path)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the blocks in ``path``."""
    blocks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, doc_ids, payload in zip(*[batch.column(i) for i in range(4)]):
                read = Block.parse(payload.as_py())
                data = read.ids().astype("<u4").tobytes()
                stops = np.cumsum(read.tokens)
                starts = stops - read.tokens
                n = len(stops)
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int64()), doc_ids.values, pa.array(starts), pa.array(read.tokens), pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    docs = blocks.select("part", "block", "doc_ids", "payload").mapInArrow(run, "part int, block bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = blocks.select("part", "block", F.col("n_tokens").alias("n"))
    # One row per file part, of which there are as many as shuffle partitions.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("_p"), before(Window.orderBy("part")).alias("part_start"))
    starts = sizes.select(F.col("part").alias("_part"), F.col("block").alias("_block"), before(Window.partitionBy("part").orderBy("block")).alias("block_start"))
    starts = starts.join(parts, F.col("_part") == F.col("_p")).select("_part", "_block", (F.col("block_start") + F.col("part_start")).alias("_start"))
    placed = docs.join(starts, (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block")))
    return placed.select("doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the ids of ``docs`` to the shared folder and reads them back: doc_id, start, n_tokens (with END), ids_crc32.

    Null and empty texts hold END alone. Rows of one doc_id follow each other in an order given by their texts; repeated rows
    each get a row. A null doc_id comes first. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/token-blocks-{uuid.uuid4().hex}"
    write_blocks(docs, tokenizer, path)
    return read_digest(spark, path)

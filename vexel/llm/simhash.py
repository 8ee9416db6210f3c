"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie self-join.

Two fingerprints that differ in at most ``max_bits`` of ``max_bits + EXACT`` blocks of bits agree in EXACT blocks at
least. For each choice of EXACT blocks, the trie over the fingerprints with these blocks in front is joined with itself:
node pairs descend together, nothing may differ within the front, and a pair is dropped as soon as its differing bits
exceed the budget. The front is the key by which Spark deals out the work. Where a budget is too wide for that, as at a
similarity of 0.8, fingerprints of two words are joined behind fronts of blocks that such pairs have in common often enough, which leaves some out;
``deduplicated`` joins the sets of shingles themselves, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import BROADCAST_ROWS, fresh, hot_keys, released, removed, spread_join, stored, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Blocks on which a linked pair agrees, at least.
EXACT = 2
#: For fingerprints of two words: (bits of a block, blocks of a front), and so 120 or 816 fronts of 16 or 21 bits; the second where the first leaves more than TRIE_ROWS fingerprints to a front.
WIDE_FRONTS = ((8, 2), (7, 3))
#: Bits of the front that deal out the work, at most.
FRONT_BITS = 22
#: Shingles hashed before their bits are counted, so that memory doesn't follow a text's length.
CHUNK = 1 << 16
#: Fingerprints of one trie that a task works on at once; larger tries are dealt out by pairs of their subtries.
TRIE_ROWS = 20_000
#: Node pairs with at most this many fingerprint pairs are compared directly.
LEAF = 1 << 13
#: Links kept in memory before they are reduced to one per fingerprint.
HELD = 1 << 20
#: Bits of the sketch of a set of shingles.
SKETCH = 1024
#: Texts whose shingles are counted to find the frequent ones, about, and frequent ones, at most.
SAMPLED_TEXTS, FREQUENT = 20_000, 200_000
#: Texts whose sets are in memory at once, nodes that each node of a shingle is held against first, nodes of a shingle that one task compares, and pairs it does so at once.
TEXTS, HUBS, MEETING, BLOCK = 200, 3, 4_000, 1 << 17
#: Distinct shingles of a short text, at most; such texts are joined by their shingles as well. With 14, no more than two are left out of a key.
SHORT = 14


def _majority(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _word(counts: np.ndarray, n: int) -> int:
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int, second: bool = False) -> tuple[int, int, int, list[int] | None]:
    """(fingerprint, second word, shingles, few): a bit is set if it is set in over half of the XXH64 hashes of the text's shingles.

    The second word is that of the same hashes, mixed once more, and zero unless asked for; ``few`` holds the distinct hashes
    if the second word is asked for and there are at most SHORT. Without words, all are zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0, 0, 0, None
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    size = min(shingle, len(words))
    starts, stops = [0, *ends[:-1].tolist()], (ends[size - 1:] - 1).tolist()
    n = len(stops)
    counts, other = np.zeros(64, np.int64), np.zeros(64, np.int64)
    distinct: set[int] = set()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], stops[at:at + CHUNK])], np.uint64)
        counts += _majority(h)
        if second:
            for some in range(0, len(h), 4 * SHORT):
                if len(distinct) > SHORT:
                    break
                distinct.update(h[some:some + 4 * SHORT].view(np.int64).tolist())
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            other += _majority((h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53))
    return _word(counts, n), _word(other, n) if second else 0, n, sorted(distinct) if second and len(distinct) <= SHORT else None


def fingerprints(docs: DataFrame, shingle: int, second: bool) -> DataFrame:
    """(doc_id, text_hash, fp, fp2, n, few) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint(t.as_py(), shingle, second) for t in batch.column(2)]
            fps = np.array([r[:2] for r in rows], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps[:, 0].view(np.int64)), pa.array(fps[:, 1].view(np.int64)), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "fp", "fp2", "n", "few"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint, fp2 bigint, n bigint, few array<bigint>")


def blocks(count: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``count`` blocks of 64 bits of nearly equal length."""
    edges = [64 * i // count for i in range(count + 1)]
    return list(zip(edges[:-1], np.diff(edges).tolist()))


@dataclass(frozen=True)
class Choice:
    """A front: the first ``front`` bits of the key word in the order ``order``, and blocks (first bit, bits) of the other. ``swap``: the key word is the second."""

    swap: bool
    order: list[int]
    front: int
    others: tuple[tuple[int, int], ...] = ()

    @property
    def bits(self) -> int:
        return self.front + sum(n for _, n in self.others)


def in_front(first: list[int]) -> list[int]:
    return first + [b for b in range(64) if b not in set(first)]


def orders(max_bits: int) -> list[Choice]:
    """For each choice of EXACT blocks of a word, these blocks in front."""
    parts = blocks(max_bits + EXACT)
    out = []
    for front in combinations(range(len(parts)), EXACT):
        first = [b for i in front for b in range(parts[i][0], sum(parts[i]))]
        out.append(Choice(False, in_front(first), min(len(first), FRONT_BITS)))
    return out


def wide_orders(size: int, count: int) -> list[Choice]:
    """For each choice of ``count`` blocks of ``size`` bits of two words, these in front; the key word is the one that most of them are of.

    At a Jaccard similarity of 0.8, 15 % of the bits differ, so 0.27 of the blocks of 8 bits agree, of 16 such blocks at least
    two in 0.95 of the pairs; of 18 blocks of 7 bits at least three in 0.95.
    """
    per = 64 // size
    out = []
    for front in combinations(range(2 * per), count):
        swap = 2 * sum(i >= per for i in front) > count
        own = [i % per for i in front if (i >= per) == swap]
        other = [i % per for i in front if (i >= per) != swap]
        first = [b for i in own for b in range(i * size, i * size + size)]
        out.append(Choice(swap, in_front(first), len(first), tuple((i * size, size) for i in other)))
    return out


def permuted(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """The fingerprints with bit order[0] as the highest; runs of neighbouring bits move together."""
    out, i = np.zeros_like(fps), 0
    while i < 64:
        j = i
        while j + 1 < 64 and order[j + 1] == order[j] + 1:
            j += 1
        size = j - i + 1
        # Bits are counted from the highest, so that a run keeps its order.
        run = (fps >> np.uint64(64 - order[i] - size)) & np.uint64((1 << size) - 1)
        out |= run << np.uint64(64 - i - size)
        i = j + 1
    return out


class Links:
    """Union-find over positions, fed with arrays of pairs; only one link a position leaves it."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size > HELD:
            self.reduce()

    def reduce(self) -> None:
        if not self.held:
            return
        a, b = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size, parent = [], 0, self.parent
        while len(a):
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up


def trie_pairs(keys: np.ndarray, more: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray, depth: int, budget: int, total: int, links: Links) -> None:
    """Joins the tries over the ranges [a_lo, a_hi) and [b_lo, b_hi) of the sorted ``keys`` from bit ``depth`` on.

    All pairs of a level descend together. A pair of nodes goes to its children's pairs with the differing bit added,
    and is pruned beyond the budget; pairs of small nodes are compared directly.
    """
    err = np.zeros(len(a_lo), np.int64)
    while len(a_lo):
        na, nb = a_hi - a_lo, b_hi - b_lo
        small = (na * nb <= LEAF) | (depth >= 64)
        if small.any():
            compare(keys, more, a_lo[small], a_hi[small], b_lo[small], b_hi[small], budget, total, links)
        go = ~small
        a_lo, a_hi, b_lo, b_hi, err = a_lo[go], a_hi[go], b_lo[go], b_hi[go], err[go]
        if not len(a_lo):
            return
        bit = np.uint64(1 << (63 - depth))
        below = np.uint64((1 << (63 - depth)) - 1)

        def split(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """Where the child of bit 1 begins."""
            edge = (keys[lo] & ~below & ~bit) | bit  # noqa: B023
            return np.clip(np.searchsorted(keys, edge), lo, hi)

        am, bm = split(a_lo, a_hi), split(b_lo, b_hi)
        same = (a_lo == b_lo) & (a_hi == b_hi)
        kids = [(a_lo, am, b_lo, bm, err), (am, a_hi, bm, b_hi, err), (a_lo, am, bm, b_hi, err + 1), (am[~same], a_hi[~same], b_lo[~same], bm[~same], err[~same] + 1)]
        a_lo, a_hi, b_lo, b_hi, err = (np.concatenate(x) for x in zip(*kids))
        keep = (a_hi > a_lo) & (b_hi > b_lo) & (err <= budget)
        a_lo, a_hi, b_lo, b_hi, err = a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep], err[keep]
        depth += 1


def compare(keys: np.ndarray, more: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray, budget: int, total: int, links: Links) -> None:
    """Links the pairs that differ in at most ``budget`` bits of the key and ``total`` bits of both words."""
    sizes = (a_hi - a_lo) * (b_hi - b_lo)
    at = 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), HELD)) + at)
        s = sizes[at:upto]
        pair = np.repeat(np.arange(at, upto), s)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(s) - s, s)
        width = (b_hi - b_lo)[pair]
        i, j = a_lo[pair] + inner // width, b_lo[pair] + inner % width
        bits = np.bitwise_count(keys[i] ^ keys[j])
        near = (i < j) & (bits <= budget)
        i, j, bits = i[near], j[near], bits[near]
        near = bits + np.bitwise_count(more[i] ^ more[j]) <= total
        links.add(i[near], j[near])
        at = upto


def join_tasks(task: np.ndarray, side: np.ndarray, fps: np.ndarray, more: np.ndarray, plan: list[Choice], budget: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows linked within each task, whose rows stand together: between its sides, or among all its rows where only side 0 occurs."""
    keys, choice = np.empty_like(fps), task >> CHOICE_SHIFT
    for c in np.unique(choice):
        keys[choice == c] = permuted(fps[choice == c], plan[c].order)
    place = np.lexsort((keys, side, task))
    keys, side, task, more = keys[place], side[place], task[place], more[place]
    lo = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (side[1:] != side[:-1])])
    hi, t, second = np.r_[lo[1:], len(task)], task[lo], side[lo] == 1
    followed = np.r_[second[1:] & (t[1:] == t[:-1]), False]
    crossing = (t & CROSS) != 0
    first = np.flatnonzero(~second & (followed | ~crossing))
    other = first + (followed & crossing)[first]
    links = Links(len(keys))
    a_lo, a_hi, b_lo, b_hi = lo[first], hi[first], lo[other], hi[other]
    some = (first != other) | (a_hi - a_lo > 1)
    a_lo, a_hi, b_lo, b_hi = a_lo[some], a_hi[some], b_lo[some], b_hi[some]
    large = (a_hi - a_lo) * (b_hi - b_lo) > LEAF
    compare(keys, more, a_lo[~large], a_hi[~large], b_lo[~large], b_hi[~large], budget, total, links)
    for at, upto, b_at, b_upto in zip(*[x[large].tolist() for x in (a_lo, a_hi, b_lo, b_hi)]):
        # Side 1 is a later subtrie, so the rows of a task are sorted as a whole.
        depth = plan[task[at] >> CHOICE_SHIFT].front
        own = Links(b_upto - at)
        trie_pairs(keys[at:b_upto], more[at:b_upto], *[np.array([x - at]) for x in (at, upto, b_at, b_upto)], depth, budget, total, own)
        own.reduce()
        moved = np.flatnonzero(own.parent != np.arange(b_upto - at))
        links.add(own.parent[moved] + at, moved + at)
    links.reduce()
    # All tasks link a group to its least fingerprint, so that links found in several tasks are the same.
    words = np.where(np.array([c.swap for c in plan])[task >> CHOICE_SHIFT], more, fps[place])
    order = np.lexsort((words, links.parent))
    first = np.r_[True, links.parent[order][1:] != links.parent[order][:-1]]
    least = order[first][np.cumsum(first) - 1]
    apart = least != order
    return place[order[apart]], place[least[apart]]


#: A task's number: the choice of blocks, the bits of the front, the two subtries, and whether they differ.
CHOICE_SHIFT, FRONT_SHIFT, FIRST_SHIFT, SECOND_SHIFT, CROSS = 48, 26, 14, 2, 1
#: Bits of a subtrie's number, at most.
SUB_BITS = 12
#: Rows that a task gathers, ending with a whole group, before it joins them.
GATHERED = 200_000


def node_of(second: bool, fp: str = "fp", fp2: str = "fp2") -> Column:
    """What stands for a fingerprint in a graph: the fingerprint, or a hash of both its words."""
    return F.xxhash64(fp, fp2) if second else F.col(fp)


def links(nodes: DataFrame, max_bits: int, total: int | None = None) -> DataFrame:
    """(a, b): links between the nodes of the rows (fp, fp2; distinct) that differ in at most ``max_bits`` bits of fp.

    With ``total``, at most ``total`` bits of both words may differ, and pairs are found that agree in the blocks of a front; a
    node is dealt out to 120 fronts of 16 bits, or to 816 of 21 bits where there are more nodes than TRIE_ROWS a front, so that
    what meets in a front grows with the nodes only beyond some 10**10. Not every linked pair is returned, but within a task a
    spanning forest of them, so nothing grows with the square of a group. A trie of more than TRIE_ROWS fingerprints is
    dealt out by pairs of its subtries.
    """
    count = nodes.count()
    if total is None:
        plan, budget, limit = orders(max_bits), max_bits, 128
    else:
        narrow, long = WIDE_FRONTS
        plan = wide_orders(*(narrow if count <= TRIE_ROWS << (narrow[0] * narrow[1]) else long))
        budget = limit = total
    # Bits of a front on which rows are counted first: so many that a trie too large for a task stands out.
    few_bits = max(0, math.ceil(math.log2(max(1, 4 * count / TRIE_ROWS))))

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node once for each choice of blocks, with the bits of the front and those that follow it."""
        for batch in batches:
            both = [batch.column(i).to_numpy().view(np.uint64) for i in range(2)]
            for c, choice in enumerate(plan):
                key, more = both[::-1] if choice.swap else both
                turned = permuted(key, choice.order)
                first = turned >> np.uint64(64 - choice.front)
                for start, size in choice.others:
                    first = (first << np.uint64(size)) | ((more >> np.uint64(64 - start - size)) & np.uint64((1 << size) - 1))
                following = (turned >> np.uint64(64 - choice.front - SUB_BITS)) & np.uint64((1 << SUB_BITS) - 1)
                coarse = first >> np.uint64(max(0, choice.bits - few_bits))
                columns = [np.full(len(turned), c, np.int64), coarse.view(np.int64), first.view(np.int64), following.view(np.int64), key.view(np.int64), more.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["choice", "coarse", "front", "next", "key", "more"])

    keyed = nodes.select("fp", "fp2").mapInArrow(fronts, "choice bigint, coarse bigint, front bigint, next bigint, key bigint, more bigint")
    number = lambda sub, other, cross: (F.shiftleft("choice", CHOICE_SHIFT).bitwiseOR(F.shiftleft("front", FRONT_SHIFT))
                                        .bitwiseOR(F.shiftleft(F.least(sub, other), FIRST_SHIFT)).bitwiseOR(F.shiftleft(F.greatest(sub, other), SECOND_SHIFT)).bitwiseOR(cross))
    zero = F.lit(0).cast("bigint")
    crowded = keyed.groupBy("choice", "coarse").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TRIE_ROWS).select("choice", "coarse")
    crowded = stored(crowded, "simhash-crowded")
    if crowded.isEmpty():
        tasks = keyed.select("key", "more", number(zero, zero, zero).alias("task"), zero.alias("side"))
    else:
        wide = keyed.join(crowded, ["choice", "coarse"], "left_semi").groupBy("choice", "front").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TRIE_ROWS)
        split = F.least(F.lit(SUB_BITS), F.lit(4) * F.ceil(F.log2(F.col("n") / TRIE_ROWS) / 4)).cast("int")
        wide = stored(wide.select("choice", "front", split.alias("split")), "simhash-wide")
        tasks = keyed.join(F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide, ["choice", "front"], "left")
        tasks = tasks.withColumn("sub", F.when(F.col("split").isNull(), F.lit(0)).otherwise(F.expr("shiftright(next, %d - split)" % SUB_BITS)).cast("bigint"))
        near = F.filter(F.expr("sequence(0L, shiftleft(1L, split) - 1L)"), lambda o: F.bit_count(o.bitwiseXOR(F.col("sub"))) <= budget)
        partners = F.when(F.col("split").isNull(), F.array(zero)).otherwise(near)
        tasks = tasks.select("key", "more", "choice", "front", "sub", F.explode(partners).alias("other"))
        cross = F.when(F.col("sub") != F.col("other"), F.lit(CROSS).cast("bigint")).otherwise(zero)
        tasks = tasks.select("key", "more", number(F.col("sub"), F.col("other"), cross).alias("task"), F.when(F.col("sub") > F.col("other"), 1).otherwise(0).cast("bigint").alias("side"))
    swaps = np.array([c.swap for c in plan])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        found: list[tuple[np.ndarray, ...]] = []
        size = 0

        def joined(task: np.ndarray, side: np.ndarray, key: np.ndarray, more: np.ndarray) -> None:
            a, b = join_tasks(task, side, key.view(np.uint64), more.view(np.uint64), plan, budget, limit)
            swapped = swaps[task[a] >> CHOICE_SHIFT]
            found.append(tuple(np.where(swapped, second[x], first[x]) for x in (a, b) for first, second in ((key, more), (more, key))))

        def forest() -> pa.RecordBatch:
            """Of the links found so far, those that link a node to the first that it can reach by them."""
            a, a2, b, b2 = (np.concatenate(x) for x in zip(*found))
            found.clear()
            first, second = np.r_[a, b], np.r_[a2, b2]
            order = np.lexsort((second, first))
            new = np.r_[True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)][:len(order)]
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new) - 1
            own = Links(int(new.sum()))
            own.add(place[:len(a)], place[len(a):])
            own.reduce()
            rows = order[new]
            moved = np.flatnonzero(own.parent != np.arange(len(rows)))
            columns = [x[rows[i]] for i in (moved, own.parent[moved]) for x in (first, second)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["a", "a2", "b", "b2"])

        for batch in batches:
            held.append(tuple(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("task", "side", "key", "more")))
            size += batch.num_rows
            if size >= GATHERED:
                rows = tuple(np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
                if cut:
                    joined(*(x[:cut] for x in rows))
                held, size = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
                if sum(len(x[0]) for x in found) >= HELD:
                    yield forest()
        if size:
            joined(*(np.concatenate(x) for x in zip(*held)))
        if found:
            yield forest()
        held.clear()
        released()

    dealt = tasks.repartition("task").sortWithinPartitions("task")
    rows = dealt.mapInArrow(run, "a bigint, a2 bigint, b bigint, b2 bigint")
    return rows.select(node_of(total is not None, "a", "a2").alias("a"), node_of(total is not None, "b", "b2").alias("b")).distinct()


def short_links(sets: DataFrame) -> DataFrame:
    """(a, b): links between the rows of ``sets`` (node, few: distinct hashes) with a Jaccard similarity of 0.8 or more.

    Sets that share i elements and have p and q others are that similar if i >= 4 (p + q). So each set is dealt out once
    for each of its parts that leaves out p <= i / 4 elements, and a group of equal parts holds a link wherever p + q is
    small enough. Each row is linked to the one of its group that leaves out fewest, if it may be linked to any: those
    links connect what all of them would, and nothing grows with the square of a group.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, sizes, outs = [], [], [], []
            for node, few in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, n = sum(few), len(few)
                for out in range(n // 5 + 1):
                    for left_out in combinations(few, out):
                        nodes.append(node)
                        keys.append((total - sum(left_out)) & 0xFFFFFFFFFFFFFFFF)
                        sizes.append(n - out)
                        outs.append(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(outs, pa.int64())], ["node", "key", "size", "out"])

    dealt = sets.select("node", "few").mapInArrow(parts, "node bigint, key bigint, size bigint, out bigint")
    first = dealt.groupBy("key", "size").agg(F.min(F.struct("out", "node")).alias("f"), F.count(F.lit(1)).alias("_n"))
    first = first.filter("_n > 1").select(F.col("key").alias("_k"), F.col("size").alias("_s"), "f")
    found = dealt.join(first, (F.col("key") == F.col("_k")) & (F.col("size") == F.col("_s")))
    found = found.filter((F.col("node") != F.col("f.node")) & (4 * (F.col("out") + F.col("f.out")) <= F.col("size")))
    return found.select(F.col("node").alias("a"), F.col("f.node").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, root the least node of its component.

    Large-star and small-star steps alternate until nothing changes: each step links the neighbours of a node to the
    least of them, and the number of steps grows with the logarithm of the number of nodes. The links of a hub are
    dealt out to several tasks.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    found, first = written(edges, "star")
    edges, last = written(contracted(found, found.count()), "star")
    removed(first)
    before, size = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = starred(both, both.filter("v > u"), size)
        small = starred(large, large, size)
        edges, path = written(small, "star")
        removed(last)
        last = path
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, size = tuple(state), state[0]


def forests(edges: DataFrame) -> DataFrame:
    """(u, v) with the same components: of some HELD edges (u, v) that follow each other in a task, those that link a node to the least it can reach by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def linked() -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            ids, place = np.unique(np.r_[u, v], return_inverse=True)
            own = Links(len(ids))
            own.add(place[:len(u)], place[len(u):])
            own.reduce()
            moved = np.flatnonzero(own.parent != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[own.parent[moved]])], ["u", "v"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size >= HELD:
                yield linked()
                size = 0
        if held:
            yield linked()

    return edges.mapInArrow(run, "u bigint, v bigint")


def contracted(edges: DataFrame, size: int) -> DataFrame:
    """Distinct (u, v) with the same components: tasks of some GATHERED of the ``size`` edges each keep a forest.

    Tasks that found the same group in different ways leave several links a node; most of these go here.
    """
    return forests(edges.repartition(max(1, -(-size // GATHERED)))).distinct()


def starred(around: DataFrame, moved: DataFrame, size: int) -> DataFrame:
    """Distinct (u, v): the neighbours v of u in ``moved``, and u itself, linked to the least m of u and its neighbours in ``around``."""
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    met = spread_join(moved, least.select("u", "m"), "u", hot_keys(least, "u", 2 * size), [F.col("v")])
    ends = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return ends.filter("u <> v").distinct()


def grouped(docs: DataFrame, shingle: int, max_bits: int, total: int | None = None, least: int = 0) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) of every row of ``docs``.

    ``component`` stands for the component and component_id is its least doc_id. Null texts count as empty; texts without
    words have fingerprint zero. Rows with equal fingerprints are linked whatever their doc_id; those of fewer than
    ``least`` shingles are linked to no others by their bits. With ``total``, texts of at most SHORT distinct shingles are
    linked by their shingles besides. A null doc_id is never the least, unless a component has no other. An
    empty table gives an empty result.
    """
    second = total is not None
    rows = stored(fingerprints(docs, shingle, second).withColumn("node", node_of(second)), "simhash-rows")
    nodes = stored(rows.groupBy("node", "fp", "fp2").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")), "simhash-nodes")
    edges = links(nodes.filter(F.col("n") >= least).select("fp", "fp2"), max_bits, total)
    if second:
        edges = edges.unionByName(short_links(stored(rows.filter("few is not null").select("node", "few").distinct(), "simhash-short")))
    comp = stored(components(edges), "simhash-components")
    comp = comp.unionByName(comp.select(F.col("root").alias("node"), "root")).distinct()
    joined = nodes.select("node", "least").join(comp, "node", "left").select("node", "least", F.coalesce("root", "node").alias("component"), F.col("root").isNotNull().alias("linked"))
    joined = stored(joined, "simhash-joined")
    best = joined.filter("linked").groupBy("component").agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("n"))
    labels = spread_join(joined, best.select("component", "best"), "component", hot_keys(best, "component", nodes.count()), [F.col("node")], "left")
    labels = labels.select("node", "component", F.when(F.col("linked"), F.col("best")).otherwise(F.col("least")).alias("component_id"))
    # A group of equal texts has one fingerprint, and its rows go to several tasks.
    hot = hot_keys(nodes.groupBy("node").agg(F.sum("rows").alias("n")), "node", rows.count())
    found = spread_join(rows.select("doc_id", "text_hash", "fp", "node"), labels, "node", hot, [F.col("doc_id"), F.col("text_hash")])
    return found.select("doc_id", "text_hash", "fp", "component", "component_id")


def groups_digest(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return grouped(docs, shingle, max_bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 hashes of the text's shingles, sorted; none where it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    size = min(shingle, len(words))
    digest, stops = xxhash.xxh64_intdigest, (ends[size - 1:] - 1).tolist()
    found = {digest(joined[a:b], SEED) for a, b in zip([0, *ends[:-1].tolist()], stops)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    edges = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values.view(np.int64)))


def sketch(hashes: np.ndarray) -> bytes:
    """At least SKETCH bits, and one or two a hash, each the parity of the hashes that fall on it: sets differ in no fewer elements than their sketches differ in bits."""
    bits = max(SKETCH, 1 << (2 * len(hashes) + 1).bit_length() - 1)
    parity = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch in words of 64 bits, of ``size`` bytes: that of the same set for fewer bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; their places from the least to the most frequent) of shingles that several of about SAMPLED_TEXTS texts hold.

    They come last in a text's order. Which these are decides how much meets at a shingle, and nothing of the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                found = [shingle_set(t.as_py(), shingle) for t in batch.column(0).slice(at, TEXTS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    share = max(1, -(-docs.count() // SAMPLED_TEXTS))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("text")
    counts = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    most = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    hashes = most.column(0).to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - 1 - order)


def set_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, node, n, sketch, short, front) of every row: a hash of the set of its shingles, their number, the sketch, its fold to SKETCH bits, and the shingles it may be met by.

    Two sets of a similarity of 0.8 or more share 0.8 of the elements of either, so, whatever the order of all elements,
    they share one of the first n - ceil(0.8 n) + 1 of either: the front.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = frequent.value

        def front(s: np.ndarray) -> np.ndarray:
            size = len(s) - -(-4 * len(s) // 5) + 1 if len(s) else 0
            if not len(hashes):
                return s[:size]
            at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
            often = hashes[at] == s
            rare = s[~often]
            return rare[:size] if len(rare) >= size else np.concatenate([rare, s[often][np.argsort(places[at[often]])]])[:size]

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                sets = [shingle_set(t.as_py(), shingle) for t in some.column(2)]
                sketches = [*map(sketch, sets)]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary()), pa.array([folded(x, SKETCH // 8).tobytes() for x in sketches], pa.binary()), lists_of([*map(front, sets)])],
                    ["doc_id", "text_hash", "node", "n", "sketch", "short", "front"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, n bigint, sketch binary, short binary, front array<bigint>")


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches differ in no more bits than sets of a similarity of 0.8 differ in elements: a ninth of both sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                    size = min(len(x), len(y))
                    apart.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)))
                near = 9 * np.array(apart) <= batch.column(3).to_numpy() + batch.column(5).to_numpy()
                yield batch.select([0, 1]).filter(pa.array(near))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n").alias(f"n_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "n_a", "sketch_b", "n_b")
    return met.mapInArrow(run, "a bigint, b bigint")


def similar_pairs(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of nodes whose sets have a similarity of 0.8 or more, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                yield pa.RecordBatch.from_arrays([some.column(0), lists_of([shingle_set(t.as_py(), shingle) for t in some.column(1)])], ["node", "hashes"])

    pairs = stored(pairs, "similar-candidates")
    size = pairs.count()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_hash"), "node")
    wanted = wanted.select("node", F.col("text_hash").alias("_hash"))
    texts = docs.select(F.xxhash64("text").alias("_h"), "text")
    texts = texts.join(F.broadcast(wanted) if 2 * size <= BROADCAST_ROWS else wanted, F.col("_h") == F.col("_hash")).select("node", "text").dropDuplicates(["node"])
    sets = stored(texts.mapInArrow(run, "node bigint, hashes array<bigint>"), "similar-sets")
    for c in ("a", "b"):
        hot = hot_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, size)
        pairs = spread_join(pairs, sets.select(F.col("node").alias(c), F.col("hashes").alias(f"set_{c}")), c, hot, [F.col("a"), F.col("b")])
    both = F.size(F.array_intersect("set_a", "set_b"))
    return stored(pairs.filter(9 * both >= 4 * (F.size("set_a") + F.size("set_b"))).select("a", "b"), "similar-links")


def met_pairs(n: np.ndarray, pos: np.ndarray, words: np.ndarray, comp: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the rows of one shingle, sorted by n, that lie in different components and may be similar; with ``side``, of different sides.

    Where the shingle is the first that two sets share, they differ in all before it, so two sets that are similar have no more than a ninth of both sizes there.
    """
    last, at = np.searchsorted(4 * n, 5 * n, side="right"), 0
    while at < len(n):
        upto = min(len(n), at + max(1, BLOCK // max(1, int(last[at]) - at)))
        stop = int(last[upto - 1])
        some = np.arange(at, upto)
        near = (comp[some, None] != comp[None, at:stop]) & (some[:, None] < np.arange(at, stop)[None, :])
        if side is not None:
            near &= side[some, None] != side[None, at:stop]
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        near = (4 * n[j] <= 5 * n[i]) & (9 * (pos[i] + pos[j]) <= n[i] + n[j])
        i, j = i[near], j[near]
        near = 9 * np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
        yield i[near], j[near]
        at = upto


def crossing_pairs(met: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b), distinct: the nodes that share a key of ``met`` (key, node, pos), lie in different components and may be similar by size and sketch.

    A key of more than MEETING nodes is dealt out by pairs of its parts.
    """
    rows = nodes.join(comp, "node", "left").select("node", "n", "short", F.coalesce("root", "node").alias("comp"))
    parts = met.join(rows.select("node", "comp"), "node").groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    parts = parts.filter("low < high").select(F.col("key").alias("_key"), F.ceil(F.col("c") / MEETING).alias("parts"))
    dealt = met.join(parts, F.col("key") == F.col("_key")).withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (F.col("own") > F.col("other")).cast("bigint").alias("side"), "node", "pos")
    dealt = dealt.join(rows, "node").repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "first", "second", "side", "node", "n", "pos", "comp")
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            sketches = b"".join(batch.column(batch.schema.get_field_index("short")).to_pylist())
            return (*[batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names], np.frombuffer(sketches, np.uint64).reshape(-1, SKETCH // 64))

        def joined(key, first, second, side, node, n, pos, comp, words) -> Iterator[pa.RecordBatch]:
            lo = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            found, count = [], 0
            for a, b in zip(lo.tolist(), [*lo[1:].tolist(), len(key)]):
                if b - a < 2 or (comp[a:b] == comp[a]).all():
                    continue
                for i, j in met_pairs(n[a:b], pos[a:b], words[a:b], comp[a:b], side[a:b] if first[a] != second[a] else None):
                    x, y = node[a:b][i], node[a:b][j]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                    count += len(x)
                    if count >= HELD:
                        yield pairs_of(found)
                        count = 0
            if count:
                yield pairs_of(found)

        def pairs_of(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(rows_of(batch))
            size += batch.num_rows
            if size >= GATHERED // 4:
                rows = tuple(np.concatenate(x) for x in zip(*held))
                ends = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]))
                cut = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on
                if cut:
                    yield from joined(*(x[:cut] for x in rows))
                held, size = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
        if held:
            yield from joined(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        released()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def crowds(keyed: DataFrame) -> DataFrame:
    """(key, node, pos, c, hubs) of the rows of ``keyed`` (key, node, n, pos) whose key has other rows: c of them, and HUBS of their nodes that the node may be similar to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def met(key: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
            lo = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            c = np.diff(np.r_[lo, len(key)])
            some = np.repeat(c, c) > 1
            key, node, n, pos, c = key[some], node[some], n[some], pos[some], c[c > 1]
            lo = np.cumsum(c) - c
            hubs = []
            for r in range(HUBS if len(c) else 0):
                mixed = node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * r * 0x51ED270B7A3F9D17 & 0xFFFFFFFFFFFFFFFF | 1)
                at = np.repeat(np.flatnonzero(mixed == np.repeat(np.minimum.reduceat(mixed, lo), c)), c)
                near = (4 * n <= 5 * n[at]) & (4 * n[at] <= 5 * n) & (9 * (pos + pos[at]) <= n + n[at])
                hubs.append(np.where(near, node[at], node))
            found = list(np.stack(hubs, axis=1).view(np.uint64)) if hubs else []
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(pos), pa.array(np.repeat(c, c)), lists_of(found)], ["key", "node", "pos", "c", "hubs"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(4)))
            size += batch.num_rows
            if size >= GATHERED:
                rows = tuple(np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
                if cut:
                    yield met(*(x[:cut] for x in rows))
                held, size = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
        if size:
            yield met(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        released()

    dealt = keyed.select("key", "node", "n", "pos").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key bigint, node bigint, pos bigint, c bigint, hubs array<bigint>")


def similar_groups(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, component) of every row: texts whose sets of shingles have a similarity of 0.8 or more are linked, exactly these.

    Sets meet at the shingles of their fronts. First each is held against HUBS of those that it meets at a shingle, which
    connects most groups; then all pairs that meet and aren't connected yet are held against each other, so that no link
    between different components is left out and nothing grows with the square of a group that is connected. Sizes and sketches
    pass over pairs that can't be similar; those that remain are compared by their sets.
    """
    rows = stored(set_rows(docs, shingle), "similar-rows")
    nodes = stored(rows.dropDuplicates(["node"]).select("node", "text_hash", "n", "sketch", "short", "front"), "similar-nodes")
    keyed = nodes.select("node", "n", F.posexplode("front").alias("pos", "key")).withColumn("pos", F.col("pos").cast("bigint"))
    crowd = stored(crowds(keyed), "similar-crowd")
    pairs = crowd.select("node", F.explode("hubs").alias("hub")).filter("node <> hub")
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    first = similar_pairs(docs, nodes, sketched(pairs, nodes), shingle)
    comp = stored(with_roots(components(first)), "similar-components")
    # At a shingle of two nodes, the hub met the other.
    rest = crossing_pairs(crowd.filter("c > 2").select("key", "node", "pos"), nodes, comp)
    second = similar_pairs(docs, nodes, sketched(rest, nodes), shingle)
    comp = stored(with_roots(components(first.unionByName(second))), "similar-components")
    hot = hot_keys(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node", rows.count())
    known = nodes.select("node").join(comp, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    return spread_join(rows.select("doc_id", "text_hash", "node"), known, "node", hot, [F.col("doc_id"), F.col("text_hash")]).select("doc_id", "text_hash", "component")


def with_roots(comp: DataFrame) -> DataFrame:
    """``comp`` (node, root) and a row for each root."""
    return comp.unionByName(comp.select(F.col("root").alias("node"), "root")).distinct()


def deduplicated(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of ``docs`` per component, that of the least doc_id, with the columns of ``docs``, whatever their names.

    Texts are linked if their sets of shingles have a Jaccard similarity of 0.8 or more, and no others. Of rows with the same
    doc_id, that of the least hash of its text stays; of rows that also share their text, the one whose columns, written
    as JSON, come first. Null and empty texts are one group.
    """
    rows = similar_groups(docs, shingle)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    kept_id, kept_hash, text_hash, doc = fresh(docs, "kept_id", "kept_hash", "text_hash", "doc")
    keep = first.select(F.col("f.doc_id").alias(kept_id), F.col("f.text_hash").alias(kept_hash))
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    found = keyed.join(keep, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(text_hash) == F.col(kept_hash)), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = found.groupBy("doc_id", text_hash).agg(F.min_by(whole, F.to_json(whole)).alias(doc))
    return one.select(*[F.col(doc).getField(c).alias(c) for c in docs.columns])

"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of 64 bits are linked at ``radius`` or fewer differing bits; documents are classed by
the connected components of these links.

The join works on distinct fingerprints, so that a group of copies is one. To spread it, the bits
are cut into radius + 2 blocks: two fingerprints within the radius agree on two whole blocks at
least, whichever these are. One table a pair of blocks holds every fingerprint with those blocks
moved to the front; rows that agree there are the leaves of one subtrie. A task reads its subtries
in order and joins each with itself: node pairs are traversed together from the top, differing bits
add up, and a pair is dropped once they exceed the radius. This is exact: there is no cap on a
subtrie or on partners, a subtrie too large for a task is dealt into chunks whose pairs are joined in tasks of
their own (``_groups``), and pairs of any number are worked off in bounded pieces. Links leave a task
as a spanning forest, at most one a fingerprint, which connects whatever its pairs connect.

Cases: very long texts are read whole; texts without words have fingerprint 0; null texts are empty; repeated rows share a
component; null doc_ids never name a component that has another id (a component with none has a
null id); empty tables give empty results; other columns are ignored (and kept by ``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import map_texts
from ._common import cut, documents, parts_of
from ._graph import components
from ._groups import column, in_blocks, ranges, whole_groups
from ._simhash import fingerprint, shingle_hashes

#: Node pairs traversed at once, and rows read before whole subtries are joined: bound a task's memory.
PIECE = 50_000


def with_fingerprint(docs: DataFrame, words: int, keys: list[str]) -> DataFrame:
    """``keys`` of docs, and fingerprint: the 64 bits as a signed long."""

    def prints(texts: list[str | None]) -> list[pa.Array]:
        found = np.fromiter((fingerprint(shingle_hashes(t, words)) for t in texts), np.uint64, len(texts))
        return [pa.array(found.view(np.int64))]

    return map_texts(docs, keys, prints, "fingerprint long")


def tables(radius: int) -> list[list[tuple[int, int]]]:
    """For each table the order of its blocks, as (first bit from the left, width)."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [[blocks[i], blocks[j], *(x for k, x in enumerate(blocks) if k not in (i, j))] for i, j in combinations(range(n), 2)]


def _moved(v: Column, order: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The word with its blocks in this order, and its first two blocks."""
    out, room = F.lit(0).cast("long"), 64
    for first, width in order:
        block = F.shiftrightunsigned(F.shiftleft(v, first), 64 - width)
        room -= width
        out = out.bitwiseOR(F.shiftleft(block, room))
    return out, F.shiftrightunsigned(out, 64 - order[0][1] - order[1][1])


def self_join(v: np.ndarray, depth: int, starts: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of sorted words v within the radius, for subtries [start, end) of words that agree
    in their first ``depth`` bits. A node is a range of v."""
    wide = ends - starts > 1
    lo, hi = starts[wide], ends[wide]
    return traverse(v, v, depth, (lo, hi, lo, hi), radius)


def traverse(va: np.ndarray, vb: np.ndarray, depth: int, nodes: tuple[np.ndarray, ...], radius: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of va and vb within the radius, below pairs of nodes (start, end in va, start, end in vb)
    whose words agree in their first ``depth`` bits. Words are sorted, and only their first ``bits``
    bits count. If va is vb, nodes are the same or disjoint, and a pair comes once."""
    self_ = va is vb
    mask = ~np.uint64(0) << np.uint64(64 - bits)
    todo = [(depth, *nodes, np.zeros(len(nodes[0]), np.int8))]
    while todo:
        d, a, a_end, b, b_end, err = todo.pop()
        if len(a) > PIECE:
            at = len(a) // 2
            todo += [(d, *(x[s] for x in (a, a_end, b, b_end, err))) for s in (slice(None, at), slice(at, None))]
            continue
        leaf = (a_end - a == 1) & (b_end - b == 1)
        i, j = a[leaf], b[leaf]
        near = np.bitwise_count((va[i] ^ vb[j]) & mask) <= radius
        if self_:
            near &= i != j
        if near.any():
            yield i[near], j[near]
        a, a_end, b, b_end, err = (x[~leaf] for x in (a, a_end, b, b_end, err))
        if not len(a):
            continue
        if d == bits:  # all words of a node are equal
            yield from _products(a, a_end, b, b_end, self_)
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        ones = ~(bit | (bit - np.uint64(1)))
        a_mid, b_mid = np.searchsorted(va, (va[a] & ones) | bit), np.searchsorted(vb, (vb[b] & ones) | bit)
        apart = (a != b) if self_ else np.ones(len(a), bool)
        steps = [
            (a, a_mid, b, b_mid, err), (a_mid, a_end, b_mid, b_end, err), (a, a_mid, b_mid, b_end, err + 1),
            tuple(x[apart] for x in (a_mid, a_end, b, b_mid, err + 1)),
        ]
        a, a_end, b, b_end, err = (np.concatenate(x) for x in zip(*steps))
        live = (a_end > a) & (b_end > b) & (err <= radius)
        if self_:
            live &= (a != b) | (a_end - a > 1)
        todo.append((d + 1, *(x[live] for x in (a, a_end, b, b_end, err))))


def _products(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, self_: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs between two ranges, for each pair of ranges."""
    for lo, hi, start, end in zip(a.tolist(), a_end.tolist(), b.tolist(), b_end.tolist()):
        rows = max(1, PIECE // (end - start))
        for at in range(lo, hi, rows):
            up = min(hi, at + rows)
            i, j = np.repeat(np.arange(at, up), end - start), np.tile(np.arange(start, end), up - at)
            once = i < j if self_ and lo == start else slice(None)
            yield i[once], j[once]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n indices is connected with."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _join_subtries(depths: list[int], radius: int):
    """Links of the rows (t, key, i, j, c, v, word), sorted, as a spanning forest of each block."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(word: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = np.flatnonzero(root != np.arange(len(word)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(word[own]), pa.array(word[root[own]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 4, PIECE):
            starts, ends = ranges(rows, 4)
            table, key, i, j, c, v, word = (column(rows, k) for k in range(7))
            v = v.view(np.uint64)
            # subtries that are one block: all of a table at once, as their words are in order
            again = np.r_[False, (table[starts[1:]] == table[starts[:-1]]) & (key[starts[1:]] == key[starts[:-1]])]
            plain = (i[starts] == j[starts]) & ~again & ~np.r_[again[1:], False]
            for t in np.unique(table[starts[plain]]):
                of = plain & (table[starts] == t)
                size = (ends - starts)[of]
                at = np.r_[0, np.cumsum(size)]
                own = np.repeat(starts[of] - at[:-1], size) + np.arange(at[-1])
                root = _forest(len(own), self_join(v[own], depths[t], at[:-1], at[1:], radius))
                yield from linked(word[own], root)
            for s, e in zip(starts[~plain].tolist(), ends[~plain].tolist()):
                yield from linked(word[s:e], _forest(e - s, _of_block(v[s:e], i[s], j[s], c[s:e], depths[table[s]], radius)))

    return run


def _of_block(v: np.ndarray, i: int, j: int, c: np.ndarray, depth: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius of one block of a subtrie."""
    if i == j:
        yield from self_join(v, depth, np.array([0]), np.array([len(v)]), radius)
        return
    x, y = np.flatnonzero(c == i), np.flatnonzero(c == j)
    if len(x) and len(y):
        for a, b in traverse(v[x], v[y], depth, tuple(np.array([k]) for k in (0, len(x), 0, len(y))), radius):
            yield x[a], y[b]


def links(prints: DataFrame, radius: int, split: int | None = None) -> DataFrame:
    """prints: (fingerprint), distinct. A table (a, b) that connects all within the radius. split: as ``_groups.SPLIT``."""
    orders = tables(radius)
    rows = []
    for t, order in enumerate(orders):
        v, key = _moved(F.col("fingerprint"), order)
        rows.append(F.struct(F.lit(t).alias("t"), key.alias("key"), v.alias("v")))
    # dealt by subtrie; within a subtrie the sign of v doesn't vary, so that its order is that of its bits
    moved = prints.select("fingerprint", F.explode(F.array(*rows)).alias("x")).select("x.*", F.col("fingerprint").alias("word"))
    blocks = in_blocks(moved, ["t", "key"], "word", len(orders) * prints.count(), split).select("t", "key", "i", "j", "c", "v", "word")
    dealt = blocks.repartition(parts_of(prints), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "v")
    return dealt.mapInArrow(_join_subtries([o[0][1] + o[1][1] for o in orders], radius), "a long, b long")


def classes(rows: DataFrame, radius: int) -> DataFrame:
    """rows: (doc_id, fingerprint, ...), each kept, with component_id: the smallest doc_id connected."""
    prints = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low")))
    roots = components(links(prints.select("fingerprint"), radius))
    merged = cut(roots.join(prints.withColumnRenamed("fingerprint", "node"), "node"))
    lowest = cut(merged.groupBy("root").agg(F.min("low").alias("component_id")))
    known = merged.select("node", "root").join(lowest, "root").select(F.col("node").alias("fingerprint"), "component_id")
    alone = prints.join(known, "fingerprint", "left").select(F.col("fingerprint").alias("f"), F.coalesce("component_id", "low").alias("component_id"))
    alone = cut(alone)  # both sides of the last join are then dealt for it alone, and the rows of one fingerprint may be split
    return rows.join(alone, F.col("fingerprint") == F.col("f")).drop("f")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    return classes(cut(with_fingerprint(docs, words, ["doc_id"])), radius)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")

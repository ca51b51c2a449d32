"""Near-duplicates at a similarity: candidates by SimHash and trie self-joins of probe words, then
the exact Jaccard similarity.

Texts are compared by shingles of five words; texts with the same set of shingles are one node. At a
Jaccard similarity of 0.8 two SimHash fingerprints still differ in 15 % of their bits: far more than a
trie join of the whole fingerprint could allow for. So each fingerprint of 256 bits lends probe words
of 32 bits each (fixed random choices of its bits); each probe's words are joined by a trie self-join
within PROBE_RADIUS bits, below subtries of key bits that agree; and a pair that meets there is a
candidate if the whole fingerprints differ in at most three standard deviations more bits than texts
of the similarity do. The key is as wide as it takes to leave about SUBTRIE rows to a subtrie of unlike
texts, and the number of probes follows from it, so that by the binomial model a pair at the
similarity is a candidate with probability RECALL at every size (``plan``).

What leaves this search is a spanning forest of the candidates: at most one row a node and probe. A large
subtrie is first gathered around pivots: rows that meet a pivot by the same rule as any pair (word
within the radius, fingerprint within the limit) are linked to it at once, and pairs between two such
rows are never looked at. What is connected doesn't depend on the size.

Candidates are no verdict. The nodes that candidates connect are a family, and within a family a pair is a
link only if the Jaccard similarity of its whole sets of shingles is high enough. A family is dealt into
chunks of CHUNK nodes (as many as BYTES of shingles allow), and every two chunks are a block: one
task compares them, in pieces of bounded size, and hands on a spanning forest of the block's links.
So no pair is ever a row, a family of any size is spread over tasks, and all its pairs are compared, which
takes time by the square of the family; large ones have fewer and larger chunks, so that a node is copied
into few blocks (``chunks_of``). Classes are the components of the links.

Cases: as in ``simhash_dedup``. Very long texts are read whole; their shingles are compared in pieces. Texts
without words are all alike; ``keep_one`` keeps the row with the smallest doc_id of each class (null
last, then by text), once if it is repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import map_texts
from ._common import cut, parts_of, text_of
from ._graph import components
from ._groups import column, in_blocks, ranges, whole_groups
from ._simhash import long_fingerprint, shingle_hashes
from .simhash_dedup import PIECE, _forest, traverse

BITS = 256
SHINGLE = 5
SIMILARITY = 0.8
#: Probability by the binomial model that a pair at the similarity is a candidate.
RECALL = 0.99
#: Rows of unlike texts that a subtrie is meant to have, and the least bits of its key.
SUBTRIE = 256
KEY_BITS = 10
PROBE_BITS = 32
PROBE_RADIUS = 3
#: Standard deviations that a candidate's differing bits may lie above the mean.
SLACK = 3.0
#: Rows of a subtrie above which pivots come first.
LARGE = 512
#: Nodes of a chunk of a family, chunks that a family is dealt into by that rule, and bytes of shingles of a chunk beyond it.
CHUNK = 128
MOST_CHUNKS = 24
BYTES = 16 << 20
#: Bytes of a node: its fingerprint, a hash of its set of shingles, and the number of these.
NODE = BITS // 8 + 8 + 8
#: Shingles of a block that are compared at once.
_COLUMNS = 1 << 13


def most_bits(similarity: float, slack: float = 1.25) -> int:
    """Differing bits of texts at a Jaccard similarity (their shingle sets meet at an angle of
    acos(2j / (1 + j))), and as much more as ``slack`` standard deviations."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return int(BITS * p + slack * math.sqrt(BITS * p * (1 - p)))


@cache
def plan(n: int, similarity: float, radius: int) -> tuple[int, int]:
    """Bits of the key and number of probes for n nodes."""
    key = min(PROBE_BITS - radius, max(KEY_BITS, math.ceil(math.log2(max(1, n) / SUBTRIE))))
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    limit, rest = most_bits(similarity, SLACK), PROBE_BITS - key
    share = [math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d) for d in range(limit + 1)]
    # the chance to meet in one probe, given the differing bits
    meet = [(1 - d / BITS) ** key * sum(math.comb(rest, e) * (d / BITS) ** e * (1 - d / BITS) ** (rest - e) for e in range(min(radius, rest) + 1)) for d in range(limit + 1)]
    goal = min(RECALL, 0.995 * math.fsum(share))
    probes = 1
    while math.fsum(s * -math.expm1(probes * math.log1p(-m)) if m < 1 else s for s, m in zip(share, meet)) < goal:
        probes += 1
    return key, probes


@cache
def probe_bits(probes: int) -> np.ndarray:
    """The bits of each probe's word; the first ones are the same for any number of probes."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(BITS)[:PROBE_BITS] for _ in range(probes)])


def node(shingles: np.ndarray) -> bytes:
    """Fingerprint, hash and size of a set of shingles (distinct and sorted)."""
    return long_fingerprint(shingles) + xxhash.xxh64_digest(shingles.tobytes()) + len(shingles).to_bytes(8, "big")


def n_shingles(node: str) -> Column:
    return F.conv(F.hex(F.substring(node, NODE - 7, 8)), 16, 10).cast("long")


def with_nodes(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, h (a hash of the text) and node (binary, of the distinct shingles) of every row."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("h"), "text")
    return map_texts(rows, ["doc_id", "h"], lambda texts: [pa.array([node(np.unique(shingle_hashes(t, words))) for t in texts], pa.binary())], "node binary")


def _prints(nodes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(nodes), np.uint64).reshape(-1, NODE // 8)[:, : BITS // 64]


def _probed(probes: int):
    """(node) to (t, word, node), one row a probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = probe_bits(probes)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.column(0).slice(at, 4096)
                bits = np.unpackbits(np.ascontiguousarray(_prints(part.to_pylist())).view(np.uint8), axis=1)
                for k in range(0, probes, 64):
                    own = places[k : k + 64]
                    words = [np.ascontiguousarray(np.packbits(bits[:, p], axis=1)).view(">u4").ravel().astype(np.int64) for p in own]
                    t = np.repeat(np.arange(k, k + len(own), dtype=np.int32), len(bits))
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.concatenate(words)), pa.concat_arrays([part] * len(own))], ["t", "word", "node"])

    return run


def _distance(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64)


def _pivots(v: np.ndarray, prints: np.ndarray, limit: int, radius: int) -> np.ndarray:
    """For each row the row of the pivot it is linked to, or -1."""
    n = len(prints)
    pivot = np.full(n, -1)
    rest = np.arange(n)
    while len(rest):
        near = _distance(prints, rest, np.full(len(rest), rest[0])) <= limit
        near &= np.bitwise_count(v[rest] ^ v[rest[0]]) <= radius
        if near.sum() < max(2, n // 32):
            break
        pivot[rest[near]] = rest[0]
        rest = rest[~near]
    return pivot


def _met(v: np.ndarray, prints: np.ndarray, limit: int, radius: int, key: int, x: np.ndarray, y: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates between the rows x and y of one subtrie, or among x. v: the words, in the upper half of 64 bits, sorted."""
    vx = v[x]
    vy = vx if y is None else v[y]
    whole = tuple(np.array([k]) for k in (0, len(vx), 0, len(vy)))
    other = x if y is None else y
    for i, j in traverse(vx, vy, key, whole, radius, PROBE_BITS):
        i, j = x[i], other[j]
        near = _distance(prints, i, j) <= limit
        yield i[near], j[near]


def _link_subtrie(v: np.ndarray, prints: np.ndarray, limit: int, radius: int, key: int = KEY_BITS) -> np.ndarray:
    """The smallest index each row of one subtrie is connected with by candidates."""

    def met(x: np.ndarray, y: np.ndarray | None = None):
        return _met(v, prints, limit, radius, key, x, y)

    n = len(v)
    if n <= LARGE:
        return _forest(n, met(np.arange(n)))
    pivot = _pivots(v, prints, limit, radius)
    rest = np.flatnonzero(pivot == -1)
    groups = [np.flatnonzero(pivot == p) for p in np.unique(pivot[pivot >= 0])]

    def pairs():
        own = np.flatnonzero(pivot >= 0)
        yield own, pivot[own]
        if len(rest) > 1:
            yield from met(rest)
        for k, g in enumerate(groups):
            if len(rest):
                yield from met(rest, g)
            for other in groups[k + 1 :]:  # two gathered groups are one after a single link
                yield from ((i[:1], j[:1]) for i, j in islice(((i, j) for i, j in met(g, other) if len(i)), 1))

    return _forest(n, pairs())


def _in_subtries(limit: int, radius: int, key_bits: int):
    """Candidates (a, b) of the rows (t, key, i, j, c, word, node), sorted, as a spanning forest of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 4, PIECE):
            starts, ends = ranges(rows, 4)
            i, j, c, word = (column(rows, k) for k in (2, 3, 4, 5))
            v = word.astype(np.uint64) << np.uint64(64 - PROBE_BITS)
            nodes = rows.column(6)
            prints = _prints(nodes.to_pylist())
            own, root = [], []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                if i[s] == j[s]:
                    found = _link_subtrie(v[s:e], prints[s:e], limit, radius, key_bits)
                else:
                    x, y = np.flatnonzero(c[s:e] == i[s]), np.flatnonzero(c[s:e] == j[s])
                    found = _forest(e - s, _met(v[s:e], prints[s:e], limit, radius, key_bits, x, y) if len(x) and len(y) else iter(()))
                linked = np.flatnonzero(found != np.arange(e - s))
                own.append(s + linked)
                root.append(s + found[linked])
            if own:
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(np.concatenate(k))).combine_chunks() for k in (own, root)], ["a", "b"])

    return run


def candidates(nodes: DataFrame, similarity: float, radius: int = PROBE_RADIUS, split: int | None = None) -> DataFrame:
    """nodes: (node binary), distinct. A table (a, b) that connects all candidates. split: as ``_groups.SPLIT``."""
    n = nodes.count()
    key_bits, probes = plan(n, similarity, radius)
    probed = nodes.mapInArrow(_probed(probes), "t int, word long, node binary").withColumn("key", F.shiftright("word", PROBE_BITS - key_bits))
    blocks = in_blocks(probed, ["t", "key"], "node", n * probes, split).select("t", "key", "i", "j", "c", "word", "node")
    dealt = blocks.repartition(parts_of(nodes), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "word")
    return dealt.mapInArrow(_in_subtries(most_bits(similarity, SLACK), radius, key_bits), "a binary, b binary")


def _row_key(doc_id: Column, h: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), h.cast("string"))


def _least() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and its set of shingles (64-bit numbers in a row), for nodes (node, x); one text a node is read."""
    keys = cut(nodes.select(_row_key(F.col("x.doc_id"), F.col("x.h")).alias("key")).distinct())
    texts = docs.select(_row_key(F.col("doc_id"), F.xxhash64(text_of())).alias("key"), "text").join(keys, "key", "left_semi")

    def sets(texts: list[str | None]) -> list[pa.Array]:
        found = [np.unique(shingle_hashes(t, words)) for t in texts]
        return [pa.array([node(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())]

    return map_texts(texts, [], sets, "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def chunks_of(n: Column, shingles: Column) -> Column:
    """Chunks of a family of n nodes that have so many shingles together."""
    return F.greatest(F.lit(1), F.least(F.ceil(n / CHUNK), F.lit(MOST_CHUNKS)), F.ceil(shingles * 8 / BYTES)).cast("int")


def alike(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets x and y of a list have this Jaccard similarity at least: a matrix x by y."""
    size = np.array([len(s) for s in sets])
    values, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # shingles of one set only meet nothing; the others in pieces of columns
    shared = n > 1
    place = np.cumsum(shared) - 1
    of = np.repeat(np.arange(len(sets)), size)[shared[column]]
    column = place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[of[a:b], column[a:b] - at] = 1
        both += held[x] @ held[y].T
    both = both.astype(np.float64)
    either = size[x][:, None] + size[y][None, :] - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0) >= similarity


def _in_blocks(similarity: float):
    """Links (a, b) of each block as a spanning forest; rows are sorted by family and block."""

    def whole(rows: list[tuple]) -> tuple[list[bytes], list[bytes]]:
        i, j = rows[0][1:3]
        nodes = [r[4] for r in rows]
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        chunk = np.array([r[3] for r in rows])
        x = np.flatnonzero(chunk == i)
        y = x if i == j else np.flatnonzero(chunk == j)
        if not len(x) or not len(y):
            return [], []

        def pairs():
            for at in range(0, len(x), CHUNK):
                for to in range(0, len(y), CHUNK):
                    own, other = x[at : at + CHUNK], y[to : to + CHUNK]
                    both = np.unique(np.r_[own, other])
                    hit = alike([sets[k] for k in both.tolist()], np.searchsorted(both, own), np.searchsorted(both, other), similarity)
                    a, b = np.nonzero(hit)
                    yield own[a], other[b]

        root = _forest(len(rows), pairs())
        linked = np.flatnonzero(root != np.arange(len(root))).tolist()
        return [nodes[k] for k in linked], [nodes[root[k]] for k in linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            a, b = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    more = whole(held)
                    a += more[0]
                    b += more[1]
                    held = []
                held.append(row)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        if held:
            a, b = whole(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def links(docs: DataFrame, least: DataFrame, similarity: float, words: int, radius: int = PROBE_RADIUS, split: int | None = None) -> DataFrame:
    """least: (node, x), every node of docs with its least row. A table (a, b) that connects the pairs of a family
    that are similar enough."""
    family = components(candidates(least.select("node"), similarity, radius, split))
    sizes = cut(family.groupBy("root").agg(chunks_of(F.count(F.lit(1)), F.sum(n_shingles("node"))).alias("m")).select(F.col("root").alias("r"), "m"))
    # cut: a large family's rows may then be split in the join
    family = cut(cut(family).join(sizes, F.col("root") == F.col("r")).select(F.col("node").alias("f"), F.xxhash64("root").alias("family"), "m"))
    sets = _sets(docs, least.join(family, F.col("node") == F.col("f"), "left_semi"), words).join(family, F.col("node") == F.col("f"))
    own = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("m")).cast("int")
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct(F.least(k, F.col("c")).alias("i"), F.greatest(k, F.col("c")).alias("j"))))
    blocks = sets.withColumn("c", own).select("family", "c", "node", "shingles", other.alias("x")).select("family", "x.i", "x.j", "c", "node", "shingles")
    dealt = blocks.repartition(parts_of(docs), "family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.mapInArrow(_in_blocks(similarity), "a binary, b binary")


def _classed(docs: DataFrame, similarity: float, words: int, split: int | None) -> tuple[DataFrame, DataFrame]:
    """``with_nodes`` of docs, and (f, x, class): every node with its least row and the smallest node connected."""
    rows = cut(with_nodes(docs, words))
    least = cut(rows.groupBy("node").agg(_least().alias("x")))
    found = components(links(docs, least, similarity, words, split=split)).select(F.col("node").alias("f"), F.col("root").alias("class"))
    named = least.join(found, F.col("node") == F.col("f"), "left")
    return rows, cut(named.select(F.col("node").alias("f"), "x", F.coalesce("class", "node").alias("class")))


def classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE, split: int | None = None) -> DataFrame:
    """doc_id, h, node and class (the smallest node connected) of every row."""
    rows, named = _classed(docs, similarity, words, split)
    return rows.join(named.drop("x"), F.col("node") == F.col("f")).drop("f")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, one a class, with the columns of ``docs``. Texts are shuffled
    twice: to compare families, and to return rows (only those that have the id and text of one that stays)."""
    _, named = _classed(docs, similarity, words, None)
    stay = named.groupBy("class").agg(F.min("x").alias("x")).select(_row_key(F.col("x.doc_id"), F.col("x.h")).alias("key"))
    stay = cut(stay.distinct())
    rows = docs.select(_row_key(F.col("doc_id"), F.xxhash64(text_of())).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return rows.join(stay, "key", "left_semi").withColumn("turn", turn).where("turn = 1").select("row.*")

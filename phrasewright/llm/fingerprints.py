"""Document fingerprints: weighted SimHash of 256 bits, and search by permuted block tables.

Terms are shingles of five words (weight 1 each time they stand in the text) and single words (a
weight that grows with their length, since short words are common ones). Each term's hash votes with
its weight on every signed bit. Equal texts have equal fingerprints; the share of equal bits grows
with the share of weight two texts have in common.

``counts_within`` finds, for every fingerprint, all documents whose fingerprint lies within a Hamming
radius of it, counted over all 256 bits. The bits are cut into radius + 1 blocks of whole bytes: of two
fingerprints within the radius one block at least agrees, whichever it is. One table a block is dealt by this
block, moved to the front, and all of a table's rows that agree there are compared, in pieces of bounded
size (more than a task can hold: in blocks, see ``_groups``). A pair that agrees in several tables counts in the first. Copies are one row with a count.

Cases: null texts are empty; very long texts are read whole, their terms vote in pieces; texts without
words have fingerprint 0, alike to each other; ids are numbers; equal ids are ordered by text, null ids come
last; repeated rows get a row each, and the only row of a table is its own next one; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import map_texts, slices
from ._common import cut, documents, parts_of, written
from ._groups import column, in_blocks, ranges, whole_groups
from ._simhash import _MIX

BITS = 256
SHINGLE = 5
WORD_WEIGHT = 0.3
#: Differing bits of the whole fingerprint up to which documents are near.
RADIUS = 7
#: Terms whose bits are unpacked at once; pairs compared at once.
_PIECE = 1 << 15


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the terms of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64), np.empty(0, np.float32)
    digest = xxhash.xxh64_intdigest
    runs = [b" ".join(w)] if len(w) <= SHINGLE else map(b" ".join, zip(*(w[i:] for i in range(SHINGLE))))
    hashes = [digest(x, 42) for x in runs]
    n = len(hashes)
    hashes += [digest(x, 43) for x in w]
    weights = np.ones(len(hashes), np.float32)
    weights[n:] = np.minimum(np.fromiter(map(len, w), np.float32, len(w)), 12) * (WORD_WEIGHT / 12)
    return np.array(hashes, np.uint64), weights


def fingerprint(text: str | None) -> bytes:
    """32 bytes; zeros without words."""
    h, w = terms(text)
    if not len(h):
        return bytes(BITS // 8)
    votes = np.zeros((len(_MIX), 64))
    for at in range(0, len(h), _PIECE):
        part, weight = h[at : at + _PIECE], w[at : at + _PIECE]
        for k, m in enumerate(_MIX):
            x = part * m
            x ^= x >> np.uint64(32)
            x *= m
            x ^= x >> np.uint64(29)
            votes[k] += weight @ np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, 64).astype(np.float32)
    return np.packbits(votes.ravel() * 2 > w.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def with_fingerprint(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of docs and fingerprint (binary)."""
    return map_texts(docs, keys, lambda texts: [pa.array([fingerprint(t) for t in texts], pa.binary())], "fingerprint binary")


def _bucketed(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, extra: documents in buckets of neighbouring ids, and in each bucket at
    its end (extra = 1) the documents that follow it in descending order of ids.

    Ranges come from percentiles of all ids; their number is that of the partitions, so what is
    collected for them doesn't grow with a partition's content.
    """
    n = 4 * parts_of(docs)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    steps, step = [], 1
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    if cuts:
        # a binary search: how many cuts are at or below the id
        at = F.array(*[F.lit(int(c)) for c in cuts])
        found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when(F.coalesce(F.get(at, lo + s - 1) <= F.col("doc_id"), F.lit(False)), lo + s).otherwise(lo))
    else:
        found = F.lit(0)
    placed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.when(F.col("doc_id").isNull(), -1).otherwise(found).alias("bucket"))
    tops = sorted((r["bucket"], r["top"]) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    follows = [(top, up[0]) for (_, top), up in zip(tops, tops[1:] + tops[:1])]  # the greatest of all follows the last bucket
    heads = docs.sparkSession.createDataFrame(follows, f"head {dict(docs.dtypes)['doc_id']}, upper int")
    met = placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra"))
    places = F.when(F.col("upper").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("upper").alias("bucket"), F.lit(1).alias("extra"))))
    return met.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "p.bucket", "p.extra", F.col("text").alias("_text"))


def edited(text: str, following: str) -> str:
    """The last third of a text's code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprints of text and edited text (all three binary), near_edited, near_next.

    Texts are shuffled once, by ranges of ids.
    """
    rows = _bucketed(docs)
    dealt = rows.repartition(parts_of(docs), "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "_text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def row(i, text, print_, following, next_print):
        new = edited(text, following)
        p = fingerprint(new)
        return i, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest(), print_, p, likeness(print_, p), likeness(print_, next_print)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        held = None  # the last row whose next one hasn't come
        closed = None  # the bucket whose next rows aren't needed any more
        for batch in batches:
            kinds = batch.schema.field(0).type
            for part in slices(batch):
                out = []
                for i, bucket, extra, text in zip(*(c.to_pylist() for c in part.columns)):
                    if extra and bucket == closed:
                        continue
                    text = text or ""
                    p = fingerprint(text)
                    if held is not None:
                        out.append(row(*held, text, p))
                    held = None if extra else (i, text, p)
                    closed = bucket if extra else None
                if out:
                    cols = list(zip(*out))
                    types = [kinds, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    kind = dict(docs.dtypes)["doc_id"]
    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def tables(radius: int) -> list[tuple[int, int]]:
    """The block in front of each table, as (first byte, bytes)."""
    edges = [BITS // 8 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _compare(radius: int):
    """Counts of the rows (t, key, i, j, c, fingerprint, n), sorted, within each block; key is a hash of the
    bytes in front, which are compared as well."""
    masks = []
    for first, width in tables(radius):
        mask = np.zeros(BITS // 8, np.uint8)
        mask[first : first + width] = 255
        masks.append(mask.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 4):
            starts, ends = ranges(rows, 4)
            table, i, j, c, n = (column(rows, k) for k in (0, 2, 3, 4, 6))
            prints = rows.column(5).to_pylist()
            words = np.frombuffer(b"".join(prints), np.uint64).reshape(-1, BITS // 64)
            total = np.zeros(len(words), np.int64)
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                x, y = s + np.flatnonzero(c[s:e] == i[s]), s + np.flatnonzero(c[s:e] == j[s])
                for at in range(0, len(x), max(1, _PIECE // max(1, len(y)))):
                    own = x[at : at + max(1, _PIECE // max(1, len(y)))]
                    diff = words[own, None] ^ words[None, y]
                    hit = np.bitwise_count(diff).sum(axis=2, dtype=np.int64) <= radius
                    hit &= ((diff & masks[table[s]]) == 0).all(axis=2)
                    for mask in masks[: table[s]]:  # the pair has met before
                        hit &= ((diff & mask) != 0).any(axis=2)
                    if i[s] == j[s]:
                        hit &= own[:, None] != y[None, :]
                    else:
                        total[y] += n[own] @ hit
                    total[own] += hit @ n[y]
            some = np.flatnonzero(total)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([prints[k] for k in some.tolist()], pa.binary()), pa.array(total[some])], ["fingerprint", "found"])

    return run


def counts_within(prints: DataFrame, radius: int = RADIUS, split: int | None = None) -> DataFrame:
    """prints: (fingerprint, n), fingerprints distinct and n their documents. Returns (fingerprint, found): the
    documents with another fingerprint within the radius; those without any are absent. split: as ``_groups.SPLIT``."""
    places = tables(radius)
    at = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(first + 1).alias("first"), F.lit(width).alias("width")) for t, (first, width) in enumerate(places)])
    moved = prints.select("fingerprint", "n", F.explode(at).alias("x"))
    key = F.hash(F.substring("fingerprint", F.col("x.first"), F.col("x.width")))
    moved = moved.select(F.col("x.t").alias("t"), key.alias("key"), "fingerprint", "n")
    blocks = in_blocks(moved, ["t", "key"], "fingerprint", len(places) * prints.count(), split).select("t", "key", "i", "j", "c", "fingerprint", "n")
    dealt = blocks.repartition(parts_of(prints), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    found = dealt.mapInArrow(_compare(radius), "fingerprint binary, found long")
    return found.groupBy("fingerprint").agg(F.sum("found").alias("found"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near: other documents within RADIUS of the 256 bits."""
    rows = written(compare_with_next(documents(spark, sf_dir)))
    prints = cut(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")))
    near = prints.join(counts_within(prints).withColumnRenamed("fingerprint", "f"), F.col("fingerprint") == F.col("f"), "left")
    near = near.select(F.col("fingerprint").alias("f"), (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_near"))
    out = rows.join(cut(near), F.col("fingerprint") == F.col("f"))  # cut: a common fingerprint's rows may then be split
    shown = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", shown("edited_sha256"), shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next", "n_near")

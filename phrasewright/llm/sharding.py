"""Sharding by Karmarkar-Karp differencing: shards of near equal bytes from indivisible groups.

A partial partition is a vector of sums, one a shard. Differencing takes the two partial partitions
with the largest spread (largest less smallest sum) and adds them in opposite order, so that
their spreads cancel, until one is left.

On one machine that is a heap over all groups. Here groups are dealt by hash into blocks of about
``BLOCK``; each block is differenced in a task of its own and leaves one partial partition. Those are
the items of the next level, up to one block at the top: three levels hold 8 * 10^12 groups. A
vector of a lower level keeps its order relative to its own sums, and the final shard of a group
comes from composing the maps of its levels by joins. The driver holds no group and no vector.

Rows of a group meet their shard by a join on the group's key. A group that holds a third of all
rows is one row until then; the join splits its rows. Slots are prefix sums over chunks of a shard.

Cases: null keys (null texts) form one group apart from empty texts; repeated rows are rows of
the same group; an empty table gives an empty result; a group larger than an even share makes its
shard larger, and the other shards are as even as without it. Columns beyond doc_id and text are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, documents, parts_of, text_of

#: Items that one task differences: bounds its memory (about 2 KB an item).
BLOCK = 20_000


def difference(vectors: Sequence[Sequence[int]], k: int) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over vectors of up to ``k`` sums, largest first (the rest are 0).

    Returns the sums of the last partial partition, largest first, and for every vector the place in
    them that each of its own places went to.
    """
    nodes: list[tuple | None] = [None] * len(vectors)
    heap = []
    for i, v in enumerate(vectors):
        sums = list(v) + [0] * (k - len(v))
        heap.append((sums[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heap[0]
        both = sorted(((p + q, j) for j, (p, q) in enumerate(zip(x, reversed(y)))), key=lambda t: (-t[0], t[1]))
        nodes.append((a, b, [j for _, j in both]))
        sums = [s for s, _ in both]
        heapq.heapreplace(heap, (sums[-1] - sums[0], len(nodes) - 1, sums))
    if not heap:
        return [0] * k, []
    _, top, sums = heap[0]
    out: list[list[int]] = [[]] * len(vectors)
    todo = [(top, list(range(k)))]
    while todo:
        node, place = todo.pop()
        if nodes[node] is None:
            out[node] = place
            continue
        a, b, order = nodes[node]
        went = [0] * k
        for p, j in enumerate(order):
            went[j] = place[p]
        todo += [(a, went), (b, went[::-1])]
    return sums, out


_STEP = "id string, parent string, map array<int>, sums array<bigint>"


def _differ(k: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        vectors = [list(v) for v in pdf["sums"]]
        order = sorted(range(len(vectors)), key=lambda i: tuple(-x for x in vectors[i]))
        sums, maps = difference([vectors[i] for i in order], k)
        ids, parent = pdf["id"].tolist(), f"{level}:{pdf['block'].iat[0]}"
        # an item of the lowest level has one place only
        rows = [(ids[i], parent, m[: len(vectors[i])], None) for i, m in zip(order, maps)]
        return pd.DataFrame([*rows, (None, parent, None, sums)], columns=["id", "parent", "map", "sums"])

    return run


def assign(groups: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """groups: (id string, bytes long), ids distinct. Returns (id, shard)."""
    items = groups.select("id", F.array(F.col("bytes").cast("long")).alias("sums"))
    levels: list[DataFrame] = []
    while True:
        n = items.count()
        blocks = max(1, -(-n // block))
        dealt = items.withColumn("block", F.pmod(F.xxhash64("id", F.lit(len(levels))), F.lit(blocks)))
        done = cut(dealt.groupBy("block").applyInPandas(_differ(k, len(levels)), _STEP))
        levels.append(done.where("id IS NOT NULL").select("id", "parent", "map"))
        items = done.where("id IS NULL").select(F.col("parent").alias("id"), "sums")
        if blocks == 1:
            break
    final = levels.pop()
    while levels:
        above = final.select(F.col("id").alias("parent"), F.col("map").alias("above"))
        final = levels.pop().join(above, "parent").select("id", F.transform("map", lambda p: F.get("above", p)).alias("map"))
    return final.select("id", F.get("map", F.lit(0)).alias("shard"))


def shard(docs: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; equal texts share a shard."""
    size = F.octet_length(text_of()).cast("long") + 8
    key = F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.sha2(F.col("text").cast("string"), 256))
    rows = cut(docs.select("doc_id", size.alias("size"), F.crc32(F.encode(text_of(), "utf-8")).alias("text_crc32"), key.alias("id")))
    groups = rows.groupBy("id").agg(F.sum("size").alias("bytes"))
    placed = rows.join(assign(cut(groups), k, block), "id")
    placed = cut(placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "id"), F.lit(parts_of(rows)))))
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("shard", "chunk").orderBy("doc_id", "id")
    slot = F.col("first") + F.row_number().over(inner) - 1
    return placed.join(counts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

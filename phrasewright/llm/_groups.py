"""Groups of rows that one task each would not hold: dealt out in blocks, and read as sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Rows of a group that one task compares with each other, and the most groups that may have more.
SPLIT = 200_000
MOST_LARGE = 1_000_000


def in_blocks(rows: DataFrame, keys: list[str], ident: str, total: int, least: int | None = None) -> DataFrame:
    """Adds i, j and c to rows whose groups, by ``keys``, are to be joined with themselves.

    A group of more rows than the bound is dealt into chunks by a hash of ``ident``; c is a row's chunk,
    and it is copied to the block (i, j) of every two chunks, i <= j, that one of is its own. Blocks are then groups of
    their own: of (i, i) all pairs are to be looked at, of others those between c = i and c = j. Other
    groups are one block. total: the number of rows, at least; the bound grows with it so that
    MOST_LARGE groups at most can be larger, and their table can be broadcast.
    """
    bound = max(SPLIT if least is None else least, total // MOST_LARGE)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound)
    large = cut(sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("n") / bound).cast("int").alias("_m")))
    if large.isEmpty():
        return rows.select("*", *[F.lit(0).alias(x) for x in "ijc"])
    on = None
    for k in keys:
        on = (F.col(k) == F.col(f"_{k}")) if on is None else on & (F.col(k) == F.col(f"_{k}"))
    m = F.coalesce("_m", F.lit(1))
    met = rows.join(F.broadcast(large), on, "left").withColumn("c", F.pmod(F.xxhash64(ident, F.lit("chunk")), m).cast("int"))
    block = F.explode(F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.struct(F.least(k, F.col("c")).alias("i"), F.greatest(k, F.col("c")).alias("j"))))
    return met.select(*rows.columns, "c", block.alias("_x")).select(*rows.columns, "_x.i", "_x.j", "c")


def whole_groups(batches: Iterator[pa.RecordBatch], n: int, least: int = SPLIT) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ``least`` rows that end where a group, by the first n columns, does."""
    held: list[pa.RecordBatch] = []
    rows = due = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least or rows < due:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(rows, bool)
        for k in range(n):
            same &= pc.equal(table.column(k), table.column(k)[-1]).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~same)
        done = int(other[-1]) + 1 if len(other) else 0
        rest = table.slice(done)
        held, rows = rest.to_batches(), rest.num_rows
        due = 2 * rows  # a group that goes on is looked at again when it has doubled
        if done:
            yield table.slice(0, done)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ranges(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the groups by the first n columns."""
    changed = np.zeros(table.num_rows - 1, bool)
    for k in range(n):
        c = table.column(k).combine_chunks()
        changed |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, changed])
    return starts, np.r_[starts[1:], table.num_rows]


def column(table: pa.Table, k: int) -> np.ndarray:
    return table.column(k).to_numpy()

"""Python workers that read texts in Arrow batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handed to a function at once; one longer text goes alone.
BATCH_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str = "_text") -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about BATCH_BYTES of text."""
    i = batch.schema.get_field_index(column)
    at = size = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_pylist()
    for k, n in enumerate(lengths):
        if k > at and size + n > BATCH_BYTES:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n
    if batch.num_rows > at:
        yield batch.slice(at)


def map_texts(docs: DataFrame, keys: list[str], f: Callable[[list[str | None]], list[pa.Array]], added: str) -> DataFrame:
    """``keys`` of docs as they are, and the columns ``added`` that f makes of a list of texts."""
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.col("text").cast("string").alias("_text"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = f(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], [*part.schema.names[:n], *names])

    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:n]), added])
    names = [x.strip().split(" ")[0] for x in added.split(", ")]
    return rows.mapInArrow(run, schema)

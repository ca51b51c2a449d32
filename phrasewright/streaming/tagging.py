"""Tagging a stream of texts.

Each text is tagged by itself, so the stream needs no state and no watermark. The kernel plan is one map
over the rows and runs on a stream as it is; the join plan sorts hits by text, so it runs a micro-batch at
a time. Tags have the same columns in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.matching import LONGEST
from ..operators.tagger import Tagger


def tag_stream(tagger: Tagger, texts: DataFrame, keys: list[str], text: str = "text", policy: str = LONGEST) -> DataFrame:
    """A stream of tags."""
    return tagger.tag(texts, keys, text, policy, plan="kernel")


def write_tags(tagger: Tagger, texts: DataFrame, keys: list[str], path: str, checkpoint: str, text: str = "text", policy: str = LONGEST, plan: str = "join") -> DataStreamWriter:
    """Tags of every micro-batch, appended to Parquet; a batch that is run again replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        tagger.tag(batch, keys, text, policy, plan).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)

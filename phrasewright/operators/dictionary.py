"""Dictionary compile: entries (phrase, kind, id, output, ord) to records (key, n_tokens, kind, id, output, ord).

Phrases without a token go; a missing output is derived; records equal in (id, kind, output) under
one key are one, the first. All of it is one aggregate by (key, id, kind, output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import SEPARATOR, key_column, output_column


def compile_entries(entries: DataFrame) -> DataFrame:
    keyed = entries.select(
        key_column(F.col("phrase")).alias("key"), "id", "kind", F.coalesce("output", output_column(F.col("phrase"))).alias("output"), F.col("ord").cast("long").alias("ord"),
    ).where("key != ''")
    first = keyed.groupBy("key", "id", "kind", "output").agg(F.min("ord").alias("ord"))
    return first.select("key", F.size(F.split("key", SEPARATOR)).alias("n_tokens"), "kind", "id", "output", "ord")


def n_keys(records: DataFrame) -> int:
    return records.select("key").distinct().count()


def kinds(records: DataFrame) -> DataFrame:
    return records.select("kind").distinct().orderBy("kind")


def stats(records: DataFrame) -> DataFrame:
    """One row: n_keys, n_records, n_kinds, longest (tokens)."""
    return records.agg(
        F.countDistinct("key").alias("n_keys"), F.count(F.lit(1)).alias("n_records"), F.countDistinct("kind").alias("n_kinds"), F.max("n_tokens").cast("long").alias("longest"),
    )

"""Interval joins within a row's scope, by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def near(points: DataFrame, spans: DataFrame, reach: int, width: int, how: str = "inner", on: Column | None = None) -> DataFrame:
    """Rows of ``points`` (rid, start, ...) with the rows of ``spans`` (q_rid, q_start, q_end, ...) of the
    same rid that have q_start - reach <= start <= q_end + reach.

    A span goes to each bin its widened interval touches, a point to one: an equi-join on
    (rid, bin), so that one text with very many spans is spread over tasks and only neighbours
    meet. A pair meets in one bin only.
    """
    left = points.withColumn("_bin", F.floor(F.col("start") / width))
    bins = F.sequence(F.floor((F.col("q_start") - reach) / width), F.floor((F.col("q_end") + reach) / width))
    right = spans.withColumn("q_bin", F.explode(bins))
    hit = (F.col("rid") == F.col("q_rid")) & (F.col("_bin") == F.col("q_bin")) & F.col("start").between(F.col("q_start") - reach, F.col("q_end") + reach)
    joined = left.join(right, hit if on is None else hit & on, how)
    return joined.drop("_bin", "q_bin")

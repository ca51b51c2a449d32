"""Result shapes: TSV lines, the simple envelope and the Solr-style envelope, one row a text.

tags: the key columns of the texts, seq, start, end, surface, id, kind, output, of either plan. ``keys`` are the
names that the texts have; results have those of ``matching.key_names``. Keys tell texts apart (null is a key like
any other). Envelopes are left joins from the texts, so a text without a tag gets an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import key_names


def _q(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _with(texts: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """A left join by key columns that may be null."""
    other = more.select(*[F.col(f"`{c}`").alias(f"_key{keys.index(c)}" if c in keys else c) for c in more.columns])
    met = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)], F.lit(True))
    return texts.join(other, met, "left").drop(*[f"_key{n}" for n in range(len(keys))])


def _named(texts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return texts.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, key_names(keys))], *more)


def tsv_lines(tags: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, seq, line: start, end, kind, id, output, surface with tabs between, not quoted."""
    return tags.select(*_q(key_names(keys)), "seq", F.concat_ws("\t", F.col("start").cast("string"), F.col("end").cast("string"), "kind", "id", "output", "surface").alias("line"))


def simple(texts: DataFrame, tags: DataFrame, keys: list[str], text: str = "text", millis: int = 0) -> DataFrame:
    """``keys``, response: {totaltime, text, docs}."""
    own = key_names(keys)
    tag = F.struct("seq", F.struct("start", "end", "surface", "id", F.col("kind").alias("type"), "output").alias("t"))
    docs = tags.groupBy(*_q(own)).agg(F.transform(F.sort_array(F.collect_list(tag)), lambda x: x["t"]).alias("_docs"))
    kind = dict(docs.dtypes)["_docs"]
    whole = _with(_named(texts, keys, F.col(f"`{text}`").alias("_text")), docs, own)
    response = F.struct(F.lit(millis).cast("long").alias("totaltime"), F.col("_text").alias("text"), F.coalesce("_docs", F.array().cast(kind)).alias("docs"))
    return whole.select(*_q(own), response.alias("response"))


def solr_docs(tags: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, first (seq), id, name (distinct surfaces in order), type: one row a distinct id of a text."""
    own = _q(key_names(keys))
    per_name = tags.groupBy(*own, "id", "surface").agg(F.min("seq").alias("_at"), F.min_by("kind", "seq").alias("_kind"))
    return per_name.groupBy(*own, "id").agg(
        F.min("_at").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("_at", "surface"))), lambda x: x["surface"]).alias("name"), F.min_by("_kind", "_at").alias("type"),
    )


def solr_spans(tags: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, startOffset, endOffset, ids (distinct, in order): one row a distinct span of a text."""
    own = _q(key_names(keys))
    per_id = tags.groupBy(*own, "start", "end", "id").agg(F.min("seq").alias("_at"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"])
    return per_id.groupBy(*own, "start", "end").agg(ids.alias("ids")).select(*own, F.col("start").alias("startOffset"), F.col("end").alias("endOffset"), "ids")


def solr(texts: DataFrame, tags: DataFrame, keys: list[str], millis: int = 0) -> DataFrame:
    """``keys``, response: {totalTime, response: {numFound, start, docs}, tags}."""
    own = key_names(keys)
    doc = F.struct("first", F.struct("id", "name", "type").alias("d"))
    docs = solr_docs(tags, keys).groupBy(*_q(own)).agg(F.transform(F.sort_array(F.collect_list(doc)), lambda x: x["d"]).alias("_docs"))
    spans = solr_spans(tags, keys).groupBy(*_q(own)).agg(F.sort_array(F.collect_list(F.struct("startOffset", "endOffset", "ids"))).alias("_tags"))
    whole = _with(_with(_named(texts, keys), docs, own), spans, own)
    empty = lambda c, df: F.coalesce(c, F.array().cast(dict(df.dtypes)[c]))
    inner = F.struct(F.size(empty("_docs", docs)).cast("long").alias("numFound"), F.lit(0).cast("long").alias("start"), empty("_docs", docs).alias("docs"))
    return whole.select(*_q(own), F.struct(F.lit(millis).cast("long").alias("totalTime"), inner.alias("response"), empty("_tags", spans).alias("tags")).alias("response"))


def as_json(shaped: DataFrame, keys: list[str]) -> DataFrame:
    return shaped.select(*_q(key_names(keys)), F.to_json("response").alias("json"))

"""The tagger: a compiled dictionary and what can be done with it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dictionaries
from ..storage import cut
from . import dictionary, matching
from .matching import ALL, LONGEST


class Tagger:
    """Built once from entries; tags any DataFrame with a text column."""

    def __init__(self, records: DataFrame):
        self.records = records
        self._size: tuple[int, int, int] | None = None

    @classmethod
    def build(cls, spark: SparkSession, entries: DataFrame | Iterable[tuple]) -> Tagger:
        """entries: a DataFrame (phrase, kind, id, output, ord), or tuples (phrase, kind, id[, output]) in order.

        A DataFrame is compiled once and written to the checkpoint folder: its plan may be long, or its
        ids random, and each use would run it again."""
        if isinstance(entries, DataFrame):
            return cls(cut(dictionary.compile_entries(entries)))
        return cls(dictionary.compile_entries(dictionaries.from_entries(spark, entries)))

    @classmethod
    def from_tsv_file(cls, spark: SparkSession, path: str) -> Tagger:
        return cls.build(spark, dictionaries.from_tsv_file(spark, path))

    @classmethod
    def from_data_dir(cls, spark: SparkSession, folder: str, stable_ids: bool = False) -> Tagger:
        return cls.build(spark, dictionaries.from_data_dir(spark, folder, stable_ids))

    @classmethod
    def from_env(cls, spark: SparkSession) -> Tagger | None:
        """From the folder named by DATA, None if it is unset or empty."""
        folder = dictionaries.data_folder()
        return cls.from_data_dir(spark, folder) if folder else None

    def __len__(self) -> int:
        """Distinct keys."""
        return dictionary.n_keys(self.records)

    def is_empty(self) -> bool:
        return self.records.isEmpty()

    def size(self) -> tuple[int, int, int]:
        """Records, tokens and bytes."""
        if self._size is None:
            wide = F.octet_length("key") + F.octet_length("id") + F.octet_length("kind") + F.octet_length("output")
            r = self.records.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(wide), F.lit(0))).first()
            self._size = tuple(r)
        return self._size

    def record_count(self) -> int:
        return self.size()[0]

    def kinds(self) -> list[str]:
        return [r["kind"] for r in dictionary.kinds(self.records).collect()]

    def tag(self, texts: DataFrame, keys: list[str], text: str = "text", policy: str = LONGEST, plan: str | None = None) -> DataFrame:
        """Tags of every text: ``keys`` (see ``matching.key_names``), their order seq, start, end, surface, id, kind,
        output. The plan follows the dictionary's size unless it is named."""
        if policy not in (ALL, LONGEST):
            raise ValueError(f"policy must be {ALL!r} or {LONGEST!r}")
        matching.key_names(keys)
        most = matching.MAX_RECORDS, matching.MAX_TOKENS, matching.MAX_BYTES
        plan = plan or ("kernel" if all(n <= m for n, m in zip(self.size(), most)) else "join")
        return getattr(matching, {"kernel": "kernel", "join": "joined"}[plan])(texts, keys, text, self.records, policy)

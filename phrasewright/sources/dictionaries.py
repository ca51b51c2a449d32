"""Dictionary sources: entries, TSV files, folders of CSV files, the environment.

Files are read through Spark (any store it knows) in binary, whole, and split by the strict rules of the
formats: lines end at LF or CR LF only, invalid UTF-8 fails the load, there is no type inference.
Dictionaries are small beside the texts; ``compile_entries`` takes a DataFrame of any size.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import file_stem, split_csv_line, stable_id_column, uuid_v4

ENTRY = "phrase string, kind string, id string, output string, ord long"


def from_entries(spark: SparkSession, entries: Iterable[tuple]) -> DataFrame:
    rows = [(e[0], e[1], e[2], e[3] if len(e) > 3 else None, i) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, ENTRY)


def _read(spark: SparkSession, path: str, names: str | None = None) -> list[tuple[str, str]]:
    """(path, content) of the files under a path, or of those whose names fit a pattern."""
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", names) if names else reader).load(path).select("path", "content").collect()
    return [(r["path"], bytes(r["content"]).decode("utf-8")) for r in found]


def _lines(text: str) -> list[str]:
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def tsv_entries(text: str, kind: str) -> Iterator[tuple]:
    """``phrase TAB id``; blank and # lines are skipped, a missing id is the number of the line."""
    for number, line in enumerate(_lines(text), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        phrase, tab, id_ = line.partition("\t")
        yield phrase, kind, id_.strip() if tab else str(number), None


def csv_entries(text: str, kind: str) -> Iterator[tuple]:
    """First cell is the phrase, the column ``action`` the output; ids are left out (None)."""
    lines = _lines(text)
    if not lines:
        return
    header = [c.strip().lower() for c in split_csv_line(lines[0])]
    action = header.index("action") if "action" in header else None
    for line in lines[1:]:
        cells = split_csv_line(line)
        phrase = cells[0].strip()
        if phrase:
            output = cells[action].strip() if action is not None and action < len(cells) else ""
            yield phrase, kind, None, output or None


def from_tsv_file(spark: SparkSession, path: str) -> DataFrame:
    [(found, text)] = _read(spark, path)
    return from_entries(spark, tsv_entries(text, file_stem(found)))


def from_data_dir(spark: SparkSession, folder: str, stable_ids: bool = False) -> DataFrame:
    """Every .csv (in any case) of a folder, in the order of lower-cased names; kind is the file's stem.

    Ids are random, made once here; ``stable_ids`` derives them from kind and position instead.
    """
    files = _read(spark, folder, "*.[cC][sS][vV]")
    files.sort(key=lambda f: os.path.basename(f[0]).lower())
    rows = [e for p, t in files for e in csv_entries(t, file_stem(p))]
    if not stable_ids:
        return from_entries(spark, [(p, k, uuid_v4(), o) for p, k, _, o in rows])
    return from_entries(spark, rows).withColumn("id", stable_id_column(F.col("kind"), F.col("ord").cast("string")))


def data_folder() -> str | None:
    return os.environ.get("DATA") or None

"""Helper functions around requests and files: query strings, JSON strings, CSV cells, ids, stems."""

from __future__ import annotations

import os
import re
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def url_decode(s: str) -> str:
    """``+`` is a blank, ``%XX`` a byte (``%+X`` too), a malformed ``%`` stays; invalid UTF-8 is replaced."""
    raw = re.sub(rb"%([0-9A-Fa-f]{2}|\+[0-9A-Fa-f])|\+", lambda m: b" " if m[0] == b"+" else bytes([int(m[1], 16)]), s.encode("utf-8", "surrogatepass"))
    return raw.decode("utf-8", "replace")


def url_decode_column(s: Column) -> Column:
    """``url_decode``: a ``%`` without two hex digits is first written as %25, and ``%+X`` as %0X."""
    signed = F.regexp_replace(s, r"%\+([0-9A-Fa-f])", "%0$1")
    return F.url_decode(F.regexp_replace(signed, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_param(query: str, key: str) -> str | None:
    """The decoded value of the first ``key=value`` pair; keys are compared as they stand."""
    for pair in query.split("&"):
        k, eq, v = pair.partition("=")
        if eq and k == key:
            return url_decode(v)
    return None


def query_param_column(query: Column, key: str) -> Column:
    found = F.regexp_extract(F.concat(F.lit("&"), query), "&" + re.escape(key) + "=([^&]*)", 1)
    has = F.concat(F.lit("&"), query).rlike("&" + re.escape(key) + "=")
    return F.when(has, url_decode_column(found))


def json_string_field(body: Column, key: str) -> Column:
    """A top-level string of a JSON object; null if it is absent or no string, or if the body is no JSON (a name
    that stands twice in an object makes it none)."""
    path = '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'
    found = F.try_variant_get(F.try_parse_json(body), path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def json_escape(s: str) -> str:
    """A string as it stands inside JSON quotes; characters beyond ASCII stay as they are."""
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "".join(named.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s)


def json_escape_column(s: Column) -> Column:
    out = s
    for raw, shown in {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}.items():
        out = F.replace(out, F.lit(raw), F.lit(shown))
    for code in range(32):
        if chr(code) not in "\n\r\t":
            out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return out


_QUOTED = re.compile(r'"((?:[^"]|"")*)(?:"|$)')


def split_csv_line(line: str) -> list[str]:
    """Cells of one line: quotes count at the start of a cell only, a doubled quote inside them is one."""
    line, cells, at = line.rstrip("\r"), [], 0
    while True:
        cell = ""
        # an empty quoted part leaves the cell empty, so another one may open
        while not cell and (m := _QUOTED.match(line, at)):
            cell, at = m[1].replace('""', '"'), m.end()
        comma = line.find(",", at)
        end = len(line) if comma < 0 else comma
        cells.append(cell + line[at:end])
        if comma < 0:
            return cells
        at = comma + 1


def file_stem(path: str) -> str:
    stem = os.path.splitext(os.path.basename(path))[0]
    return stem or "default"


def split_csv_column(line: Column) -> Column:
    """``split_csv_line`` of each row, in Arrow batches: its rules for quotes are no reader's of Spark."""

    @F.pandas_udf("array<string>")
    def split(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: None if x is None else split_csv_line(x))

    return split(line)


def blank(s: Column) -> Column:
    """Whether a string is null or has nothing but white space (of any kind that Unicode knows)."""
    return F.coalesce(~s.rlike(r"[^\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"), F.lit(True))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def file_stem_column(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def uuid_v4() -> str:
    return str(uuid.uuid4())


def stable_id_column(*parts: Column) -> Column:
    """An id of the same shape that a rerun gives again."""
    h = F.md5(F.concat_ws("\x1e", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12))

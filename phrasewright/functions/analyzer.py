"""The analyzer: hyphens are deleted, Latin letters folded to ASCII, everything else separates tokens.

The same rules twice: as Column expressions for keys and outputs, and as plain Python for the kernel
that also needs byte offsets. Case is folded letter by letter after folding, never on the raw text:
lower-casing first would turn some separators (Kelvin sign, Y with diaeresis) into letters.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seven hyphens and dashes that are deleted.
HYPHENS = "-‐‑‒–—−"
#: Letters that don't decompose into a base letter and a mark.
SPECIAL = {"Æ": "ae", "æ": "ae", "Œ": "oe", "œ": "oe", "Þ": "th", "þ": "th", "ß": "ss", "Ð": "d", "ð": "d", "Ø": "o", "ø": "o"}
#: Between the tokens of a key.
SEPARATOR = "\x1e"


def _folds() -> dict[str, str]:
    """Latin-1 letters and the oe ligatures to lower-case ASCII."""
    out = dict(SPECIAL)
    for code in range(0xC0, 0x100):
        c = chr(code)
        if c.isalpha() and c not in out:
            out[c] = unicodedata.normalize("NFD", c)[0].lower()
    return out


FOLDS = _folds()
_LETTERS = "A-Za-z0-9" + "".join(sorted(FOLDS))
_DASHES = "".join(HYPHENS[1:]) + r"\-"
#: A token as it stands in the text: starts and ends with a letter, hyphens may stand between.
TOKEN = f"[{_LETTERS}](?:[{_LETTERS}{_DASHES}]*[{_LETTERS}])?"

_TOKEN = re.compile(TOKEN)
_TABLE = str.maketrans({**FOLDS, **{h: None for h in HYPHENS}, **{c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_ONE = {c: f for c, f in FOLDS.items() if len(f) == 1}


def fold(raw: str) -> str:
    """A raw token in its folded form."""
    return raw.translate(_TABLE)


def tokenize(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) with half-open UTF-8 byte offsets into the text."""
    if text.isascii():
        return [(m[0].translate(_TABLE), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out, at, byte = [], 0, 0
    for m in _TOKEN.finditer(text):
        byte += len(text[at : m.start()].encode("utf-8", "surrogatepass"))
        size = len(m[0].encode("utf-8"))
        out.append((m[0].translate(_TABLE), byte, byte + size))
        byte, at = byte + size, m.end()
    return out


def normalize_key(text: str) -> str:
    return SEPARATOR.join(fold(m) for m in _TOKEN.findall(text))


def derive_output(text: str) -> str:
    return normalize_key(text).replace(SEPARATOR, "").upper()


def fold_column(raw: Column) -> Column:
    """``fold`` of tokens (or of any text made of their characters and blanks)."""
    for c, f in FOLDS.items():
        if len(f) > 1:
            raw = F.replace(raw, F.lit(c), F.lit(f))
    plain = F.translate(raw, "".join(_ONE) + HYPHENS, "".join(_ONE.values()))
    return F.lower(plain)


def tokens_column(text: Column) -> Column:
    """The folded tokens of a text."""
    raw = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    # one fold of all tokens at once: a blank can't be part of one
    joined = F.array_join(raw, " ")
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(fold_column(joined), " "))


def key_column(text: Column) -> Column:
    """The dictionary key of a phrase; empty if it has no token."""
    return F.array_join(tokens_column(text), SEPARATOR)


def output_column(text: Column) -> Column:
    """The canonical output derived from a phrase."""
    return F.upper(F.array_join(tokens_column(text), ""))

"""Dictionary matching: every phrase (``all``), or the longest from left to right (``longest``).

Two plans with the same rows and columns:

* ``kernel``: one pass over the texts in Arrow batches with the dictionary as a trie of tokens, no shuffle
  at all. The dictionary is broadcast, so it is taken only up to MAX_RECORDS records of MAX_TOKENS tokens
  and MAX_BYTES bytes (checked).
* ``join``: beyond that. One pass over the texts makes their n-grams with places and surfaces, but only
  those that pass a gate: a bitmap of GATE_BITS bits, whatever the size of the dictionary, of the
  first two tokens and the length of every key. These are equi-joined with the dictionary by key, counted
  by text (equal rows are one from there on), and one pass over the sorted hits of each text selects and
  numbers them. Texts are read once and never shuffled; the work is linear in tokens and hits.

Tags: the key columns of the texts, seq (order of emission), start and end (bytes), surface, id, kind, output.
A key column that has the name of one of these comes out as ``key_<name>`` (``key_names``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import SEPARATOR, tokenize

#: What is broadcast at most: some 300 MB of trie in a worker.
MAX_RECORDS = 200_000
MAX_TOKENS = 1_000_000
MAX_BYTES = 32 << 20
#: Bits of the join plan's gate (8 MB).
GATE_BITS = 1 << 26
#: Bytes of texts up to which they are dealt out first.
SMALL = 64 << 20
#: Texts of a batch in one piece, in characters.
_PIECE = 4 << 20
#: Rows of a batch of n-grams or tags.
_ROWS = 50_000
ALL, LONGEST = "all", "longest"

TAG = "seq int, start long, end long, surface string, id string, kind string, output string"
_TAG = {"seq": pa.int32(), "start": pa.int64(), "end": pa.int64(), "surface": pa.string(), "id": pa.string(), "kind": pa.string(), "output": pa.string()}

Trie = dict  # token -> Trie; "" -> records at this key


def key_names(keys: list[str]) -> list[str]:
    """What the key columns are called beside a tag's own columns."""
    names = [f"key_{k}" if k.lower() in _TAG else k for k in keys]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"key columns can't be told apart: {names}")
    return names


def _keyed(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The key columns under their names beside a tag's, and _text."""
    return spread(texts).select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, key_names(keys))], F.col(f"`{text}`").cast("string").alias("_text"))


def build_trie(records: list[tuple[str, str, str, str]]) -> Trie:
    """records: (key, kind, id, output) in their order."""
    root: Trie = {}
    for key, kind, id_, output in records:
        node = root
        for token in key.split(SEPARATOR):
            node = node.setdefault(token, {})
        node.setdefault("", []).append((id_, kind, output))
    return root


def match(text: str, trie: Trie, policy: str) -> Iterator[tuple[int, int, list]]:
    """(start, end, records) in bytes, in order of emission."""
    tokens = tokenize(text)
    n, i = len(tokens), 0
    while i < n:
        node, j, last = trie.get(tokens[i][0]), i, None
        while node is not None:
            found = node.get("")
            if found is not None:
                if policy == ALL:
                    yield tokens[i][1], tokens[j][2], found
                last = j, found
            j += 1
            node = node.get(tokens[j][0]) if j < n else None
        if policy == LONGEST and last:
            yield tokens[i][1], tokens[last[0]][2], last[1]
            i = last[0] + 1
        else:
            i += 1


def spread(texts: DataFrame) -> DataFrame:
    """Texts of a checked size, SMALL bytes at most by Spark's own estimate, are dealt out over the cores (they
    may come from one file); all others stay where they are read, so that a large corpus isn't shuffled."""
    if texts.isStreaming or int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SMALL:
        return texts
    return texts.repartition(texts.sparkSession.sparkContext.defaultParallelism)


def _schema(rows: DataFrame, added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), added])


def kernel(texts: DataFrame, keys: list[str], text: str, records: DataFrame, policy: str) -> DataFrame:
    listed = [(r["key"], r["kind"], r["id"], r["output"]) for r in records.orderBy("ord", "key", "id", "kind", "output").collect()]
    held = texts.sparkSession.sparkContext.broadcast(build_trie(listed))
    rows = _keyed(texts, keys, text)
    n, names = len(keys), [*rows.columns[:-1], *_TAG]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held.value
        for batch in batches:
            at, tags, size = [], [], 0
            for k, t in enumerate(batch.column(n).to_pylist()):
                if t is None:
                    continue
                raw, seq = None, 0
                for start, end, found in match(t, trie, policy):
                    raw = raw or t.encode("utf-8", "surrogatepass")
                    surface = raw[start:end].decode("utf-8")
                    for id_, kind, output in found:
                        at.append(k)
                        tags.append((seq, start, end, surface, id_, kind, output))
                        seq += 1
                size += len(t)
                if size > _PIECE:
                    yield from made(batch, at, tags)
                    at, tags, size = [], [], 0
            yield from made(batch, at, tags)

    def made(batch, at, tags):
        if tags:
            own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:n]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*tags), _TAG.values()))], names)

    return rows.mapInArrow(run, _schema(rows, TAG))


def tokens(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, i, tok, start, end of every token; one pass, no shuffle."""
    rows = spread(texts.select(*keys, F.col(text).alias("_text")))
    n, names = len(keys), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in enumerate(batch.column(n).to_pylist()):
                found = tokenize(t or "")
                if found:
                    own = [c.take(pa.array([k] * len(found))) for c in batch.columns[:n]]
                    tok, start, end = zip(*found)
                    yield pa.RecordBatch.from_arrays([*own, pa.array(range(len(found)), pa.int32()), pa.array(tok), pa.array(start, pa.int64()), pa.array(end, pa.int64())], [*names, "i", "tok", "start", "end"])

    return rows.mapInArrow(run, _schema(rows, "i int, tok string, start long, end long"))


def _head(tokens: list[str], n: int) -> int:
    """The hash of a run of n tokens that begins with these (two at most)."""
    return xxhash.xxh64_intdigest(f"{n}{SEPARATOR}{SEPARATOR.join(tokens)}", 42)


def gate(records: DataFrame) -> bytes:
    """GATE_BITS bits: which heads (length, first two tokens) the keys have. Made of partial bitmaps of 4 KB."""
    head = F.concat_ws(SEPARATOR, F.col("n_tokens").cast("string"), F.array_join(F.slice(F.split("key", SEPARATOR), 1, 2), SEPARATOR))
    # the signed form of the hash in ``_head``; bitmaps count from 1
    at = records.select((F.pmod(F.xxhash64(head), F.lit(GATE_BITS)) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(GATE_BITS // 8)
    for r in parts.collect():  # GATE_BITS / 32768 rows at most
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(out)


def _grams(texts: DataFrame, keys: list[str], text: str, records: DataFrame) -> DataFrame:
    """Key columns, h (a hash of the text), i, n, key, start, end, surface of the n-grams that pass the gate."""
    lengths = sorted(r[0] for r in records.select("n_tokens").distinct().collect())
    sc = texts.sparkSession.sparkContext
    held = sc.broadcast((gate(records), lengths))
    rows = _keyed(texts, keys, text)
    at = len(keys)
    kinds = {"h": pa.binary(), "i": pa.int32(), "n": pa.int32(), "key": pa.string(), "start": pa.int64(), "end": pa.int64(), "surface": pa.string()}
    names = [*rows.columns[:-1], *(f"_{k}" for k in kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = held.value
        open_: dict[tuple[str, str], list[int]] = {}
        passes = lambda h: bits[h // 8 % len(bits)] >> h % 8 & 1
        for batch in batches:
            own, out = [], []
            for k, t in enumerate(batch.column(at).to_pylist()):
                if t is None:
                    continue
                found = tokenize(t)
                raw, digest = None, None
                words = [f[0] for f in found]
                for i, word in enumerate(words):
                    pair = word, words[i + 1] if i + 1 < len(words) else ""
                    fits = open_.get(pair)
                    if fits is None:
                        if len(open_) > 500_000:
                            open_.clear()
                        fits = open_[pair] = [n for n in lengths if passes(_head([word] if n == 1 else [*pair], n))]
                    for n in fits:
                        if i + n > len(words):
                            break
                        if raw is None:
                            raw = t.encode("utf-8", "surrogatepass")
                            digest = xxhash.xxh128_digest(raw)
                        start, end = found[i][1], found[i + n - 1][2]
                        own.append(k)
                        out.append((digest, i, n, SEPARATOR.join(words[i : i + n]), start, end, raw[start:end].decode("utf-8")))
                    if len(out) >= _ROWS:
                        yield made(batch, own, out)
                        own, out = [], []
            if out:
                yield made(batch, own, out)

    def made(batch, own, out):
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(own, pa.int64())) for c in batch.columns[:at]), *(pa.array(c, t) for c, t in zip(zip(*out), kinds.values()))], names)

    added = "_h binary, _i int, _n int, _key string, _start long, _end long, _surface string"
    return rows.mapInArrow(run, _schema(rows, added))


def joined(texts: DataFrame, keys: list[str], text: str, records: DataFrame, policy: str) -> DataFrame:
    """The plan for dictionaries of any size."""
    own = key_names(keys)
    grams = _grams(texts, keys, text, records)
    fields = ["id", "kind", "output", "ord"]
    # both sides are dealt for the join alone, so that a common key's rows may be split
    table = records.select(F.col("key").alias("_k"), *[F.col(c).alias(f"_{c}") for c in fields])
    hits = grams.join(table, F.col("_key") == F.col("_k"))
    # equal texts under equal keys are one from here on, as often as each hit is counted
    place = [*[f"`{k}`" for k in own], "_h", "_i", "_n", "_start", "_end", "_surface", "_ord", "_id", "_kind", "_output"]
    counted = hits.groupBy(*place).agg(F.count(F.lit(1)).alias("_copies"))
    text_of = [F.col(f"`{k}`") for k in own] + [F.col("_h")]
    longest = F.col("_n").desc() if policy == LONGEST else F.col("_n").asc()
    dealt = counted.repartition(*text_of).sortWithinPartitions(*text_of, F.col("_i"), longest, "_ord", "_id", "_kind", "_output")
    names = [*own, *_TAG]
    n = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seq, free, picked = None, 0, 0, None
        for batch in batches:
            key = list(zip(*(c.to_pylist() for c in batch.columns[: n + 1])))
            at, tags = [], []
            for k, (i, length, start, end, surface, _, id_, kind, output, copies) in enumerate(zip(*(c.to_pylist() for c in batch.columns[n + 1 :]))):
                if key[k] != current:
                    current, seq, free, picked = key[k], 0, 0, None
                if policy == LONGEST and (i, length) != picked:
                    if i < free:
                        continue
                    picked, free = (i, length), i + length
                at += [k] * copies if copies < _ROWS else [k]
                tags += [(seq, start, end, surface, id_, kind, output)] * (copies if copies < _ROWS else 1)
                for first in range(1, copies if copies >= _ROWS else 1, _ROWS):
                    more = min(_ROWS, copies - first)
                    yield made(batch, [k] * more, [tags[-1]] * more)
                seq += 1
                if len(tags) >= _ROWS:
                    yield made(batch, at, tags)
                    at, tags = [], []
            if tags:
                yield made(batch, at, tags)

    def made(batch, at, tags):
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[:n]), *(pa.array(c, t) for c, t in zip(zip(*tags), _TAG.values()))], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[:n])
    return dealt.mapInArrow(run, f"{kinds}{', ' * bool(n)}{TAG}")

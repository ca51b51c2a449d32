"""SentencePiece encoding with the N best segmentations, and decoding.

The piece lattice of a text has a node before and after each character and an arc for each piece of
the vocabulary that stands there; a character that no piece covers has one arc of its UTF-8 bytes.
Forward Viterbi gives the best score of every prefix. These are exact heuristics for a search
backward from the end: A-star leaves the agenda in the order of whole paths' scores, so the first
N complete ones are the N best.

The search runs link by link. Arcs never cross the start of a run of blanks, a line break (checked when a vocabulary is loaded) or, where
no piece of the vocabulary does, the place between a letter and a mark, so
the lattice of a text is a chain of small lattices. A worker remembers those it has met: the best path,
which the forward pass leaves behind, and its distance to the second. Of a whole text only the N - 1
links of the chain with the least such distance can differ from the best in its N best segmentations:
A-star runs on these, and their paths are combined best first into the ids of all N.

The vocabulary file is a BPE model, whose scores are ranks; the score of a piece is the log of its
share under Zipf's law, -log(rank + 2.7) - log(sum). A blank is put before every text that isn't
empty, as the model asks; decoding takes it off again. Any text decodes to itself.

The file is read on the driver only; workers get the vocabulary by broadcast.

Cases: null and empty texts have no pieces, score 0 and one segmentation; very long texts are segmented
whole; repeated rows get a row
each; null ids stay; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._arrow import map_texts
from ._common import documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Links that a worker remembers (twice as many, in two generations).
_REMEMBER = 200_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,;:!?%$#&*|<>()[]{}\"'/-+="


def _pack(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def _unpack(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<i4")


class Vocabulary:
    """Pieces (with plain blanks), their ids and scores."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], byte_score: float):
        crossing = [p for p in pieces if "\n" in p or " " in p.lstrip(" ")]
        if crossing:
            raise ValueError(f"pieces reach over blanks or lines: {crossing[:3]}")
        self.pieces, self.byte_ids, self.byte_score = pieces, byte_ids, byte_score
        self._set_up()

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        shares = {i: 1 / (2.7 - sp.get_score(i)) for i in plain}
        total = sum(shares.values())
        pieces = {sp.id_to_piece(i).replace("▁", " "): (i, math.log(shares[i] / total)) for i in plain}
        return cls(pieces, [bytes_[b] for b in range(256)], min(s for _, s in pieces.values()) - 2)

    def _set_up(self) -> None:
        self._starts = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        self._trie: dict = {}
        for p, found in self.pieces.items():
            node = self._trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = found
        # a mark that no piece has behind a letter starts a link of its own
        letter = re.compile(f"[{_LETTERS}]")
        behind = {b for p in self.pieces for a, b in zip(p, p[1:]) if letter.match(a)}
        marks = "".join(re.escape(c) for c in _MARKS if c not in behind)
        if marks:
            inner = f"(?:[^ \n{marks}]++|(?<![{_LETTERS}])[{marks}]++)"
            self._links = re.compile(f" *{inner}++|[{marks}]++{inner}*+|\n| +").findall
        else:
            self._links = re.compile(" *[^ \n]+|\n| +").findall
        self._ways: dict[tuple[str, int], list] = {}
        self._young: dict[str, tuple] = {}
        self._old: dict[str, tuple] = {}
        text = {i: p.encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self._bytes = [text.get(i, b"") for i in range(max(text) + 1)]

    def __getstate__(self):
        return self.pieces, self.byte_ids, self.byte_score

    def __setstate__(self, state):
        self.pieces, self.byte_ids, self.byte_score = state
        self._set_up()

    def arcs(self, link: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end the arcs into it: start, score, ids."""
        pieces, starts, n = self.pieces, self._starts, len(link)
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            single = False
            for j in range(i + 1, n + 1):
                p = link[i:j]
                if p not in starts:
                    break
                found = pieces.get(p)
                if found:
                    into[j].append((i, found[1], found[:1]))
                    single |= j == i + 1
            if not single:
                raw = link[i].encode("utf-8", "surrogatepass")
                into[i + 1].append((i, len(raw) * self.byte_score, tuple(self.byte_ids[b] for b in raw)))
        return into

    @staticmethod
    def forward(into: list[list]) -> tuple[list[float], list[tuple | None]]:
        """The best score of each prefix, and its last arc."""
        best, last = [0.0], [None]
        for arcs in into[1:]:
            top, arc = -math.inf, None
            for a in arcs:
                s = best[a[0]] + a[1]
                if s > top:
                    top, arc = s, a
            best.append(top)
            last.append(arc)
        return best, last

    def link(self, s: str) -> tuple[float, float, bytes]:
        """Best score, its distance to the second path's, and the packed ids of the best path."""
        got = self._young.get(s)
        if got is not None:
            return got
        got = self._old.get(s) or self._two_best(s)
        if len(self._young) >= _REMEMBER:
            self._old, self._young = self._young, {}
        self._young[s] = got
        return got

    def _two_best(self, s: str) -> tuple[float, float, bytes]:
        """Forward Viterbi that keeps the two best scores of every prefix, walking the pieces' trie."""
        n, trie, none = len(s), self._trie, -math.inf
        first, second = [none] * (n + 1), [none] * (n + 1)
        first[0] = 0.0
        start, piece = [0] * (n + 1), [None] * (n + 1)
        for i in range(n):
            one, two = first[i], second[i]
            node, j, single = trie, i, False
            while j < n:
                node = node.get(s[j])
                if node is None:
                    break
                j += 1
                found = node.get("")
                if found is None:
                    continue
                if j == i + 1:
                    single = True
                score = one + found[1]
                if score > first[j]:
                    below = two + found[1]
                    second[j] = first[j] if first[j] > below else below
                    first[j], start[j], piece[j] = score, i, found[0]
                elif score > second[j]:
                    second[j] = score
            if not single:
                raw = s[i].encode("utf-8", "surrogatepass")
                score, below, j = one + len(raw) * self.byte_score, two + len(raw) * self.byte_score, i + 1
                if score > first[j]:
                    second[j] = first[j] if first[j] > below else below
                    first[j], start[j], piece[j] = score, i, tuple(self.byte_ids[b] for b in raw)
                elif score > second[j]:
                    second[j] = score
        ids, at = [], n
        while at:
            p = piece[at]
            if type(p) is tuple:
                ids.extend(reversed(p))
            else:
                ids.append(p)
            at = start[at]
        ids.reverse()
        return first[n], first[n] - second[n], _pack(*ids)

    def paths(self, s: str) -> Iterator[tuple[float, tuple[int, ...]]]:
        """All segmentations of a link from the best on, by A-star backward from its end."""
        into = self.arcs(s)
        best, _ = self.forward(into)
        # the agenda: -(score of the prefix + of what is done), order of entry, node, done, its pieces
        agenda: list[tuple] = [(-best[-1], 0, len(s), 0.0, None)]
        entered = 1
        while agenda:
            _, _, node, done, tail = heapq.heappop(agenda)
            if node == 0:
                ids = []
                while tail:
                    ids.append(tail[0])
                    tail = tail[1]
                yield done, tuple(chain.from_iterable(ids))
                continue
            for start, score, ids in into[node]:
                heapq.heappush(agenda, (-(best[start] + score + done), entered, start, score + done, (ids, tail)))
                entered += 1

    def links(self, text: str) -> list[str]:
        return self._links(" " + text) if text else []

    def ways(self, s: str, n: int) -> list[tuple[float, bytes]]:
        """Loss and packed ids of the n best paths of a link, best first; each is checked to spell the link."""
        found = self._ways.get((s, n))
        if found is None:
            found, top, raw = [], None, s.encode("utf-8", "surrogatepass")
            for score, ids in islice(self.paths(s), n):
                if b"".join(map(self._bytes.__getitem__, ids)) != raw:
                    raise ValueError(f"a path does not spell its link: {s!r}")
                top = score if top is None else top
                found.append((max(0.0, top - score), _pack(*ids)))
            if len(self._ways) > 20_000:
                self._ways.clear()
            self._ways[s, n] = found
        return found

    def n_best(self, text: str | None, n: int = N_BEST, ids: bool = True) -> list[tuple[float, np.ndarray | None]]:
        """Score and ids of the n best segmentations of a whole text (fewer if there are fewer).

        ids: whether to make those of the second and further ones."""
        return [(score, None if packed is None else _unpack([packed])) for score, packed in self.n_best_packed(text, n, ids)]

    def n_best_packed(self, text: str | None, n: int = N_BEST, ids: bool = True) -> list[tuple[float, bytes | None]]:
        """``n_best`` with the ids as little-endian 32-bit numbers."""
        links = self.links(text or "")
        get, link = self._young.get, self.link
        known = [get(s) or link(s) for s in links]
        base = math.fsum([k[0] for k in known])
        best = [k[2] for k in known]
        if n < 2 or not links:
            return [(base, b"".join(best))]
        gaps = np.array([k[1] for k in known])
        loose = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) >= n else np.arange(len(gaps))
        order = np.sort(loose[np.isfinite(gaps[loose])]).tolist()
        ways = [self.ways(links[i], n) for i in order]
        # what stands before, between and after the links that may change
        ends = [*order, len(best)]
        between = [b"".join(best[a:b]) for a, b in zip([0, *(i + 1 for i in order)], ends)]
        agenda = [(0.0, (0,) * len(order))]
        seen = {agenda[0][1]}
        out: list[tuple[float, bytes | None]] = []
        while agenda and len(out) < n:
            loss, pick = heapq.heappop(agenda)
            whole = None
            if ids or not out:
                whole = between[0] + b"".join((own[p][1] if p else best[i]) + after for i, own, p, after in zip(order, ways, pick, between[1:]))
            out.append((base - loss, whole))
            for k, own in enumerate(ways):
                if pick[k] + 1 < len(own):
                    new = (*pick[:k], pick[k] + 1, *pick[k + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(agenda, (loss - own[pick[k]][0] + own[pick[k] + 1][0], new))
        return out

    def decode(self, ids) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        text = b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:]


def encode(docs: DataFrame, keys: list[str], vocabulary: Vocabulary, n: int = N_BEST, paths: bool = True) -> DataFrame:
    """``keys`` of docs, ids (of the best segmentation), scores (of the n best, best first) and, unless ``paths``
    is false, paths (the ids of each of the n best)."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(texts: list[str | None]) -> list[pa.Array]:
        v = held.value
        found = [v.n_best(t, n, ids=paths) for t in texts]
        made = [pa.array([f[0][1] for f in found], pa.list_(pa.int32())), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64()))]
        return [*made, pa.array([[i for _, i in f] for f in found], pa.list_(pa.list_(pa.int32())))] if paths else made

    return map_texts(docs, keys, run, "ids array<int>, scores array<double>" + ", paths array<array<int>>" * paths)


def decode(rows: DataFrame, keys: list[str], vocabulary: Vocabulary) -> DataFrame:
    """``keys`` of rows, and text from their ids (null for null ids)."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for batch in batches:
            text = [None if x is None else v.decode(x) for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(text, pa.string())], [*batch.schema.names[:n], "text"])

    picked = rows.select(*keys, "ids")
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in picked.schema.fields[:n]), "text string"])
    return picked.mapInArrow(run, schema)


def op6_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_best (segmentations found, up to 4), score and lead (over the second best; null if
    none), scores and paths_sha256 (of each of the n best: the ids as little-endian 32-bit numbers),
    ids_sha256 (of the best one's) and decoded (whether the ids decode to the text: those of the best are
    decoded whole; the others differ from it in links that ``ways`` has checked) of every document."""
    held = spark.sparkContext.broadcast(Vocabulary.load())

    def run(texts: list[str | None]) -> list[pa.Array]:
        v = held.value
        rows = []
        for t in texts:
            found = v.n_best_packed(t)
            scores = [s for s, _ in found]
            shas = [hashlib.sha256(p).hexdigest() for _, p in found]
            lead = scores[0] - scores[1] if len(found) > 1 else None
            rows.append((len(found[0][1]) // 4, len(found), scores[0], lead, scores, shas, shas[0], v.decode(_unpack([found[0][1]])) == (t or "")))
        types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.string(), pa.bool_()]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]

    added = "n_pieces long, n_best int, score double, lead double, scores array<double>, paths_sha256 array<string>, ids_sha256 string, decoded boolean"
    return map_texts(documents(spark, sf_dir), ["doc_id"], run, added)

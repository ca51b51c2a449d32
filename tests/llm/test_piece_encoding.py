import hashlib
import math
import os
import random

import numpy as np
import pytest

from phrasewright.llm import piece_encoding as E

from .helpers import clashing, frame, odd, write

needs_model = pytest.mark.skipif(not os.path.exists(E.MODEL), reason="no vocabulary file")


def small():
    words = ["a", "b", "c", " ", "ab", " a", "bc", "abc", " ab", "  ", "ca", " ca", ".", ".a", "..", "a!", "!"]
    rng = random.Random(0)
    return E.Vocabulary({w: (300 + i, -1 - rng.random() * 3) for i, w in enumerate(words)}, list(range(256)), -9.5)


def brute(v, text):
    """Scores of all segmentations of a whole text, best first."""
    s = " " + text if text else ""

    def go(at):
        if at == len(s):
            return [(0.0, ())]
        out = []
        for end in range(at + 1, len(s) + 1):
            if s[at:end] in v.pieces:
                i, score = v.pieces[s[at:end]]
                out += [(score + x, (i, *y)) for x, y in go(end)]
        if s[at] not in v.pieces:
            raw = s[at].encode()
            out += [(len(raw) * v.byte_score + x, (*raw, *y)) for x, y in go(at + 1)]
        return out

    return sorted(go(0), reverse=True)


def test_n_best_matches_enumeration():
    v, rng = small(), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abc  é\n.!") for _ in range(rng.randrange(11)))
        want = brute(v, text)
        for n in (1, 2, 5, 12):
            got = v.n_best(text, n)
            assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]])
            assert len({tuple(i) for _, i in got}) == len(got)
            known = {i: s for s, i in want}
            assert all(abs(known[tuple(i)] - s) < 1e-9 and v.decode(i) == text for s, i in got)


def test_query_matches_enumeration(spark, tmp_path, monkeypatch):
    """The query's rows beside all segmentations of short texts, with a small vocabulary in place of the file's."""
    v, rng = small(), random.Random(5)
    monkeypatch.setattr(E.Vocabulary, "load", classmethod(lambda cls: v))
    texts = ["".join(rng.choice("abc  é\n.!") for _ in range(rng.randrange(9))) for _ in range(80)] + [None]
    for r in E.op6_piece_encoding(spark, write(frame(spark, texts), tmp_path)).collect():
        want = brute(v, texts[r.doc_id] or "")
        assert np.allclose(r.scores, [s for s, _ in want[:4]]) and r.n_best == min(4, len(want)) and r.decoded
        known = {hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(): s for s, ids in want}
        assert all(abs(known[h] - s) < 1e-9 for h, s in zip(r.paths_sha256, r.scores)) and len(set(r.paths_sha256)) == r.n_best


def test_a_star_yields_paths_in_order():
    v = small()
    found = list(v.paths(" abcabca"))
    assert len(found) == len(brute(v, "abcabca")) and all(a[0] >= b[0] - 1e-12 for a, b in zip(found, found[1:]))
    best, gap, ids = v.link(" abcabca")
    assert math.isclose(best, found[0][0]) and math.isclose(gap, found[0][0] - found[1][0]) and ids == E._pack(*found[0][1])


def test_memory_turns_over(monkeypatch):
    monkeypatch.setattr(E, "_REMEMBER", 3)
    v = small()
    texts = ["ab bc ca abc", "ca bc", "c c c a b", "abc abc b"] * 3
    assert str([v.n_best(t) for t in texts]) == str([small().n_best(t) for t in texts]) and len(v._young) + len(v._old) <= 6


def test_crossing_pieces_are_refused():
    with pytest.raises(ValueError, match="reach over"):
        E.Vocabulary({"a b": (1, -1.0)}, list(range(256)), -9)


@needs_model
def test_every_text_round_trips(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["the ", "é", "😀", "▁", " ", "\n", "\x00", "x", "ing", "漢", " ", "\t"]) for _ in range(40)) for _ in range(60)]
    df = clashing(frame(spark, texts, 50).unionByName(odd(spark)))
    v = E.Vocabulary.load()
    rows = E.encode(df, ["doc_id", "n"], v)
    pairs = lambda d: sorted((str(r.doc_id), r.text or "") for r in d.collect())
    assert pairs(E.decode(rows, ["doc_id"], v)) == pairs(df)
    got = E.op6_piece_encoding(spark, write(df, tmp_path)).collect()
    want = []
    for i, t in df.select("doc_id", "text").collect():
        best = v.n_best(t, 4)
        shas = [hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() for _, ids in best]
        want.append((str(i), len(best[0][1]), len(best), shas, shas[0], True))
    assert sorted((str(r.doc_id), r.n_pieces, r.n_best, r.paths_sha256, r.ids_sha256, r.decoded) for r in got) == sorted(want)
    assert all(r.scores[0] == r.score and r.scores == sorted(r.scores, reverse=True) and len(set(r.paths_sha256)) == r.n_best for r in got)
    whole = dict(enumerate(r.text or "" for r in df.select("text").collect()))
    by_text = {tuple(map(tuple, ([i.tolist() for _, i in v.n_best(t)]))): t for t in whole.values()}
    for r in rows.collect():
        assert r.paths[0] == r.ids and len(r.paths) == len(r.scores)
        assert {v.decode(p) for p in r.paths} == {by_text[tuple(map(tuple, r.paths))]}
    assert "paths" not in E.encode(df, ["doc_id"], v, paths=False).columns
    assert E.encode(df.limit(0), ["doc_id"], v).count() == 0


@needs_model
def test_pieces_are_the_vocabulary_s():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=E.MODEL)
    v = E.Vocabulary.load()
    for text in ("Hello world", "the cats  sat on\nthe mat", "élève"):
        ids = v.n_best(text)[0][1].tolist()
        assert sp.decode(ids) == text

import random

import numpy as np
import pyarrow as pa

from phrasewright.llm import similar_texts as S
from phrasewright.llm import simhash_dedup as D
from phrasewright.llm._simhash import shingle_hashes

from .helpers import clashing, frame, odd


def near_copies(rng, base, edits):
    own = list(base)
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
    return " ".join(own)


def jaccard(a, b):
    x, y = (set(shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(11)
    texts, families = [], []
    for f in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        for k in range(rng.randrange(1, 6)):
            texts.append(near_copies(rng, base, 0 if k == 0 else max(1, len(base) // 120)))
            families.append(f)
    df = frame(spark, texts, 100)
    got = {r.doc_id - 100: r["class"] for r in S.classes(df).collect()}
    met = missed = 0
    for i in range(len(texts)):
        for j in range(i):
            same = got[i] == got[j]
            assert not same or families[i] == families[j]
            if jaccard(texts[i], texts[j]) >= 0.8:
                met += same
                missed += not same
    assert met > 50 and missed <= 0.03 * met
    kept = S.keep_one(clashing(df))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(i for i in got if got[i] == c) + 100 for c in set(got.values()))
    assert kept.columns == clashing(df).columns


def test_odd_rows(spark):
    df = clashing(odd(spark))
    kept = S.keep_one(df).collect()
    # one row of the repeated ones, one of all without words
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "1", "2", "None", "4", "6", "7"])
    assert S.keep_one(df.limit(0)).count() == 0


def brute(words, prints, limit, radius):
    n = len(words)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if int(words[i] ^ words[j]).bit_count() <= radius and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= limit:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_subtries_small_and_large(monkeypatch):
    rng = np.random.default_rng(5)
    for large, piece in ((10**6, 10**6), (10, 10**6), (10, 50)):
        monkeypatch.setattr(S, "LARGE", large)
        monkeypatch.setattr(D, "PIECE", piece)
        for _ in range(6):
            base = rng.integers(0, 2**63, (4, 4)).astype(np.uint64)
            prints = base[rng.integers(0, 4, 120)] ^ (np.uint64(1) << rng.integers(0, 63, (120, 4)).astype(np.uint64))
            words = (rng.integers(0, 2**6, 120)).astype(np.uint64)  # all in one subtrie, many equal
            order = np.argsort(words, kind="stable")
            words, prints = words[order], prints[order]
            for limit, radius in ((4, 1), (6, 3)):
                root = S._link_subtrie(words << np.uint64(32), prints, limit, radius)
                want = brute(words, prints, limit, radius)
                if large > 120:
                    assert root.tolist() == want
                else:  # pivots may link rows whose probe words are too far apart: never fewer links
                    for i in range(120):
                        assert root[i] == root[want[i]]


def test_limit():
    assert S.most_bits(1.0) == 0 and 38 < S.most_bits(0.8) < 50


def test_links_do_not_depend_on_the_size_of_a_subtrie(monkeypatch):
    rng = np.random.default_rng(6)
    for large in (10**6, 10):
        monkeypatch.setattr(S, "LARGE", large)
        for _ in range(6):
            base = rng.integers(0, 2**63, (3, 4)).astype(np.uint64)
            prints = base[rng.integers(0, 3, 120)] ^ (np.uint64(1) << rng.integers(0, 63, (120, 4)).astype(np.uint64))
            words = np.sort(rng.integers(0, 2**22, 120)).astype(np.uint64)  # most are too far apart for a link
            root = S._link_subtrie(words << np.uint64(32), prints, 8, 3)
            assert root.tolist() == brute(words, prints, 8, 3)


def test_only_texts_at_the_similarity_are_linked(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(60):  # a text, and copies of it at 0.6 to 0.9
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(base), *(near_copies(rng, base, edits) for edits in (2, 6, 7, 8))]
    got = {r.doc_id: r["class"] for r in S.classes(frame(spark, texts)).collect()}
    like = {(i, j): jaccard(texts[i], texts[j]) for i in range(len(texts)) for j in range(i - i % 5, i)}
    root = list(range(len(texts)))
    for (i, j), x in like.items():
        if x >= 0.8:
            old, new = root[i], root[j]
            root = [new if r == old else r for r in root]
    classes = lambda of: {tuple(i for i in range(len(texts)) if of[i] == c) for c in {of[i] for i in range(len(texts))}}
    assert sum(0.65 <= x < 0.8 for x in like.values()) > 100
    assert classes(got) == classes(root)


def test_blocks_compare_all_pairs(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 5)
    monkeypatch.setattr(S, "_COLUMNS", 7)
    rng = np.random.default_rng(8)
    for _ in range(20):
        base = rng.integers(0, 2**63, 20).astype(np.uint64)
        sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(0, 21)], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)]) for _ in range(23)]
        sets = list({x.tobytes(): x for x in sets}.values())
        want = np.array([[1.0 if not len(a) + len(b) else len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets]) >= 0.6
        x, y = np.arange(0, len(sets), 2), np.arange(1, len(sets), 2)
        assert (S.alike(sets, x, y, 0.6) == want[np.ix_(x, y)]).all()
        # a family in three chunks and so in six blocks, handed over in batches that cut blocks
        chunk = rng.integers(0, 3, len(sets))
        rows = [(1, min(c, k), max(c, k), c, bytes([n]), s.tobytes()) for n, (s, c) in enumerate(zip(sets, chunk.tolist())) for k in range(3)]
        rows.sort(key=lambda r: r[:3])
        names = ["family", "i", "j", "c", "node", "shingles"]
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[at : at + 4]]) for at in range(0, len(rows), 4)]
        found = [p for out in S._in_blocks(0.6)(iter(batches)) for p in zip(*(c.to_pylist() for c in out.columns))]
        assert len(found) <= 2 * len(sets) * 3
        joined = lambda pairs: S._forest(len(sets), iter([(np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int))])).tolist()
        assert joined([(a[0], b[0]) for a, b in found]) == joined(np.argwhere(want).tolist())


def test_probes_follow_from_the_number_of_nodes():
    for n in (0, 1000, 10**7, 4 * 10**10):
        key, probes = S.plan(n, 0.8, 3)
        assert n / 2**key <= S.SUBTRIE and S.probe_bits(probes).shape == (probes, 32)
    assert (S.probe_bits(5) == S.probe_bits(9)[:5]).all()


def test_a_wider_key_finds_the_same(spark, monkeypatch):
    rng = random.Random(13)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        texts += [near_copies(rng, base, k) for k in (0, 1, 2, 3)]
    df = frame(spark, texts)
    found = lambda: sorted((r.doc_id, r["class"]) for r in S.classes(df).collect())
    want = found()
    monkeypatch.setattr(S, "SUBTRIE", 0.02)
    S.plan.cache_clear()
    assert S.plan(120, 0.8, 3)[0] > 10 and found() == want
    assert sorted((r.doc_id, r["class"]) for r in S.classes(df, split=5).collect()) == want  # subtries in blocks
    monkeypatch.setattr(S, "MOST_CHUNKS", 3)
    monkeypatch.setattr(S, "CHUNK", 1)
    assert found() == want
    S.plan.cache_clear()

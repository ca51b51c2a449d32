import random
import re

import numpy as np
import xxhash

from phrasewright.llm import _groups as G
from phrasewright.llm import simhash_dedup as D
from phrasewright.llm._graph import components

from .helpers import clashing, frame, odd, write


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius):
    """Smallest id reachable over links of fingerprints."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for i, f in rows:
        r = find(f)
        low[r] = i if low.get(r) is None else low[r] if i is None else min(low[r], i)
    return {f: low[find(f)] for f in prints}


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 40, 300, 700]))]
        for _ in range(rng.randrange(1, 8)):
            own = list(base)
            for _ in range(rng.randrange(3)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", " \t"]).join(own).upper() if rng.random() < 0.2 else " ".join(own))
    df = frame(spark, texts, 10).unionByName(odd(spark))
    got = D.op4_simhash_dedup(spark, write(clashing(df), tmp_path)).collect()
    rows = [(r.doc_id, brute_print(r.text)) for r in df.collect()]
    low = brute_components(rows, 2)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted((str(i), f"{f:016x}", str(low[f])) for i, f in rows)
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got}) - 10


def test_trie_join_is_exact_for_other_radii(spark, monkeypatch):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for p in list(prints):
        for _ in range(rng.randrange(12)):  # dense balls
            q = p
            for _ in range(rng.randrange(1, 7)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    for radius in (0, 1, 3, 5):
        df = spark.createDataFrame([(p,) for p in signed], "fingerprint long").withColumnRenamed("fingerprint", "fingerprint")
        df = df.selectExpr("fingerprint AS doc_id", "fingerprint")
        got = {r.fingerprint: r.component_id for r in D.classes(df, radius).collect()}
        as_signed = lambda u: u - 2**64 if u >= 2**63 else u
        want = brute_components([(as_signed(p), p) for p in prints], radius)
        assert got == {as_signed(f): i for f, i in want.items()}
        with monkeypatch.context() as m:  # subtries in blocks give the same
            m.setattr(G, "SPLIT", 4)
            assert got == {r.fingerprint: r.component_id for r in D.classes(df, radius).collect()}


def test_pieces_and_batches(monkeypatch):
    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 2**10, 400).astype(np.uint64))
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if bin(int(v[i] ^ v[j])).count("1") <= 2}
    for piece in (1, 7, 10**6):
        monkeypatch.setattr(D, "PIECE", piece)
        got = [(min(p), max(p)) for i, j in D.self_join(v, 1, np.array([0]), np.array([len(v)]), 2) for p in zip(i.tolist(), j.tolist())]
        assert set(got) == want and len(got) == len(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert D.near_duplicates(frame(spark, []).limit(0)).count() == 0

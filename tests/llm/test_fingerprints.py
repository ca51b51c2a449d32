import hashlib
import random
import re

import numpy as np
import xxhash

from phrasewright.llm import fingerprints as P

from .helpers import clashing, frame, odd, write


def votes(text):
    """Of each bit twice its votes less all weight, by the rule as text: shingles of five words, and words by length."""
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    terms = [(xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42), 1.0) for i in range(max(1, len(words) - 4))] if words else []
    terms += [(xxhash.xxh64_intdigest(w, 43), min(len(w), 12) * 0.3 / 12) for w in words]
    out = [0.0] * 256
    for h, weight in terms:
        for k, m in enumerate((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)):
            x = h * m % 2**64
            x = (x ^ x >> 32) * m % 2**64
            x ^= x >> 29
            for b in range(64):
                out[64 * k + b] += weight if x >> (63 - b) & 1 else -weight
    return out


def test_bits_are_the_signs_of_votes():
    rng = random.Random(6)
    for n in (0, 1, 2, 5, 6, 40, 300):
        text = " ".join(rng.choice(["Alpha", "beta", "épée", "😀", "the", "x"]) + str(rng.randrange(30)) for _ in range(n))
        got = np.unpackbits(np.frombuffer(P.fingerprint(text), np.uint8))
        for bit, v in zip(got, votes(text)):
            assert bit == (v > 0) or abs(v) < 1e-4


def brute(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited fingerprint, near_edited, near_next) in any order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        k = len(t) // 3
        e = t[: len(t) - k] + u[:k]
        p, q, r = (P.fingerprint(x) for x in (t, e, u))
        same = lambda a, b: sum(x == y for x, y in zip(np.unpackbits(np.frombuffer(a, np.uint8)), np.unpackbits(np.frombuffer(b, np.uint8)))) / 256
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), p.hex(), q.hex(), same(p, q), same(p, r)))
    return sorted(out)


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(2)
    words = "alpha beta gamma delta épée 😀 of the and".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(150)] + ["same text of some words here"] * 20
    df = frame(spark, texts, 50).unionByName(odd(spark))
    got = P.op3_fingerprints(spark, write(clashing(df).repartition(5), tmp_path)).collect()
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == want
    prints = [int(r.fingerprint, 16) for r in got]
    near = sorted((str(r.doc_id), sum((int(r.fingerprint, 16) ^ x).bit_count() <= P.RADIUS for x in prints) - 1, r.n_near) for r in got)
    assert all(a == b for _, a, b in near) and max(a for _, a, _ in near) >= 19


def test_one_row_and_none(spark, tmp_path):
    got = P.op3_fingerprints(spark, write(frame(spark, ["abcdef"]), tmp_path / "a")).collect()
    assert [r.edited_sha256 for r in got] == [hashlib.sha256(b"abcdab").hexdigest()]
    assert P.op3_fingerprints(spark, write(frame(spark, []).limit(0), tmp_path / "b")).count() == 0


def test_block_tables_find_all(spark, monkeypatch):
    rng = random.Random(7)
    prints = {rng.getrandbits(256) for _ in range(80)}
    for p in list(prints):
        for _ in range(rng.randrange(9)):
            q = p
            for _ in range(rng.randrange(1, 11)):
                q ^= 1 << rng.randrange(256)
            prints.add(q)
    prints = sorted(prints)
    raw = [p.to_bytes(32, "big") for p in prints]
    for radius in (0, 3, 7):
        rows = spark.createDataFrame([(w, 2) for w in raw], "fingerprint binary, n long")
        got = {bytes(r.fingerprint): r.found for r in P.counts_within(rows, radius).collect()}
        assert got == {bytes(r.fingerprint): r.found for r in P.counts_within(rows, radius, split=3).collect()}
        want = {w: 2 * sum(0 < (p ^ x).bit_count() <= radius for x in prints) for w, p in zip(raw, prints)}
        assert got == {s: n for s, n in want.items() if n}


def test_weight_moves_the_fingerprint():
    rng = random.Random(1)
    base = [f"word{rng.randrange(999)}" for _ in range(300)]
    text = " ".join(base)
    at = [P.likeness(P.fingerprint(text), P.fingerprint(" ".join(base[: 300 - k] + [f"x{rng.randrange(999)}" for _ in range(k)]))) for k in (0, 30, 100, 300)]
    assert at[0] == 1 and at[0] > at[1] > at[2] > at[3] and at[1] > 0.75 and at[3] < 0.62

import collections
import random
import zlib

from phrasewright.llm import sharding as H

from .helpers import clashing, frame, odd, write


def test_difference_is_the_textbook_method():
    # two-way differencing of 8 7 6 5 4 leaves 2
    sums, maps = H.difference([[8], [7], [6], [5], [4]], 2)
    assert sums[0] - sums[1] == 2 and sum(sums) == 30
    got = [0, 0]
    for size, m in zip([8, 7, 6, 5, 4], maps):
        got[m[0]] += size
    assert got == sums


def test_difference_keeps_sums(spark):
    rng = random.Random(1)
    for k in (2, 3, 24):
        vectors = [sorted((rng.randrange(100) for _ in range(rng.choice([1, k]))), reverse=True) for _ in range(200)]
        sums, maps = H.difference(vectors, k)
        got = [0] * k
        for v, m in zip(vectors, maps):
            assert sorted(m) == list(range(k))
            for x, place in zip(v, m):
                got[place] += x
        assert got == sums == sorted(sums, reverse=True) and sums[0] - sums[-1] <= 100
    assert H.difference([], 3) == ([0, 0, 0], [])


def test_levels(spark):
    rng = random.Random(2)
    rows = [(f"g{i}", rng.randrange(1, 10**6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, bytes long")
    size = dict(rows)
    for block in (10_000, 100, 20):
        got = H.assign(df, 24, block).collect()
        by = collections.Counter()
        for r in got:
            by[r.shard] += size[r.id]
        assert len(got) == 3000 and len(by) == 24
        assert max(by.values()) - min(by.values()) < 0.001 * sum(size.values()) / 24


def test_query(spark, tmp_path):
    rng = random.Random(3)
    texts = ["copy of one text " * 3] * 300 + [f"text {i} " + "é" * rng.randrange(1, 2000) for i in range(700)]
    df = frame(spark, texts, 1000).unionByName(odd(spark))
    folder = write(clashing(df), tmp_path)
    got = H.op1_sharding(spark, folder).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert want == collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    group, by, slots = {}, collections.Counter(), collections.defaultdict(list)
    text = {r.doc_id: r.text for r in df.where("doc_id >= 1000").collect()}
    for r in got:
        if r.doc_id in text:
            assert group.setdefault(text[r.doc_id], r.shard) == r.shard
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    hot = max(by.values())
    rest = sorted(by.values())[:-1]  # a long text is larger than an even share
    assert hot < 2 * rest[-1] and rest[-1] - rest[0] < 0.02 * rest[-1]
    assert sorted(map(str, got)) == sorted(map(str, H.op1_sharding(spark, folder).collect()))


def test_empty(spark):
    assert H.shard(frame(spark, []).limit(0), 24).count() == 0


def differenced(sizes, k):
    """Karmarkar-Karp written out: the sets of each partial partition, looked through for the two widest."""
    parts = [[(x, (i,))] + [(0, ())] * (k - 1) for i, x in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1][0] - p[0][0])
        a, b = parts[:2]
        joined = [(x + y, own + other) for (x, own), (y, other) in zip(a, reversed(b))]
        parts[:2] = [sorted(joined, reverse=True)]
    return {frozenset(own) for _, own in parts[0]}


def test_shards_are_those_of_differencing(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 10**15) for _ in range(60)]  # few and far apart: spreads don't tie
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(sizes)], "id string, bytes long")
    for k in (2, 5, 24):
        got = collections.defaultdict(set)
        for r in H.assign(df, k).collect():
            got[r.shard].add(int(r.id))
        assert {frozenset(s) for s in got.values()} == differenced(sizes, k)

import collections
import random

from pyspark.sql import functions as F

from phrasewright.llm import source_mixing as M

from .helpers import clashing, frame, odd, write


def goals(sizes, weights=M.WEIGHTS, share=1.5, cap=2.0):
    """Water filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, left = share * sum(sizes.values()), {}, dict(sizes)
    while left:
        rest = total - sum(out.values())
        rate = rest / sum(w[s] for s in left)
        full = [s for s in left if w[s] * rate > cap * left[s]]
        if not full:
            return out | {s: w[s] * rate for s in left}
        for s in full:
            out[s] = cap * left.pop(s)
    return out


def test_targets(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 25):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 1000]) * rng.randrange(1, 9) for i in range(n)}
        if n > 2:
            sizes[None] = 37
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in M.targets(df).collect()}
        want = goals(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want), (sizes, got, want)


def corpus(spark, n=400):
    rng = random.Random(8)
    texts = [" ".join("w" for _ in range(int(rng.lognormvariate(3, 1)))) for _ in range(n)]
    return frame(spark, texts, 1000, lambda i: "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None]))


def test_every_source_takes_its_target(spark, tmp_path):
    df = corpus(spark).unionByName(odd(spark)).unionByName(corpus(spark).limit(5))
    folder = write(df, tmp_path)
    got = M.op7_source_mixing(spark, folder).collect()
    assert len(got) == df.count()
    key = lambda r: (str(r.doc_id), r.size, r.source_size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, M.op7_source_mixing(spark, folder).collect()))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by, full = collections.Counter(), {}
    for r in got:
        by[r.source_size, r.target] += r.taken
    assert all(abs(v - t) <= 0.51 for (_, t), v in by.items())
    # all but one document a source take whole copies
    assert sum(r.size > 0 and r.taken % r.size > 0 for r in got) <= len(by)


def test_rates_are_the_tilted_ones(spark):
    """The rates meet the constraint, and all logits divided by size are one number a source."""
    import math

    rows = M.take(M.sized(corpus(spark))).where("size > 0").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for s, own in by.items():
        assert abs(sum(r.rate * r.size for r in own) - own[0].target) < 1e-4 * own[0].target
        if own[0].target < 2 * own[0].source_size:
            lam = [math.log(r.rate / (2 - r.rate)) / r.size for r in own]
            assert max(lam) - min(lam) < 1e-6 * max(1e-3, abs(lam[0]))


def test_mix_writes_what_is_taken(spark):
    df = clashing(corpus(spark).unionByName(odd(spark)))
    out = M.mix(df)
    assert out.columns == df.columns
    words = out.groupBy("source").agg(F.sum(M.n_words(M.text_of())).alias("n")).collect()
    want = goals({r.source: r.n for r in df.groupBy("source").agg(F.sum(M.n_words(M.text_of())).alias("n")).collect()})
    assert {r.source: r.n for r in words} == {s: round(t) for s, t in want.items() if round(t)}
    assert M.mix(df.limit(0)).count() == 0


def test_a_cut_copy_is_the_text_as_it_stands(spark):
    texts = [f"\n t{i}\n\n" + " \tw\n".join(f"v{k}" for k in range(20 + i)) + "\n" for i in range(30)]
    rows = M.mix(frame(spark, texts, 0, lambda i: f"s{i // 2}")).collect()
    cut = [r for r in rows if r.text != texts[r.doc_id]]
    assert cut and all(texts[r.doc_id].startswith(r.text) and r.text.rstrip() == r.text and r.n_chars == len(r.text) for r in cut)


def test_equal_rows_take_shares_of_their_own(spark, monkeypatch, tmp_path):
    """A third of all rows has no id and one text: they round apart, and each source takes its target."""
    hot = spark.createDataFrame([(None, "six words that all rows share", f"l{i % 7}", "hot", 29) for i in range(200)], corpus(spark, 1).schema)
    df = corpus(spark).unionByName(hot).repartition(6)
    got = M.op7_source_mixing(spark, write(clashing(df), tmp_path)).collect()
    assert len(got) == df.count() and len({r.taken for r in got if r.doc_id is None}) > 1
    out = M.mix(df)
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(M.n_words(M.text_of())).alias("n")).collect()}
    want = goals({r.source: r.n for r in df.groupBy("source").agg(F.sum(M.n_words(M.text_of())).alias("n")).collect()})
    assert words == {s: round(t) for s, t in want.items() if round(t)}
    taken = sum(r.taken for r in got if r.doc_id is None)
    assert out.where("doc_id IS NULL").agg(F.sum(M.n_words(M.text_of())).alias("n")).first().n == taken
    every = lambda: sorted((str(r.doc_id), r.size, r.taken) for r in M.take(M.sized(df)).collect())
    first = every()
    monkeypatch.setattr(M, "PIECE", 7)
    assert every() == first == sorted((str(r.doc_id), r.size, r.taken) for r in got)


def test_query_on_an_empty_table(spark, tmp_path):
    assert M.op7_source_mixing(spark, write(corpus(spark).limit(0), tmp_path)).count() == 0

import collections
import random
import re

from phrasewright.llm import quality_rules as Q

from .helpers import clashing, frame, odd, write


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(words, words[1:], words[2:]))
    n = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "c", " ", "  ", "\n", "#", "é", "😀", "\t", "\x0b"]) + rng.choice(["", " "]) for _ in range(rng.randrange(120))) for _ in range(150)]
    df = frame(spark, texts).unionByName(odd(spark))
    want = collections.Counter((i, *brute(t)) for i, t in df.select("doc_id", "text").collect())
    got = Q.op10_quality_rules(spark, write(df, tmp_path)).collect()
    assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "walked", "quietly", "morning", "letters"]) + str(rng.randrange(9999)) * (rng.random() < 0.6) for _ in range(n))


def test_good_prose_stays_and_junk_goes(spark):
    rng = random.Random(5)
    good = [prose(rng, 120) for _ in range(80)]
    junk = [" ".join(w + "%%%" for w in prose(rng, 120).split()) for _ in range(8)] + [prose(rng, 120).upper().replace(" ", "!! ") for _ in range(8)]
    kept = {r.doc_id for r in Q.keep_good(clashing(frame(spark, good + junk))).collect()}
    assert kept == set(range(80))


def test_keep_good_returns_the_columns_it_got(spark):
    df = clashing(odd(spark))
    assert Q.keep_good(df).columns == df.columns
    assert Q.keep_good(df.limit(0)).count() == 0


def test_em_recovers_rule_accuracy(spark):
    rng = random.Random(1)
    rows = collections.Counter()
    n = len(Q.RULES)
    for _ in range(4000):
        good = rng.random() < 0.8
        rows[tuple((1 if good else -1) if rng.random() < (0.95 if good else 0.7) else (-1 if good else 1) for _ in range(n))] += 1
    model = Q.fit(spark.createDataFrame([(list(v), c) for v, c in rows.items()], "v array<int>, n long"), weight=0.002)
    assert abs(model.prior - 0.8) < 0.03
    assert all(abs(g[2] - 0.95) < 0.03 for g in model.good) and all(abs(b[0] - 0.7) < 0.06 for b in model.bad)


def textbook(texts, steps=25):
    """Votes by the rules as text, and EM by matrices over all documents, one row each."""
    import numpy as np

    stats = []
    for text in texts:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        n, chars, symbols, dup, repeat = brute(text)
        runs = sum(a == b for a, b in zip(words, words[1:]))
        upper, shouts = sum(c.isupper() and len(c) == 1 for c in text), len(re.findall("!!+", text))
        stop = sum(w in Q.STOPWORDS for w in words)
        stats.append([
            -1 if n < 20 else int(n >= 50), -1 if chars > 15 * n or chars < 2 * n else int(3 * n <= chars <= 12 * n), -1 if 10 * symbols > n else int(50 * symbols <= n),
            -1 if 10 * dup > 3 * len(lines) else int(20 * dup <= len(lines)), -1 if 10 * repeat > 3 * n else int(10 * repeat <= n), -1 if 10 * upper > 3 * chars else int(10 * upper <= chars),
            -1 if 10 * shouts > n else int(100 * shouts <= n), -1 if 10 * runs > n else int(50 * runs <= n), -1 if 100 * stop < n else int(20 * stop >= n),
        ])
    v = np.array(stats)
    hot = (v[:, :, None] == np.array([-1, 0, 1])).astype(float)
    prior, good, bad = 0.85, np.tile([0.02, 0.1, 0.88], (9, 1)), np.tile([0.3, 0.1, 0.6], (9, 1))
    held, first = 0.02 * len(v), (0.85, good, bad)
    score = lambda: 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + (hot * np.log(good / bad)).sum((1, 2)))))
    for _ in range(steps):
        p = score()
        was = good, bad
        good = ((hot * p[:, None, None]).sum(0) + held * first[1]) / (p.sum() + held)
        bad = ((hot * (1 - p)[:, None, None]).sum(0) + held * first[2]) / ((1 - p).sum() + held)
        prior = min(0.999, max(0.001, (p.sum() + held * first[0]) / (len(v) + held)))
        if max(abs(good - was[0]).max(), abs(bad - was[1]).max()) < 1e-5:
            break
    return score()


def test_verdicts_match_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(10, 150)) for _ in range(60)] + [prose(rng, 80).upper().replace(" ", "!! ") for _ in range(6)] + ["%% ".join(prose(rng, 60).split()) for _ in range(6)]
    texts += ["word " * 70, (prose(rng, 8) + "\n") * 9, "", None]
    got = {r.doc_id: r for r in Q.op10_quality_rules(spark, write(clashing(frame(spark, texts)), tmp_path)).collect()}
    for i, p in enumerate(textbook(texts)):
        assert abs(got[i].posterior - p) < 1e-9 and got[i].kept == (p >= 0.5 and not got[i].base_failed)
    assert Q.op10_quality_rules(spark, write(frame(spark, []), tmp_path / "none")).count() == 0

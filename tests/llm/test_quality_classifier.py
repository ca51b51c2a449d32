import random

import numpy as np

from phrasewright.llm import quality_classifier as C

from .helpers import clashing, frame, odd, write


def corpus(n=240):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 200))) + "." for _ in range(n)]
    bad = [t.upper().replace(" ", "!! ") if i % 2 else " ".join(w + "%%%" for w in t.split()) for i, t in enumerate(good[: n // 4])]
    return good[n // 4 :] + bad, [1] * (n - n // 4) + [0] * (n // 4)


def test_held_out_accuracy(spark, tmp_path):
    texts, y = corpus()
    df = clashing(frame(spark, texts, 1000).unionByName(odd(spark)))
    folder = write(df, tmp_path)
    labels = [(1000 + i, v) for i, v in enumerate(y)] + [(None, 1), (1, None), (99999, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    got = C.op8_quality_classifier(spark, folder).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {1000 + i: v for i, v in enumerate(y)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    again = {r.doc_id: r.score for r in C.op8_quality_classifier(spark, folder).collect() if r.doc_id in truth}
    assert all(again[r.doc_id] == r.score for r in got if r.doc_id in truth)


def test_no_labels_one_class_and_no_rows(spark, tmp_path):
    folder = write(frame(spark, ["a b c", "", None]), tmp_path)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    assert len({r.score for r in C.op8_quality_classifier(spark, folder).collect()}) == 1
    spark.createDataFrame([(0, 1), (2, 1)], "doc_id long, quality int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    assert [r.predicted for r in C.op8_quality_classifier(spark, folder).collect()] == [1, 1, 1]
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert C.op8_quality_classifier(spark, folder).count() == 0


def test_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(3)
    xs = [(np.sort(rng.choice(40, 8, replace=False)), rng.normal(size=8).astype(np.float32)) for _ in range(120)]
    y = np.where(rng.random(120) < 0.5, 1.0, -1.0)
    w, bias = C.coordinate_descent(xs, y, np.full(120, 0.5), epochs=4000, tol=1e-7)

    def loss(w, b):
        return 0.5 * (float(w @ w) + b * b) + 0.5 * sum(max(0.0, 1 - t * (float(w[f] @ v) + b)) for (f, v), t in zip(xs, y))

    best = loss(w.astype(float), bias)
    for _ in range(200):
        assert loss(w + rng.normal(size=len(w)) * (w != 0) * 0.01, bias + rng.normal() * 0.01) >= best - 1e-4


def test_count_ratio():
    r = C.count_ratio([np.array([1, 2]), np.array([2]), np.array([3])], np.array([1, 1, 0]))
    assert r[1] > 0 and r[2] > r[1] and r[3] < 0

import collections
import os
import random

import pytest

from phrasewright.llm import piece_encoding, secret_scans
from phrasewright.llm.similar_texts import classes

from .helpers import clashing, frame, odd, write
from .test_quality_rules import prose
from .test_source_mixing import goals

pytestmark = pytest.mark.skipif(not os.path.exists(piece_encoding.MODEL), reason="no vocabulary file")


def corpus(spark):
    rng = random.Random(12)
    good = [prose(rng, 150) for _ in range(40)]
    near = [t + " tail" for t in good[:6]]
    copies = good[6:12] * 3
    junk = [t.upper().replace(" ", "!! ") for t in good[:5]] + ["too short"]
    secret = [prose(rng, 100) + " password: wonderland99 " + prose(rng, 30) for _ in range(3)]
    return frame(spark, good + near + copies + junk + secret, 100).unionByName(odd(spark)), good, secret


def test_stages_in_order(spark, tmp_path):
    import corpus_pipeline as P

    df, good, secret = corpus(spark)
    docs = clashing(df)
    ids = [range(100, 140), range(140, 146), range(146, 164), range(164, 170), range(170, 173)]
    for k, (name, stage) in enumerate(P.STAGES):
        docs_before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < 4:
            assert docs.columns == docs_before.columns
        rows = docs.collect()
        found = {r.doc_id for r in rows}
        if k == 0:  # junk goes, all that is clean stays
            assert {*ids[0], *ids[1], *ids[2], *ids[4]} <= found and not found & set(ids[3])
        if k == 1:  # one of each group
            assert {*ids[0], *ids[4]} <= found and not found & {*ids[1], *ids[2]} and len(rows) == len(found)
            assert len({r["class"] for r in classes(docs).collect()}) == len(rows)
        if k == 2:
            assert sum("[REDACTED]" in r.text for r in rows) == 3 and not any("wonderland99" in r.text for r in rows)
            assert all(len(r.spans) == 0 for r in secret_scans.find(docs).collect())
        if k == 3:
            words = collections.Counter()
            for r in rows:
                words[r.source] += len(r.text.split())
            before = collections.Counter()
            for r in docs_before.collect():
                before[r.source] += len((r.text or "").split())
            assert dict(words) == {s: round(t) for s, t in goals(before).items() if round(t)}
            texts = collections.Counter((r.doc_id, r.text) for r in rows)
    v = piece_encoding.Vocabulary.load()
    assert collections.Counter((r.doc_id, v.decode(r.ids)) for r in docs.collect()) == texts


def test_run(spark, tmp_path):
    import corpus_pipeline as P

    df, _, _ = corpus(spark)
    out = P.run(spark, write(df, tmp_path / "a"))
    assert out.columns == ["doc_id", "source", "ids", "n_pieces", "scores"] and out.count() > 40
    assert P.run(spark, write(df.limit(0), tmp_path / "b")).count() == 0
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None

import random

import numpy as np

from phrasewright.llm import toxicity as T

from .helpers import clashing, frame, odd, write


def grammar(**kw):
    return T.Grammar({w: 3.0 for w in T.INSULTS}, {"blarg": 2.0}, **kw)


def one(text):
    return sum(grammar().clauses(text))


def test_clauses():
    assert one("what a lovely day") == 0
    assert abs(one("an idiot") - 1.05) < 1e-9  # a word alone is no clause
    assert abs(one("idiot idiot idiot") - 1.05 * 1.4) < 1e-9  # and goes on being one
    assert abs(one("you idiot") - 3.9) < 1e-9  # aimed
    assert abs(one("an idiot is what you are") - 3.9) < 1e-9  # aimed by what follows
    assert abs(one("an idiot stood there for hours before you came") - 1.05) < 1e-9
    assert abs(one("you such an idiot") - 3.9 * 1.3) < 1e-9  # strong
    assert abs(one("not an idiot") - 1.05 * 0.3) < 1e-9  # negated
    for quoted in ("he said you idiot", 'he said "you idiot"', "he said: you idiot", "he said: “you idiot”"):
        assert abs(one(quoted) - 3.0 * 0.6 * 1.3) < 1e-9  # reported, across quotes and colon
    assert abs(one('he said "go. you idiot"') - 3.0 * 0.6 * 1.3) < 1e-9  # the quote goes on over the end of a clause
    assert abs(one('he said "go" you idiot') - 3.9) < 1e-9  # and ends the report
    assert abs(one("not today my dear friends an idiot") - 1.05) < 1e-9  # out of the scope of the negation
    assert abs(one("he said so. an idiot") - 1.05) < 1e-9  # both end with the clause
    assert abs(one("blargos go BLARGEN") - 1.4) < 1e-9  # forms of a stem
    assert one("kill the process") == 0 and one("we will kill you") == 1.0 and abs(one("we won't kill you") - 0.3) < 1e-9
    assert abs(one('"we will kill" he wrote "you"') - 1.0) < 1e-9
    assert np.allclose(grammar().clauses("idiot. scum; moron"), [1.05] * 3)


def test_words_of_a_class_stay_in_it_whatever_the_stems():
    stems = {"kill": 2.0, "them": 2.0, "said": 2.0, "noth": 2.0, "real": 2.0}
    g = T.Grammar({w: 3.0 for w in T.INSULTS}, stems)
    assert g.clauses("kill the process") == [] and g.clauses("he said them") == [] and g.clauses("such real people") == []
    assert g.clauses("killjoy") == [2.0 * 0.35]
    assert not {e for e in T._entries("kill them said real idiot") if e.startswith(("kill", "them", "said", "real"))}


def simulate(symbols):
    """The five transducers in a row, without composing them."""
    states, out = [0] * 5, []
    for s in symbols:
        symbol = (s, frozenset())
        for k, step in enumerate((T.negation, T.reported, T.insult, T.target, T.threat)):
            states[k], symbol = step(states[k], symbol)
        weight = np.prod([T.MARKS[m] for m in symbol[1] if m != T.AIMS]) if symbol[0] in (T.INSULT, T.THREAT) else 0.0
        out.append((weight, T.AIMS in symbol[1]))
    return out


def test_composition_equals_the_cascade():
    rng = random.Random(5)
    for _ in range(200):
        symbols = [rng.choice(T.SYMBOLS) for _ in range(30)]
        state, got = 0, []
        for s in symbols:
            got.append((T.WEIGHT[state][s], T.LATE[state][s]))
            state = T.NEXT[state][s]
        assert np.allclose(got, simulate(symbols))


def by_hand(g, text):
    """Clause scores from the simulated cascade over the symbols of a text."""
    out, total, waiting, alone = [], 0.0, 0.0, 0.0
    marked = [g.symbol(t) for t in T.tokens(text)]
    for (kind, weight), (w, late) in zip(marked, simulate([k for k, _ in marked])):
        waiting = weight if kind == T.THREAT else waiting
        alone = w * weight if w and kind == T.INSULT else alone
        total += (alone if kind == T.INSULT else w * waiting) if w else 0
        total += alone * (1.3 / 0.35 - 1) if late else 0
        if kind in (T.END, T.LINE):
            out += [total] if total else []
            total = 0.0
    return out + ([total] if total else [])


def test_query_equals_the_grammar_run_by_hand(spark, tmp_path):
    rng = random.Random(8)
    words = T.INSULTS[:3] + T.THREATS[:2] + T.TARGETS[:3] + T.NEGATIONS[:2] + T.REPORTS[:2] + T.STRONGS[:2] + [".", '"', ":", "\n", "blue", "sky", "goes"] * 2
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(120)]
    folder = write(frame(spark, texts), tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    g = T.Grammar({w: 3.0 for w in T.INSULTS}, {})
    for r in T.op2_toxicity(spark, folder).collect():
        c = by_hand(g, texts[r.doc_id])
        z = max(c, default=0.0) * 1.0 + np.log1p(sum(c)) - 2.0
        assert abs(r.score - 1 / (1 + np.exp(-(z + np.log(0.7 / 0.3))))) < 1e-9 and r.predicted == (r.score >= 0.7)


def corpus(n=300):
    rng = random.Random(3)
    syllables = ["ra", "mo", "ti", "len", "sor", "ve", "ka", "du"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    texts, y = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 150))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zogri" + word() if i % 8 else "moron")
        texts.append(" ".join(w) + ".")
        y.append(int(toxic))
    return texts, y


def test_held_out_and_learned_stems(spark, tmp_path):
    texts, y = corpus()
    df = clashing(frame(spark, texts, 1000).unionByName(odd(spark)))
    folder = write(df, tmp_path)
    spark.createDataFrame([(1000 + i, v) for i, v in enumerate(y)] + [(None, 1), (2, None), (99999, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = T.op2_toxicity(spark, folder).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {1000 + i: v for i, v in enumerate(y)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    again = {r.doc_id: r.score for r in T.op2_toxicity(spark, folder).collect() if r.doc_id in truth}
    assert all(again[r.doc_id] == r.score for r in got if r.doc_id in truth)


def test_no_labels_and_no_rows(spark, tmp_path):
    folder = write(frame(spark, ["you idiot", "", None, "fine words"]), tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in T.op2_toxicity(spark, folder).collect()}
    assert got[0].score > got[1].score == got[2].score == got[3].score and got[0].predicted == 1
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert T.op2_toxicity(spark, folder).count() == 0

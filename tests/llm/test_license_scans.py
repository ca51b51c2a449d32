import random
import re

from phrasewright.llm import license_scans as L
from phrasewright.llm.license_bodies import BODIES
from phrasewright.llm.license_rules import HAND, rules

from .helpers import clashing, frame, odd, write

TEXTS = [
    "Licensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "All rights reserved. ALL RIGHTS, RESERVED all rights reserved", "cc by cc-by CC  by-sa", "general public license license", "nothing of the kind",
    "K license apache K LICENSE İ", "permission is hereby granted, free of charge, to any person obtaining a copy of this", "mozilla public license 2.0", "mit dem und mit", "see the licence",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS of any kind, either express or implied.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING", "keine Gewährleistung; sans garantie, tous droits réservés",
    "This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "creative commons attribution non commercial share alike licence v4.0", "x " * 3000 + "gpl v3 or later", "GPLv3 lgpl v2 1",
]
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def matches(words):
    """Every rule at every keyword, over the whole text."""
    found = set()
    for r in rules():
        for i, w in enumerate(words):
            if w == r.keyword and (not r.also or r.also in words[max(0, i - L.REACH) : i + L.REACH + 1]):
                marked = " " + " ".join([*words[max(0, i - L.REACH) : i], "@" + w, *words[i + 1 : i + 1 + L.REACH]]) + " "
                if m := re.search(f"(?<= )({r.pattern})(?= )", marked):
                    at = i - m[1].split("@")[0].count(" ")
                    found.add((at, at + m[1].count(" ") + 1, r))
    return found


def brute(text):
    words = WORD.findall(lower(text))
    found = matches(words)
    kept = [x for x in found if x[2].base or not any(y[0] <= x[0] and y[1] >= x[1] and ((y[2].priority, y[1] - y[0], -y[2].order) > (x[2].priority, x[1] - x[0], -x[2].order)) for y in found)]
    base = []
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), base, kept


def test_matches_brute_force(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = "cc by all rights reserved general public license gnu apache 2 0 licensed under the mit sa nc é domain version".split()
    clauses = [p.replace("@", "") for ps in BODIES.values() for p in ps if not re.search(r"[(\[?]", p)]
    texts = TEXTS + [f"x {c}, {rng.choice(clauses)}. end" for c in clauses] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = frame(spark, texts, 50).unionByName(odd(spark))
    got = L.op9_license_scans(spark, write(clashing(df), tmp_path)).collect()
    want = []
    for i, t in df.select("doc_id", "text").collect():
        n, base, kept = brute(t)
        starts = [b[0] for b in base]
        want.append((str(i), n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b[1] for b in base})), ",".join(sorted({x[2].label for x in kept}))))
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in got)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)


def test_labels(spark, tmp_path):
    got = {r.doc_id: r.labels for r in L.op9_license_scans(spark, write(frame(spark, TEXTS), tmp_path)).collect()}
    assert "apache-2.0" in got[0] and got[1] == "mit" and "gpl-3" in got[2] and "cc-by-nc" in got[3] and got[7] == "" and got[11] == ""


def test_rules_are_hundreds_and_each_holds_its_keyword():
    table = rules()
    assert len(HAND) + sum(map(len, BODIES.values())) > 250  # by hand
    assert len({r.pattern for r in table}) > 900
    assert all(len(side.split()) <= L.REACH for ps in BODIES.values() for p in ps for side in p.split("@"))
    assert all(f"@{r.keyword}" in r.pattern and re.compile(r.pattern) for r in table)


def test_empty(spark):
    assert L.scan(frame(spark, []).limit(0)).count() == 0

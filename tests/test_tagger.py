import io
import random

import pytest

from phrasewright.functions import analyzer, scalars
from phrasewright.operators import formats, matching
from phrasewright.operators.tagger import Tagger
from phrasewright.sources import dictionaries, requests
from pyspark.sql import functions as F

SAMPLE = [("Old Moss Ford", "PLACE", "p:ford"), ("Old Moss", "PLACE", "p:moss"), ("Moss", "PLACE", "p:m"), ("Mörkon", "PLACE", "p:mork"), ("Morkon", "PLACE", "p:mork"), ("Copper Kettle", "PRODUCT", "it:kettle"), ("ab-kettle", "PRODUCT", "it:kettle2")]


def texts(spark, *t):
    return spark.createDataFrame(list(enumerate(t)), "k int, text string")


def tags(spark, tagger, text, policy="longest", plan="kernel"):
    got = tagger.tag(texts(spark, text), ["k"], policy=policy, plan=plan)
    return [(r.start, r.end, r.surface, r.id, r.output) for r in got.orderBy("seq").collect()]


@pytest.fixture(scope="module")
def sample(spark):
    return Tagger.build(spark, SAMPLE)


@pytest.mark.parametrize("plan", ["kernel", "join"])
def test_goldens(spark, sample, plan):
    assert tags(spark, sample, "I like Old Moss Ford", plan=plan) == [(7, 20, "Old Moss Ford", "p:ford", "OLDMOSSFORD")]
    assert tags(spark, sample, "reach morkon tomorrow", plan=plan) == [(6, 12, "morkon", "p:mork", "MORKON")]
    assert tags(spark, sample, "in Mörkon, MORKON", plan=plan) == [(3, 10, "Mörkon", "p:mork", "MORKON"), (12, 18, "MORKON", "p:mork", "MORKON")]
    assert tags(spark, sample, "we use ab-kettle here", plan=plan) == [(7, 16, "ab-kettle", "it:kettle2", "ABKETTLE")]
    assert [t[:2] for t in tags(spark, sample, "I like Old Moss Ford", "all", plan)] == [(7, 15), (7, 20), (11, 15)]
    assert tags(spark, sample, "Old-Moss", plan=plan) == [] and tags(spark, sample, "", plan=plan) == []


def test_greedy_runs_forward(spark):
    t = Tagger.build(spark, [("a b", "x", "1"), ("b c d", "x", "2")])
    for plan in ("kernel", "join"):
        assert [x[:2] for x in tags(spark, t, "a b c d", plan=plan)] == [(0, 3)]
        assert [x[:2] for x in tags(spark, t, "a b c d", "all", plan)] == [(0, 3), (2, 7)]


def test_dictionary_rules(spark):
    t = Tagger.build(spark, [("Mörkon", "C", "de"), ("Morkon", "C", "en"), ("morkon", "C", "de"), ("日本", "C", "x"), ("b", "K", "1", ""), ("b", "K", "1", None)])
    assert len(t) == 2 and t.record_count() == 4 and t.kinds() == ["C", "K"] and not t.is_empty()
    assert [x[3] for x in tags(spark, t, "hello morkon")] == ["de", "en"]  # synonyms in their order
    assert [x[4] for x in tags(spark, t, "b")] == ["", "B"]  # a given output stays, if empty
    assert Tagger.build(spark, []).is_empty()
    with pytest.raises(ValueError):
        t.tag(texts(spark, "x"), ["k"], policy="none")


ADVERSARIAL = {
    "foo - bar": [("foo", 0, 3), ("bar", 6, 9)], "-foo-": [("foo", 1, 4)], "ab-kettle": [("abkettle", 0, 9)], "x — y": [("x", 0, 1), ("y", 6, 7)], "Mörkon x": [("morkon", 0, 7), ("x", 8, 9)],
    "Mörkon": [("mo", 0, 2), ("rkon", 4, 8)], "Straße": [("strasse", 0, 7)], "Ÿk": [("k", 2, 3)], "Key": [("ey", 3, 5)], "Old­Moss": [("old", 0, 3), ("moss", 5, 9)],
    "a_b": [("a", 0, 1), ("b", 2, 3)], "C++ C#": [("c", 0, 1), ("c", 4, 5)], "日本Old": [("old", 6, 9)], "\U0001f600 ny": [("ny", 5, 7)], "": [], "   ": [], "--": [],
    "x-" * 6000 + "the": [("x" * 6000 + "the", 0, 12003)], "Æsop ŒUVRE þorn ×÷": [("aesop", 0, 5), ("oeuvre", 6, 12), ("thorn", 13, 18)],
}


def test_tokens(spark):
    for text, want in ADVERSARIAL.items():
        assert analyzer.tokenize(text) == want
    rows = texts(spark, *ADVERSARIAL)
    got = {i: [] for i in range(len(ADVERSARIAL))}
    for r in matching.tokens(rows, ["k"], "text").orderBy("k", "i").collect():
        got[r.k].append((r.tok, r.start, r.end))
    assert list(got.values()) == list(ADVERSARIAL.values())
    cols = rows.select(analyzer.key_column(F.col("text")).alias("key"), analyzer.output_column(F.col("text")).alias("out"), "k").orderBy("k").collect()
    for r, text in zip(cols, ADVERSARIAL):
        assert r.key == analyzer.normalize_key(text) and r.out == analyzer.derive_output(text)
    assert len(analyzer.FOLDS) == 64


def brute(text, phrases, policy):
    toks = analyzer.tokenize(text)
    keys = {tuple(analyzer.normalize_key(p).split("\x1e")): p for p in phrases}
    out, i = [], 0
    while i < len(toks):
        ends = [j for j in range(i + 1, len(toks) + 1) if tuple(t[0] for t in toks[i:j]) in keys]
        if policy == "all":
            out += [(toks[i][1], toks[j - 1][2]) for j in ends]
        elif ends:
            out.append((toks[i][1], toks[ends[-1] - 1][2]))
            i = ends[-1]
            continue
        i += 1
    return out


def test_random_dictionaries(spark):
    rng = random.Random(1)
    for _ in range(3):
        phrases = list({" ".join(rng.choice("aébc") for _ in range(rng.randrange(1, 5))) for _ in range(12)})
        tagger = Tagger.build(spark, [(p, "x", p) for p in phrases])
        bodies = ["".join(rng.choice(["a", "é", "b", "c", " ", " ", "-", "漢"]) for _ in range(rng.randrange(60))) for _ in range(40)] + ["a b c " * 50]
        for policy in ("all", "longest"):
            for plan in ("kernel", "join"):
                got = {k: [] for k in range(len(bodies))}
                for r in tagger.tag(texts(spark, *bodies), ["k"], policy=policy, plan=plan).collect():
                    got[r.k].append((r.start, r.end))
                assert [sorted(set(g)) for g in got.values()] == [sorted(set(brute(b, phrases, policy))) for b in bodies]


def test_csv_cells():
    cases = {'"Reed, Anna",17,"She saw ""it"""': ["Reed, Anna", "17", 'She saw "it"'], '"abc"def,x': ["abcdef", "x"], '""x': ["x"], "a,,b": ["a", "", "b"], "": [""], 'a"b,c': ['a"b', "c"], '"open, end': ["open, end"], "x\r\r": ["x"], '"""a"""': ['"a"']}
    for line, cells in cases.items():
        assert scalars.split_csv_line(line) == cells


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "d.tsv").write_bytes("# comment\n\nOld Moss\t1\r\n Moss \n\tonly\t9\n".encode())
    t = Tagger.from_tsv_file(spark, str(tmp_path / "d.tsv"))
    assert sorted((r.key, r.id, r.kind) for r in t.records.collect()) == [("moss", "4", "d"), ("old\x1emoss", "1", "d"), ("only", "9", "d")]
    data = tmp_path / "data"
    data.mkdir()
    (data / "intent.csv").write_text("intent, Action ,response\nbuy,BUY,Buying\nview,,x\n,skipped,\n")
    (data / "Product.CSV").write_text('name,alias\n"Kettle, Copper",no\n')
    (data / "empty.csv").write_text("")
    (data / "notes.txt").write_text("a,b\nc,d\n")
    t = Tagger.from_data_dir(spark, str(data))
    assert sorted((r.key, r.kind, r.output) for r in t.records.collect()) == [("buy", "intent", "BUY"), ("kettle\x1ecopper", "Product", "KETTLECOPPER"), ("view", "intent", "VIEW")]
    assert {len(r.id) for r in t.records.collect()} == {36}
    ids = [sorted(r.id for r in Tagger.from_data_dir(spark, str(data), stable_ids=True).records.collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 3
    [(start, end, surface, id_, output)] = tags(spark, t, "we may buy some bread")
    assert (surface, output, len(id_)) == ("buy", "BUY", 36)
    monkeypatch.delenv("DATA", raising=False)
    assert Tagger.from_env(spark) is None
    monkeypatch.setenv("DATA", str(data))
    assert len(Tagger.from_env(spark)) == 3
    (tmp_path / "bad.tsv").write_bytes(b"caf\xe9\t1\n")
    with pytest.raises(UnicodeDecodeError):
        dictionaries.from_tsv_file(spark, str(tmp_path / "bad.tsv"))


def test_scalars(spark):
    assert scalars.url_decode("a+b%20c%C3%BC%zz%") == "a b cü%zz%" and scalars.url_decode("%+4") == "\x04"
    assert scalars.query_param("x&text=a%26b&text=c", "text") == "a&b" and scalars.query_param("", "text") is None
    df = spark.createDataFrame([("x&text=a%26b&text=c", 'say "hi"\\\n\x01ü')], "q string, s string")
    r = df.select(scalars.query_param_column(F.col("q"), "text").alias("t"), scalars.query_param_column(F.col("q"), "no").alias("n"), scalars.json_escape_column(F.col("s")).alias("e"), scalars.url_decode_column(F.lit("100%+a")).alias("u")).first()
    assert (r.t, r.n, r.e, r.u) == ("a&b", None, scalars.json_escape('say "hi"\\\n\x01ü'), scalars.url_decode("100%+a"))
    assert scalars.file_stem("/a/b.c.csv") == "b.c" and len(scalars.uuid_v4()) == 36 and scalars.uuid_v4()[14] == "4"
    assert spark.range(1).select(scalars.file_stem_column(F.lit("x/y/intent.csv"))).first()[0] == "intent"


def test_formats(spark, sample):
    docs = texts(spark, "morkon Copper Kettle Mörkon", "none")
    found = sample.tag(docs, ["k"])
    simple = {r.k: r.response for r in formats.simple(docs, found, ["k"]).collect()}
    assert [d.surface for d in simple[0].docs] == ["morkon", "Copper Kettle", "Mörkon"] and simple[1].docs == [] and simple[1].text == "none"
    solr = {r.k: r.response for r in formats.solr(docs, found, ["k"]).collect()}
    assert solr[0].response.numFound == 2 and solr[0].response.docs[0].name == ["morkon", "Mörkon"] and solr[0].response.docs[0].type == "PLACE"
    assert [(t.startOffset, t.endOffset, t.ids) for t in solr[0].tags] == [(0, 6, ["p:mork"]), (7, 20, ["it:kettle"]), (21, 28, ["p:mork"])]
    assert solr[1].response.numFound == 0 and solr[1].tags == []
    lines = [r.line for r in formats.tsv_lines(found, ["k"]).orderBy("seq").collect()]
    assert lines[0] == "0\t6\tPLACE\tp:mork\tMORKON\tmorkon"


def test_requests(spark, sample):
    rows = [
        (0, "GET", "/tag?text=in+M%C3%B6rkon", None), (1, "GET", "/tag?text=morkon&format=SOLR", None), (2, "POST", "/tag", '{"text": "reach Mörkon", "format": "solr"}'), (3, "POST", "/tag?format=simple", '{"text": "morkon", "format": "solr"}'),
        (4, "GET", "/tag?text=+", None), (5, "GET", "/tag?text=x&format=", None), (6, "PUT", "/tag", None), (7, "GET", "/nothing", None), (8, "GET", "/health", None), (9, "GET", "/tag", None),
    ]
    got = {r.k: r for r in requests.respond(sample, spark.createDataFrame(rows, "k int, method string, url string, body string"), "k").collect()}
    assert [got[i].status for i in range(10)] == [200, 200, 200, 200, 400, 400, 405, 404, 200, 400]
    assert '"surface":"Mörkon"' in got[0].response and '"numFound":1' in got[1].response and '"numFound":1' in got[2].response and '"totaltime"' in got[3].response


def test_stream(spark, sample, tmp_path):
    from phrasewright.streaming.tagging import tag_stream, write_tags

    texts(spark, "Old Moss Ford", "morkon").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, text string").parquet(str(tmp_path / "in"))
    q = tag_stream(sample, stream, ["k"]).writeStream.format("memory").queryName("tags").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.surface for r in spark.table("tags").collect()) == ["Old Moss Ford", "morkon"]
    write_tags(sample, stream, ["k"], str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.surface for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Old Moss Ford", "morkon"]


def test_command_line(spark, tmp_path, monkeypatch):
    from phrasewright.__main__ import main

    monkeypatch.delenv("DATA", raising=False)
    (tmp_path / "d.tsv").write_text("Old Moss\t1\n")
    out, err = io.StringIO(), io.StringIO()
    assert main([str(tmp_path / "d.tsv"), "in", "Old", "Moss"], stdout=out, stderr=err) == 0
    assert out.getvalue() == "3\t11\td\t1\tOLDMOSS\tOld Moss\n"
    assert main([], stderr=err) == 2 and main([str(tmp_path / "missing.tsv")], stderr=err) == 1
    out = io.StringIO()
    assert main([str(tmp_path / "d.tsv")], stdin=io.StringIO("old moss"), stdout=out, stderr=err) == 0 and out.getvalue().startswith("0\t8\t")


def test_both_plans_number_the_tags(spark):
    t = Tagger.build(spark, [("a b", "x", "1"), ("b c", "y", "2"), ("a", "x", "3"), ("A b", "z", "4"), ("c", "x", "5")])
    df = texts(spark, "a b c a-b, A b c", "b c b", "")
    for policy in ("all", "longest"):
        of = {plan: t.tag(df, ["k"], policy=policy, plan=plan) for plan in ("kernel", "join")}
        assert of["join"].columns == of["kernel"].columns
        assert sorted(of["join"].collect()) == sorted(of["kernel"].collect())
        lines = [sorted(formats.tsv_lines(x, ["k"]).collect()) for x in of.values()]
        assert lines[0] == lines[1] and lines[0]


def test_keys_may_have_the_names_of_a_tag_s_columns(spark, sample):
    df = spark.createDataFrame([(1, "a", "morkon x Old Moss"), (2, None, "none"), (None, None, "Moss morkon")], "id int, start string, text string")
    for keys in (["id"], ["id", "start"]):
        for plan in ("kernel", "join"):
            found = sample.tag(df, keys, plan=plan)
            assert found.columns[: len(keys)] == [f"key_{k}" for k in keys]
            for shape in (formats.simple, formats.solr):
                out = {r.key_id: r.response for r in shape(df, found, keys).collect()}
                assert set(out) == {1, 2, None}
            docs = {r.key_id: r.response.docs for r in formats.simple(df, found, keys).collect()}
            assert docs[2] == [] and [d.surface for d in docs[None]] == ["Moss", "morkon"] and [d.surface for d in docs[1]] == ["morkon", "Old Moss"]
            assert "key_id" in formats.tsv_lines(found, keys).columns
    with pytest.raises(ValueError, match="told apart"):
        sample.tag(df.withColumn("key_id", F.lit(1)), ["id", "key_id"])


def test_plans_agree_whatever_the_bounds(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    entries = [(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))), rng.choice("xy"), str(i)) for i in range(150)]
    bodies = [" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(30)]
    bodies += bodies[:3] * 4 + [None, ""]  # equal texts, under one key and under others
    df = spark.createDataFrame([(i % 7 if i % 5 else None, t) for i, t in enumerate(bodies)], "k int, text string")
    entries = spark.createDataFrame([(p, k, i, None, n) for n, (p, k, i) in enumerate(entries)], dictionaries.ENTRY)
    for policy in ("all", "longest"):
        t = Tagger.build(spark, entries)
        want = sorted(map(str, t.tag(df, ["k"], policy=policy).collect()))
        assert len(want) > 500
        for name, value in (("MAX_RECORDS", 1), ("MAX_TOKENS", 1), ("MAX_BYTES", 1)):
            with monkeypatch.context() as m:
                m.setattr(matching, name, value)
                m.setattr(matching, "_ROWS", 3)
                m.setattr(matching, "GATE_BITS", 1 << 15 if name == "MAX_TOKENS" else 1 << 26)
                assert sorted(map(str, t.tag(df, ["k"], policy=policy).collect())) == want


def test_a_text_with_many_matches(spark):
    t = Tagger.build(spark, [("a b", "x", "1"), ("b a", "x", "2"), ("c", "x", "3")])
    body = "a b c " * 7000
    got = t.tag(texts(spark, body), ["k"], plan="join").orderBy("seq").collect()
    assert len(got) == 14000 and [r.seq for r in got] == list(range(14000))
    assert got[-1].end == len(body) - 1 and {r.surface for r in got} == {"a b", "c"}


def test_responses_by_the_join_plan(spark, sample, monkeypatch):
    rows = spark.createDataFrame([(0, "GET", "/tag?text=in+M%C3%B6rkon", None), (1, "GET", "/tag?text=%E3%80%80%09", None), (2, "GET", "/tag?text=x&format=a%27%22b", None)], "id int, method string, url string, body string")
    want = sorted(map(str, requests.respond(sample, rows, "id").collect()))
    fresh = Tagger(sample.records)
    monkeypatch.setattr(matching, "MAX_RECORDS", 1)
    got = requests.respond(fresh, rows, "id").collect()
    assert sorted(map(str, got)) == want
    said = {r.key_id: (r.status, r.response) for r in got}
    assert said[0][0] == 200 and '"surface":"Mörkon"' in said[0][1]
    assert said[1] == (400, '{"error":"provide ?text= (GET) or {\\"text\\":\\"...\\"} (POST)"}') and said[2] == (400, '{"error":"unknown format \'a\'\\"b\' — supported: simple, solr"}')

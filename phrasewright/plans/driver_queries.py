"""The registered queries of the tagging engine, and for each the same result in DuckDB SQL."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.analyzer import key_column, output_column
from ..operators import dictionary, formats, matching
from ..operators.tagger import Tagger
from ..sources import dictionaries, requests
from ..storage import ensure_checkpoint_dir

#: (phrase, kind, id[, output]): words, licence lines, synonyms, a repeated record and one without tokens.
ENTRIES = [
    ("the", "word", "w:the"), ("of the", "word", "w:of-the"), ("The", "word", "w:the"), ("THE", "article", "a:the"), ("and", "word", "w:and", "AMP"), ("de la", "word", "w:de-la"),
    ("der", "word", "w:der"), ("die und", "word", "w:die-und"), ("los", "word", "w:los"), ("that with", "word", "w:that-with"), ("in the", "word", "w:in-the"), ("the and", "word", "w:the-and"),
    ("Licensed under the Apache License, Version 2.0", "license", "l:apache"), ("Released under the MIT License", "license", "l:mit"), ("MIT-License", "license", "l:mit-hyphen"),
    ("GNU General Public License", "license", "l:gpl"), ("General Public", "license", "l:public"), ("License, version 3", "license", "l:v3"), ("CC BY-NC 4.0", "license", "l:cc"),
    ("All rights reserved", "license", "l:reserved"), ("all rights", "word", "w:rights"), ("été", "word", "w:ete"), ("Ö", "word", "w:o"), ("日本", "word", "w:none"), ("pour", "word", "w:pour"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tagger(spark: SparkSession) -> Tagger:
    return Tagger.build(spark, ENTRIES)


def _passages(spark: SparkSession, sf_dir: str) -> Tagger:
    items = _table(spark, sf_dir, "benchmark")
    return Tagger.build(spark, items.select(F.col("text").alias("phrase"), F.lit("passage").alias("kind"), F.col("item_id").cast("string").alias("id"), F.lit("P").alias("output"), F.col("item_id").alias("ord")))


def _tags(spark, sf_dir, policy, plan=None) -> DataFrame:
    return _tagger(spark).tag(_table(spark, sf_dir, "documents"), ["doc_id"], policy=policy, plan=plan)


_SHOWN = ["`start`", "`end`", "surface", "id", "kind AS type", "output"]


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.tokens(_table(spark, sf_dir, "documents"), ["doc_id"], "text")


def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", key_column(F.col("p_name")).alias("key"), output_column(F.col("p_name")).alias("output"))


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(F.encode(key_column(F.col("text")), "utf-8")).alias("key_md5"))


def dict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagger(spark).records.select("key", "n_tokens", "kind", "id", "output", "ord")


def dict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.stats(_passages(spark, sf_dir).records)


def dict_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.kinds(_tagger(spark).records)


def tag_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir, matching.ALL).selectExpr("doc_id", *_SHOWN)


def tag_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir, matching.LONGEST).selectExpr("doc_id", *_SHOWN)


def tag_all_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir, matching.ALL, "join").selectExpr("doc_id", *_SHOWN)


def tag_longest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir, matching.LONGEST, "join").selectExpr("doc_id", *_SHOWN)


def tag_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagger(spark).tag(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"]).selectExpr("conv_id", "turn", *_SHOWN)


def tag_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).tag(_table(spark, sf_dir, "documents"), ["doc_id"], policy=matching.ALL).selectExpr("doc_id", *_SHOWN)


def tag_keyed_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key column with the name of a tag's own column."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return _tagger(spark).tag(docs, ["id"]).selectExpr("key_id", *_SHOWN)


#: Phrases of each number below the bound, ``#`` for the number.
MANY, MANY_FORMS = 50_000, ("#", "version #", "license #", "the #", "# 0")


def tag_many_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary beyond what is broadcast: the join plan by its size."""
    forms = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("form")) for k, x in enumerate(MANY_FORMS)])
    numbers = spark.range(MANY).select("id", F.inline(forms))
    entries = numbers.select(
        F.replace("form", F.lit("#"), F.col("id").cast("string")).alias("phrase"), F.col("form").alias("kind"), F.concat_ws(":", "k", "id").alias("id"), F.lit(None).cast("string").alias("output"),
        (F.col("id") * len(MANY_FORMS) + F.col("k")).alias("ord"),
    )
    return Tagger.build(spark, entries).tag(_table(spark, sf_dir, "documents"), ["doc_id"]).selectExpr("doc_id", "seq", *_SHOWN)


def _solr_docs(tags: DataFrame) -> DataFrame:
    return formats.solr_docs(tags, ["doc_id"]).select("doc_id", "id", F.array_join("name", "|").alias("name"), "type")


def solr_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solr_docs(_tags(spark, sf_dir, matching.LONGEST))


def solr_docs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solr_docs(_tags(spark, sf_dir, matching.LONGEST, "join"))


def solr_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = formats.solr_spans(_tags(spark, sf_dir, matching.LONGEST), ["doc_id"])
    return out.select("doc_id", "startOffset", "endOffset", F.array_join("ids", "|").alias("ids"))


def format_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.tsv_lines(_tags(spark, sf_dir, matching.LONGEST), ["doc_id"]).select("doc_id", "seq", "line")


def _format_simple(spark: SparkSession, sf_dir: str, plan: str | None) -> DataFrame:
    """The envelope as JSON and read again: its fields, and its tags in order."""
    docs = _table(spark, sf_dir, "documents")
    out = formats.simple(docs, _tags(spark, sf_dir, matching.LONGEST, plan), ["doc_id"])
    back = formats.as_json(out, ["doc_id"]).select("doc_id", F.from_json("json", out.schema["response"].dataType).alias("r"))
    shown = F.array_join(F.transform("r.docs", lambda t: F.concat_ws(":", t["start"], t["end"], t["id"], t["type"], t["output"])), "|")
    return back.select("doc_id", "r.totaltime", F.md5(F.encode("r.text", "utf-8")).alias("text_md5"), F.size("r.docs").cast("long").alias("n_docs"), shown.alias("docs"))


def format_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _format_simple(spark, sf_dir, None)


def format_simple_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _format_simple(spark, sf_dir, "join")


def format_solr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = formats.solr(docs, _tags(spark, sf_dir, matching.LONGEST), ["doc_id"])
    back = formats.as_json(out, ["doc_id"]).select("doc_id", F.from_json("json", out.schema["response"].dataType).alias("r"))
    ids = F.array_join(F.transform("r.response.docs", lambda d: d["id"]), "|")
    spans = F.array_join(F.transform("r.tags", lambda t: F.concat_ws(":", t["startOffset"], t["endOffset"], F.array_join(t["ids"], "+"))), "|")
    return back.select("doc_id", "r.response.numFound", F.col("r.response.start").alias("start"), ids.alias("doc_ids"), spans.alias("tags"))


def url_decode_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", scalars.url_decode_column(F.col("url")).alias("url"))


def query_param_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("format=simple&text=a+b%20"), F.col("page_id").cast("string"), F.lit("&text=no"))
    return _table(spark, sf_dir, "pages").select("page_id", scalars.query_param_column(asked, "text").alias("text"), scalars.query_param_column(asked, "missing").alias("missing"))


def json_escape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(F.encode(scalars.json_escape_column(F.col("html")), "utf-8")).alias("escaped_md5"))


def json_field_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("event_type").alias("text"), F.lit("solr").alias("format")))
    return _table(spark, sf_dir, "events").select("event_id", scalars.json_string_field(body, "text").alias("text"), scalars.json_string_field(body, "other").alias("other"))


def _nth(number: Column, cases: list[str | None]) -> Column:
    return F.element_at(F.array(*[F.lit(c).cast("string") for c in cases]), (number % len(cases) + 1).cast("int"))


#: Strings and what they decode to.
DECODED = [
    ("a+b%20c", "a b c"), ("%C3%BC", "ü"), ("100%", "100%"), ("%zz%4", "%zz%4"), ("%+4york", "\x04york"), ("%2B%2b", "++"), ("%%41", "%A"), ("%2+1", "%2 1"), ("", ""), ("%FF", "\ufffd"), ("%e6%97%a5", "日"), ("%+", "% "),
]


def url_decode_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _nth(F.col("page_id"), [c for c, _ in DECODED])
    return _table(spark, sf_dir, "pages").select("page_id", scalars.url_decode_column(F.concat(coded, F.lit("%20"), F.col("page_id").cast("string"))).alias("decoded"))


#: JSON texts and their top-level string ``text``.
FIELDS = [
    ('{"text": "a"}', "a"), ('{"text": 5}', None), ('{"text": {"text": "in"}}', None), ('{"a": {"text": "in"}}', None), ('{"text": null}', None), ("not json", None), ('{"text": "\\u00fc\\n\\"q\\""}', 'ü\n"q"'),
    ('{"text": ["a"]}', None), ('{"text": true}', None), ("", None), ('{"b": 1, "text": "日本"}', "日本"), ('["text"]', None), ('{"text": ""}', ""),
]


def json_field_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", scalars.json_string_field(_nth(F.col("page_id"), [c for c, _ in FIELDS]), "text").alias("text"))


def json_escape_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with control characters put in."""
    code = (F.col("page_id") % 32).cast("int")
    raw = F.concat(F.expr("chr(page_id % 31 + 1)"), F.substring("html", 1, 40), F.lit('\\"\t'), F.expr("chr(page_id % 7 + 1)"))
    return _table(spark, sf_dir, "pages").select("page_id", code.alias("code"), scalars.json_escape_column(raw).alias("escaped"))


#: Texts and whether they are blank.
BLANKS = [("", True), (" ", True), ("\t\n", True), ("\u00a0", True), ("\u3000 \u2003", True), ("x", False), (" x ", False), ("\u200b", False), (None, True), ("\x00", False), ("\x85\x0b", True), ("\x1f", False), ("\u180e", False)]


def blank_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", scalars.blank(_nth(F.col("page_id"), [c for c, _ in BLANKS])).alias("blank"))


#: Requests (method, url, body; ``~`` stands for the id) and their status, format, text and answer.
_UNKNOWN = '{"error":"unknown format \'%s\' — supported: simple, solr"}'
REQUESTS = [
    ("GET", "/tag?text=in+%23~", None, None, "simple", "in #~", None), ("GET", "/tag?format=SOLR&text=a%26b", None, None, "solr", "a&b", None), ("GET", "/tag?text=%09%0A", None, 400, "simple", "\t\n", SAID_TEXT := '{"error":"provide ?text= (GET) or {\\"text\\":\\"...\\"} (POST)"}'),
    ("GET", "/tag?text=x&format=", None, 400, "", "x", _UNKNOWN % ""), ("GET", "/tag?text=x&format=Xml%22", None, 400, 'xml"', "x", _UNKNOWN % 'xml\\"'), ("POST", "/tag", '{"text": "t ~", "format": "Solr"}', None, "solr", "t ~", None),
    ("POST", "/tag?format=simple", '{"text": "q", "format": "solr"}', None, "simple", "q", None), ("POST", "/tag", '{"text": 5}', 400, "simple", None, SAID_TEXT), ("POST", "/tag", "{", 400, "simple", None, SAID_TEXT), ("PUT", "/tag", None, 405, "simple", None, '{"error":"method not allowed"}'),
    ("GET", "/nothing?text=a", None, 404, "simple", "a", '{"error":"not found"}'), ("GET", "/health", None, 200, "simple", None, '{"status":"ok"}'), ("POST", "/health", None, 405, "simple", None, '{"error":"method not allowed"}'), ("GET", "/tag", None, 400, "simple", None, SAID_TEXT),
]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.replace(_nth(F.col("page_id"), [r[k] for r in REQUESTS]), F.lit("~"), F.col("page_id").cast("string"))
    return _table(spark, sf_dir, "pages").select("page_id", of(0).alias("method"), of(1).alias("url"), of(2).alias("body"))


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.parse(_requests(spark, sf_dir)).select("page_id", "status", "format", "text", "said")


def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every request, and what its answer tags."""
    tagger = Tagger.build(spark, [("t", "K", "1"), ("a", "K", "2"), ("b", "L", "3"), ("in", "L", "4")])
    out = requests.respond(tagger, _requests(spark, sf_dir), "page_id")
    ids = F.coalesce(F.get_json_object("response", "$.docs[*].id"), F.get_json_object("response", "$.response.docs[*].id"))
    return out.select("page_id", "status", F.regexp_replace(ids, r'[\[\]"]', "").alias("ids"))


TSV = "# a comment\n\nred door\t r1 \r\n blue door \n\tonly\t9\ngrün\t\nred door\tr1\ttail\n"
CSVS = {"Colours.CSV": 'name, Action ,more\r\n"Red, dark",RED,x\nblue,,\n,skipped,\n""green,GO\n', "b.csv": "phrase\nblue\n", "empty.csv": "", "notes.txt": "phrase\nno\n"}


def _sample_folder(spark: SparkSession) -> str:
    """The sample files in a folder of the session's shared store."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/samples-{uuid.uuid4()}"
    for name, text in {"doors.tsv": TSV, **{f"data/{n}": t for n, t in CSVS.items()}}.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
    return folder


def entries_from_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionaries.from_tsv_file(spark, f"{_sample_folder(spark)}/doors.tsv")


def entries_from_csvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionaries.from_data_dir(spark, f"{_sample_folder(spark)}/data", stable_ids=True)


def records_from_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary that DATA names; random ids are shown by their shape."""
    had = os.environ.get("DATA")
    os.environ["DATA"] = f"{_sample_folder(spark)}/data"
    try:
        records = Tagger.from_env(spark).records
    finally:
        os.environ.pop("DATA")
        if had is not None:
            os.environ["DATA"] = had
    shape = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return records.select(F.replace("key", F.lit("\x1e"), F.lit(" ")).alias("key"), "kind", "output", shape.alias("uuid"))


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command prints for a text in its arguments, and for one on its standard input."""
    from ..__main__ import main

    path = f"{_sample_folder(spark)}/doors.tsv"
    had, rows = os.environ.pop("DATA", None), []
    try:
        for n, (args, stdin) in enumerate((([path, "the", "RED-", "door", "Grün"], ""), ([path], "Only\nblue  door"))):
            out = io.StringIO()
            main(args, stdin=io.StringIO(stdin), stdout=out, stderr=io.StringIO())
            rows += [(n, i, x) for i, x in enumerate(out.getvalue().splitlines())]
    finally:
        if had is not None:
            os.environ["DATA"] = had
    return spark.createDataFrame(rows, "run int, n int, line string")


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made of parts' names, with quotes at the start, inside and unclosed."""
    name = F.replace("p_name", F.lit('"'), F.lit(""))
    line = F.concat(F.lit('"'), name, F.lit(', ""x""",'), name, F.lit(',,"'), name, F.lit('"y,a"b,""z,"open, '), name)
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalars.split_csv_column(line), "|").alias("cells"))


def stems_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/v1.2/"), F.col("p_partkey").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".csv", ".x.CSV", "", ".")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    return _table(spark, sf_dir, "part").select("p_partkey", scalars.file_stem_column(path).alias("stem"), scalars.stable_id_column(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"))


def dict_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = {"none": [], "no token": [("日本", "K", "1"), ("--", "K", "2")], "some": ENTRIES}
    return spark.createDataFrame([(name, (t := Tagger.build(spark, e)).is_empty(), len(t), t.record_count()) for name, e in cases.items()], "name string, empty boolean, n_keys long, n_records long")


def tags_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and texts by language and kind, with totals."""
    tags = _tagger(spark).tag(_table(spark, sf_dir, "documents"), ["doc_id", "lang"])
    return tags.rollup("lang", "kind").agg(F.count(F.lit(1)).alias("n_tags"), F.countDistinct("doc_id").alias("n_docs"))


def documents_without_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").join(_tags(spark, sf_dir, matching.LONGEST).select("doc_id"), "doc_id", "left_anti").select("doc_id")


def top_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten ids with the most tags."""
    return _tags(spark, sf_dir, matching.LONGEST).groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(10)


_QUERIES = [
    tokenize_documents, normalize_keys, normalize_documents, dict_records, dict_stats, dict_kinds, tag_all, tag_longest, tag_all_join, tag_longest_join, tag_conversations,
    tag_benchmark_passages, solr_docs, solr_spans, format_tsv, format_simple, format_solr, url_decode_pages, query_param_pages, json_escape_pages, json_field_events,
    tags_by_lang, documents_without_tag, top_phrases, tag_keyed_by_id, tag_many_records, solr_docs_join, format_simple_join, url_decode_cases, json_field_cases, json_escape_controls, blank_cases,
    request_checks, request_answers, entries_from_tsv, entries_from_csvs, records_from_env, command_line, csv_cells, stems_and_ids, dict_is_empty,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The analyzer's rules once more, for SQL alone: fixed values, written out.
_DASHES = "-\u2010\u2011\u2012\u2013\u2014\u2212"
_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝÐàáâãäåçèéêëìíîïñòóôõöøùúûüýÿð"
_INTO = "aaaaaaceeeeiiiinoooooouuuuydaaaaaaceeeeiiiinoooooouuuuyyd"
_TWO = {"Æ": "ae", "æ": "ae", "Œ": "oe", "œ": "oe", "Þ": "th", "þ": "th", "ß": "ss"}
_LETTER = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0152\u0153]"
_RE = f"'{_LETTER}(?:(?:{_LETTER}|[\u2010-\u2014\u2212-])*{_LETTER})?'"


def _fold(x: str) -> str:
    for c, f in _TWO.items():
        x = f"replace({x}, '{c}', '{f}')"
    return f"lower(translate({x}, {_lit(_FROM + _DASHES)}, '{_INTO}'))"


def _key(x: str, between: str = "chr(30)") -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, {_RE}), lambda t : {_fold('t')}), {between})"


def _spans(table: str, keys: str) -> str:
    """CTEs toks(keys, i, tok, s, e) and lists(keys, tk)."""
    part = f"PARTITION BY {keys} ORDER BY i"
    return f"""raws AS (SELECT {keys}, regexp_extract_all(text, {_RE}) AS tk, string_split_regex(text, {_RE}) AS gp FROM {table}),
each_ AS (SELECT {keys}, unnest(tk) AS raw, unnest(gp[1:len(tk)]) AS gap, unnest(range(len(tk))) AS i FROM raws),
toks AS (SELECT {keys}, i::INT AS i, {_fold('raw')} AS tok, (sum(strlen(gap) + strlen(raw)) OVER ({part}) - strlen(raw))::BIGINT AS s,
 (sum(strlen(gap) + strlen(raw)) OVER ({part}))::BIGINT AS e FROM each_),
lists AS (SELECT {keys}, list_transform(tk, lambda t : {_fold('t')}) AS tk FROM raws)"""


def _records(entries: str) -> str:
    """CTE recs(key, n, kind, id, output, ord) from entries(phrase, kind, id, output, ord)."""
    return f"""keyed AS (SELECT {_key('phrase')} AS key, kind, id, coalesce(output, upper({_key('phrase', "''")})) AS output, ord FROM ({entries})),
recs AS (SELECT key, len(string_split(key, chr(30)))::INT AS n, kind, id, output, min(ord)::BIGINT AS ord FROM keyed WHERE key <> '' GROUP BY ALL)"""


def _entries() -> str:
    row = lambda i, e: f"({_lit(e[0])}, {_lit(e[1])}, {_lit(e[2])}, {_lit(e[3]) if len(e) > 3 else 'NULL'}, {i})"
    return f"SELECT * FROM (VALUES {', '.join(row(i, e) for i, e in enumerate(ENTRIES))}) t(phrase, kind, id, output, ord)"


_PASSAGES = "SELECT text AS phrase, 'passage' AS kind, item_id::VARCHAR AS id, 'P' AS output, item_id AS ord FROM benchmark"


def _hits(table: str, keys: str, entries: str, longest: bool, extra: str = "") -> str:
    """CTEs up to tags(keys, i, n, start, end, surface, id, kind, output, ord)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    of = lambda t: ", ".join(f"{t}.{k.strip()}" for k in keys.split(","))
    sql = f"""WITH RECURSIVE {_records(entries)},
{_spans(table, keys)},
dkeys AS (SELECT DISTINCT key, n, string_split(key, chr(30)) AS parts FROM recs),
pairs AS (SELECT *, lead(tok) OVER (PARTITION BY {keys} ORDER BY i) AS nxt FROM toks),
cands AS (SELECT {of('a')}, a.i, d.key, d.n, d.parts FROM pairs a JOIN dkeys d ON a.tok = d.parts[1] AND (d.n = 1 OR a.nxt = d.parts[2])),
hits AS (SELECT {keys}, i, key, n FROM cands WHERE n <= 2 UNION ALL
 SELECT {of('a')}, a.i, a.key, a.n FROM cands a JOIN lists b ON {on} WHERE a.n > 2 AND b.tk[a.i + 1 : a.i + a.n] = a.parts)"""
    if longest:
        sql += f""",
most AS (SELECT {keys}, i, max(n) AS n FROM hits GROUP BY ALL),
kept AS (SELECT {keys}, min(i) AS i, arg_min(n, i) AS n FROM most GROUP BY {keys} UNION ALL
 SELECT {of('a')}, min(b.i) AS i, arg_min(b.n, b.i) AS n FROM kept a JOIN most b ON {on} AND b.i >= a.i + a.n GROUP BY {of('a')}, a.i, a.n),
chosen AS (SELECT a.* FROM hits a JOIN kept b ON {on} AND a.i = b.i AND a.n = b.n)"""
    else:
        sql += ",\nchosen AS (SELECT * FROM hits)"
    first = " AND ".join(f"a.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    last = " AND ".join(f"a.{k.strip()} = l.{k.strip()}" for k in keys.split(","))
    back = " AND ".join(f"a.{k.strip()} = x.{k.strip()}" for k in keys.split(","))
    return sql + f""",
tags AS (SELECT {of('a')}, a.i, a.n, f.s AS "start", l.e AS "end", decode(encode(x.text)[f.s + 1 : l.e]) AS surface, r.id, r.kind, r.output, r.ord
 FROM chosen a JOIN toks f ON {first} AND f.i = a.i JOIN toks l ON {last} AND l.i = a.i + a.n - 1 JOIN {table} x ON {back} JOIN recs r ON r.key = a.key){extra}
"""


_SEQ = ', seqs AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY i, n, ord) - 1)::INT AS seq FROM tags)'


_MANY = (
    f"SELECT replace(f.form, '#', i::VARCHAR) AS phrase, f.form AS kind, f.k || ':' || i AS id, NULL::VARCHAR AS output, i * {len(MANY_FORMS)} + f.k AS ord"
    f" FROM range({MANY}) r(i), (VALUES {', '.join(f'({k}, {_lit(x)})' for k, x in enumerate(MANY_FORMS))}) f(k, form)"
)


def _case(values: list, cast: str = "VARCHAR") -> str:
    """The value of page_id modulo the number of values; ``~`` in a string stands for the id."""
    shown = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else f"replace({_lit(v)}, '~', page_id::VARCHAR)"
    return f"(CASE {' '.join(f'WHEN page_id % {len(values)} = {k} THEN {shown(v)}' for k, v in enumerate(values))} END)::{cast}"


def _values(columns: str, rows: list[tuple]) -> str:
    shown = lambda v: "NULL" if v is None else _lit(v) if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({columns})"


def _stable_id(kind: str, key: str) -> str:
    h = f"md5({kind} || chr(30) || {key})"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def _source_sql() -> dict[str, str]:
    """Sources, requests and scalar functions: what they must give, written out by hand."""
    asked = [(*r[3:6], r[6]) for r in REQUESTS]
    control = "replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"
    control = f"replace(replace({control}, chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
    for code in [*range(1, 9), 11, 12, *range(14, 32)]:
        control = f"replace({control}, chr({code}), chr(92) || 'u{code:04x}')"
    raw = "chr((page_id % 31 + 1)::INT) || substr(html, 1, 40) || chr(92) || chr(34) || chr(9) || chr((page_id % 7 + 1)::INT)"
    csvs = [("blue", "b", None, 0), ("Red, dark", "Colours", "RED", 1), ("blue", "Colours", None, 2), ("green", "Colours", "GO", 3)]
    name = "replace(p_name, chr(34), '')"
    return {
        "url_decode_cases": f"SELECT page_id, {_case([d for _, d in DECODED])} || ' ' || page_id AS decoded FROM pages",
        "json_field_cases": f"SELECT page_id, {_case([d for _, d in FIELDS])} AS text FROM pages",
        "json_escape_controls": f"SELECT page_id, (page_id % 32)::INT AS code, {control.format(x=raw)} AS escaped FROM pages",
        "blank_cases": f"SELECT page_id, {_case([d for _, d in BLANKS], 'BOOLEAN')} AS blank FROM pages",
        "request_checks": "SELECT page_id, " + ", ".join(f"{_case([r[k] for r in asked], kind)} AS {name}" for k, (name, kind) in enumerate((("status", "INT"), ("format", "VARCHAR"), ("text", "VARCHAR"), ("said", "VARCHAR")))) + " FROM pages",
        "request_answers": f"SELECT page_id, coalesce({_case([r[0] for r in asked], 'INT')}, 200) AS status, {_case(['4', '2,3', None, None, None, '1', None, None, None, None, None, None, None, None])} AS ids FROM pages",
        "entries_from_tsv": _values("phrase, kind, id, output, ord", [("red door", "doors", "r1", None, 0), ("blue door", "doors", "4", None, 1), ("only", "doors", "9", None, 2), ("grün", "doors", "6", None, 3), ("red door", "doors", "r1\ttail", None, 4)]).replace("SELECT *", "SELECT phrase, kind, id, output::VARCHAR AS output, ord::BIGINT AS ord"),
        "entries_from_csvs": f"SELECT phrase, kind, {_stable_id('kind', 'ord::VARCHAR')} AS id, output, ord::BIGINT AS ord FROM ({_values('phrase, kind, output, ord', csvs)})",
        "records_from_env": _values("key, kind, output, uuid", [("red dark", "Colours", "RED", True), ("blue", "Colours", "BLUE", True), ("green", "Colours", "GO", True), ("blue", "b", "BLUE", True)]),
        "command_line": _values("run, n, line", [(0, 0, "4\t13\tdoors\tr1\tREDDOOR\tRED- door"), (0, 1, "4\t13\tdoors\tr1\ttail\tREDDOOR\tRED- door"), (0, 2, "14\t19\tdoors\t6\tGRUN\tGrün"), (1, 0, "0\t4\tdoors\t9\tONLY\tOnly"), (1, 1, "5\t15\tdoors\t4\tBLUEDOOR\tblue  door")]),
        "csv_cells": f"SELECT p_partkey, {name} || ', ' || chr(34) || 'x' || chr(34) || '|' || {name} || '||' || {name} || 'y|a' || chr(34) || 'b|z|open, ' || {name} AS cells FROM part",
        "stems_and_ids": f"SELECT p_partkey, p_partkey || CASE p_partkey % 4 WHEN 1 THEN '.x' ELSE '' END AS stem, {_stable_id(_lit('part'), 'p_partkey::VARCHAR')} AS id FROM part",
        "dict_is_empty": "SELECT name, empty, n_keys::BIGINT AS n_keys, n_records::BIGINT AS n_records FROM (" + _values("name, empty, n_keys, n_records", [("none", True, 0, 0), ("no token", True, 0, 0), ("some", False, 22, 23)]) + ")",
    }


def oracle_sql() -> dict[str, str]:
    shown = 'SELECT doc_id, "start", "end", surface, id, kind AS type, output FROM tags'
    every, longest = _hits("documents", "doc_id", _entries(), False), _hits("documents", "doc_id", _entries(), True)
    ordered = _hits("documents", "doc_id", _entries(), True, _SEQ)
    escaped = "html"
    for raw, name in (("chr(92)", "chr(92) || chr(92)"), ("chr(34)", "chr(92) || chr(34)"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'")):
        escaped = f"replace({escaped}, {raw}, {name})"
    docs = "docs_ AS (SELECT doc_id, id, min(seq) AS first, arg_min(kind, seq) AS type FROM seqs GROUP BY doc_id, id)"
    names = "names AS (SELECT doc_id, id, surface, min(seq) AS at_ FROM seqs GROUP BY ALL)"
    spans = "ids_ AS (SELECT doc_id, \"start\", \"end\", id, min(seq) AS at_ FROM seqs GROUP BY ALL), spans AS (SELECT doc_id, \"start\", \"end\", string_agg(id, '{}' ORDER BY at_) AS ids FROM ids_ GROUP BY ALL)"
    found = {
        "tokenize_documents": f'WITH {_spans("documents", "doc_id")} SELECT doc_id, i, tok, s AS "start", e AS "end" FROM toks',
        "normalize_keys": f"SELECT p_partkey, {_key('p_name')} AS key, upper({_key('p_name', chr(39) * 2)}) AS output FROM part",
        "normalize_documents": f"SELECT doc_id, md5({_key('text')}) AS key_md5 FROM documents",
        "dict_records": f"WITH {_records(_entries())} SELECT key, n AS n_tokens, kind, id, output, ord FROM recs",
        "dict_stats": f"WITH {_records(_PASSAGES)} SELECT count(DISTINCT key) AS n_keys, count(*) AS n_records, count(DISTINCT kind) AS n_kinds, max(n)::BIGINT AS longest FROM recs",
        "dict_kinds": f"WITH {_records(_entries())} SELECT DISTINCT kind FROM recs",
        "tag_all": every + shown,
        "tag_longest": longest + shown,
        "tag_all_join": every + shown,
        "tag_longest_join": longest + shown,
        "tag_conversations": _hits("conversations", "conv_id, turn", _entries(), True) + 'SELECT conv_id, turn, "start", "end", surface, id, kind AS type, output FROM tags',
        "tag_benchmark_passages": _hits("documents", "doc_id", _PASSAGES, False) + shown,
        **_source_sql(),
        "tag_keyed_by_id": longest + 'SELECT doc_id AS key_id, "start", "end", surface, id, kind AS type, output FROM tags',
        "tag_many_records": _hits("documents", "doc_id", _MANY, True, _SEQ) + 'SELECT doc_id, seq, "start", "end", surface, id, kind AS type, output FROM seqs',
        "solr_docs": ordered + f", {docs}, {names} SELECT d.doc_id, d.id, string_agg(n.surface, '|' ORDER BY n.at_) AS name, d.type FROM docs_ d JOIN names n ON d.doc_id = n.doc_id AND d.id = n.id GROUP BY d.doc_id, d.id, d.type",
        "solr_spans": ordered + f', {spans.format("|")} SELECT doc_id, "start" AS "startOffset", "end" AS "endOffset", ids FROM spans',
        "format_tsv": ordered + """SELECT doc_id, seq, concat_ws(chr(9), "start", "end", kind, id, output, surface) AS line FROM seqs""",
        "format_simple": ordered + """, joined AS (SELECT doc_id, count(*) AS n, string_agg(concat_ws(':', "start", "end", id, kind, output), '|' ORDER BY seq) AS docs FROM seqs GROUP BY doc_id)
SELECT d.doc_id, 0::BIGINT AS totaltime, md5(d.text) AS text_md5, coalesce(n, 0)::BIGINT AS n_docs, coalesce(docs, '') AS docs FROM documents d LEFT JOIN joined USING (doc_id)""",
        "format_solr": ordered + f""", {docs}, {spans.format("+")}, a AS (SELECT doc_id, count(*) AS n, string_agg(id, '|' ORDER BY first) AS doc_ids FROM docs_ GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(concat_ws(':', "start", "end", ids), '|' ORDER BY "start", "end") AS tags FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS numFound, 0::BIGINT AS "start", coalesce(doc_ids, '') AS doc_ids, coalesce(tags, '') AS tags FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""",
        "url_decode_pages": "SELECT page_id, url_decode(replace(url, '+', ' ')) AS url FROM pages",
        "query_param_pages": "SELECT page_id, 'a b ' || page_id AS text, NULL::VARCHAR AS missing FROM pages",
        "json_escape_pages": f"SELECT page_id, md5({escaped}) AS escaped_md5 FROM pages",
        "json_field_events": "SELECT event_id, event_type AS text, NULL::VARCHAR AS other FROM events",
        "tags_by_lang": longest + "SELECT lang, kind, count(*) AS n_tags, count(DISTINCT doc_id) AS n_docs FROM tags JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, kind)",
        "documents_without_tag": longest + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tags)",
        "top_phrases": longest + "SELECT id, count(*) AS n FROM tags GROUP BY id ORDER BY n DESC, id LIMIT 10",
    }
    return found | {"solr_docs_join": found["solr_docs"], "format_simple_join": found["format_simple"]}

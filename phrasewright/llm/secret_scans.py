"""Secret scans with multipart credential linking.

Strong spans stand alone: assignments of a password, token or key, access key ids and long runs
of hexadecimal digits. Weak candidates are parts of a credential that say little alone: a login
name, a run of characters that looks random, an endpoint. They are reported only where
complementary parts stand within one scope of the same text:

* a login with a secret (assign, hex, or a random-looking run),
* a random-looking run with an identifier (access key id or login),
* an endpoint with both an identifier and a secret.

A random-looking run inside a strong span isn't a part of its own. The scope of a part is its span
and ``SCOPE`` code points on either side.

Everything runs as DataFrame expressions. The scan of the whole texts yields only lengths of
matches and of the gaps between them; offsets are running sums over these, and texts are never
shuffled. Links are an interval join on (row, bin).

Cases: a null text is an empty one; texts without secrets get empty results; repeated rows each
get their own row; null doc_ids stay; other columns are ignored (and kept by ``redact``).
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, documents, text_of
from ._spans import near


def _any_case(*words: str) -> str:
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w).replace("_", "_?") for w in words)


_IS = r"""["']?\x20*[:=]\x20*["']?"""

#: Kinds in the order of the result; the first three are strong.
PATTERNS = {
    "assign": f"({_any_case('password', 'passwd', 'secret', 'token', 'api_key')}){_IS}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",  # the same spans as [0-9a-f]+ of 24 and more: a run is matched whole
    "login": f"({_any_case('username', 'user', 'login', 'account', 'client_id', 'account_id')}){_IS}([A-Za-z0-9@._-]+)",
    "random": "[A-Za-z0-9+/_-]{16,}",
    "endpoint": r"https?://[A-Za-z0-9.-]+(:[0-9]+)?(/[A-Za-z0-9._~/?&=%+-]*)?",
}
KINDS = tuple(PATTERNS)
BASE = KINDS[:3]
SCOPE = 200
#: What a scan must find before anything else is looked for: a weak part counts only beside these.
ANCHORS = ("assign", "access", "hex", "login")


def _valid(kind: str, match: Column) -> Column:
    """Whether a match of the pattern counts."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, PATTERNS[kind], 2)) >= 6
    if kind == "access":
        return F.length(match) >= 20
    if kind == "login":
        return F.length(F.regexp_extract(match, PATTERNS[kind], 2)) >= 3
    if kind == "random":
        return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
    return F.lit(True)


def _scan(text: Column, kind: str) -> Column:
    """Matches in order: length of the text before each, its own length, whether it counts."""
    pattern = PATTERNS[kind]
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern),
        lambda m, gap: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(0).alias("i"), F.length(gap).alias("gap"), F.length(m).alias("len"), _valid(kind, m).alias("ok")),
    )
    found = F.filter(found, lambda x: x["len"].isNotNull())
    numbered = F.transform(found, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok")))
    return F.when(text.rlike(pattern), numbered.cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")).otherwise(none)


def anchored(text: Column) -> Column:
    """Whether a text has a match of a strong kind or a login; without one nothing can be reported."""
    return text.rlike("|".join(PATTERNS[k] for k in ANCHORS))


def candidates(text: Column) -> Column:
    """All matches of a text as an array; weak kinds are looked for only beside an anchor."""
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(anchored(text), F.concat(*[_scan(text, k) for k in KINDS])).otherwise(none)


def _placed(scanned: DataFrame) -> DataFrame:
    """rid, kind, start, end of the matches that count."""
    each = scanned.select("rid", F.explode("found").alias("x")).select("rid", "x.*")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    return each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("len")).where("ok").select("rid", "kind", "start", "end")


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong spans, and the weak ones with complementary parts in scope: rid, kind, start, end."""
    k = {name: F.lit(i) for i, name in enumerate(KINDS)}
    strong = F.col("kind") < len(BASE)
    other = parts.select(*[F.col(c).alias(f"q_{c}") for c in parts.columns])
    weak = parts.where(~strong)
    # a random-looking run that overlaps a strong span is that span, and no further part
    inside = near(weak.where(F.col("kind") == k["random"]), other.where(F.col("q_kind") < len(BASE)), 0, scope, "left_semi")
    crossed = near(
        other.where(F.col("q_kind") < len(BASE)).select(F.col("q_rid").alias("rid"), F.col("q_start").alias("start")),
        weak.where(F.col("kind") == k["random"]).select(*[F.col(c).alias(f"q_{c}") for c in parts.columns]), 0, scope,
    ).where(F.col("start") < F.col("q_end")).select(F.col("q_rid").alias("rid"), F.col("q_kind").alias("kind"), F.col("q_start").alias("start"), F.col("q_end").alias("end"))
    weak = cut(weak.join(inside.unionByName(crossed).distinct(), ["rid", "kind", "start", "end"], "left_anti"))
    others = other.where(F.col("q_kind") < len(BASE)).unionByName(weak.select(*[F.col(c).alias(f"q_{c}") for c in weak.columns]))
    names = lambda *of: F.col("q_kind").isin(*[KINDS.index(x) for x in of])
    apart = (F.col("kind") != F.col("q_kind")) | (F.col("start") != F.col("q_start"))
    met = near(weak, others, scope, scope, on=apart).groupBy("rid", "kind", "start", "end").agg(
        F.max(names("access", "login")).alias("identifier"), F.max(names("assign", "hex", "random")).alias("secret")
    )
    whole = F.when(F.col("kind") == k["login"], F.col("secret")).when(F.col("kind") == k["random"], F.col("identifier")).otherwise(F.col("identifier") & F.col("secret"))
    return parts.where(strong).unionByName(met.where(whole).select("rid", "kind", "start", "end"))


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and spans, an array of (start, kind, end) in order, for every row of ``docs``."""
    scanned = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", candidates(text_of()).alias("found"))
    scanned = cut(scanned)
    spans = link(cut(_placed(scanned)), scope).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scanned.select("rid", "doc_id").join(spans, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span replaced by ``[REDACTED]`` (overlapping spans by one); n_chars follows.

    Only texts with an anchor leave the scan; all others pass as they are.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    clean = docs.where(~anchored(text_of()))
    hit = docs.where(anchored(text_of())).select(row, text_of().alias("text"), candidates(text_of()).alias("found"))
    hit = cut(hit.withColumn("rid", F.monotonically_increasing_id()))
    spans = link(cut(_placed(hit)), scope)
    past = Window.partitionBy("rid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.coalesce(F.max("end").over(past), F.lit(0).cast("long")))
    spans = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "from"))).alias("spans"), F.max("end").alias("last"))
    cutout = lambda p: F.when(p["start"] >= p["from"], F.concat(F.substring(F.col("text"), p["from"] + 1, p["start"] - p["from"]), F.lit("[REDACTED]"))).otherwise("")
    spans = hit.select("rid", "row", "text").join(spans, "rid", "left")
    bare = F.concat(F.array_join(F.transform("spans", cutout), ""), F.substring(F.col("text"), (F.col("last") + 1).cast("int"), F.length("text")))
    fixed = spans.select("row", F.when(F.col("last").isNull(), F.col("row.text")).otherwise(bare).alias("bare"))
    value = {"text": F.col("bare"), "n_chars": F.length("bare").cast(dict(docs.dtypes).get("n_chars", "long"))}
    touched = fixed.select(*[value[c].alias(c) if c in value else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return clean.unionByName(touched)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return find(documents(spark, sf_dir)).select("doc_id", *[n(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))

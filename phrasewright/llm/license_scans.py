"""License scans by ordered signature rules.

A keyword prefilter picks the texts, and in them the places, that any rule can match: each rule
(``license_rules``) names the keyword it contains. Around each keyword the words on both sides form
a context as long as the longest rule; contexts meet the rules of their keyword (a constant table of
some hundred rows) and a regex decides. Overlapping detections are resolved by priority and
containment: a detection inside another of higher priority, or inside a longer one of the same
priority, is suppressed. Base phrases are reported wherever their words stand.

Everything runs as DataFrame expressions; whole texts are read once and never shuffled, what
leaves the scan are contexts. Containment is an interval join on (row, bin).

Cases: a null text is an empty one; texts without words or licences get empty labels and score
0; repeated rows get a row each; null doc_ids stay; other columns are ignored. Word positions
count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, documents, text_of
from .license_rules import rules

#: Words of context on either side of a keyword; no rule is longer.
REACH = 24
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words with one space between and around them; case as it was."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _SEPARATORS, " ")), F.lit(" "))


def n_words(spaced_text: Column) -> Column:
    return F.when(F.length(spaced_text) <= 2, F.lit(0)).otherwise(F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit(""))) - 1).cast("long")


def keywords() -> list[str]:
    return sorted({r.keyword for r in rules()})


def contexts(words: Column, picked: list[str]) -> Column:
    """(i, kw, around) for each keyword of a word array; ``@`` marks it in ``around``."""
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*picked), i)), lambda i: i.isNotNull())
    left = lambda i: F.array_join(F.slice(words, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))), " ")
    right = lambda i: F.array_join(F.slice(words, i + 2, F.lit(REACH)), " ")
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("i"), F.get(words, i).alias("kw"), F.concat(F.lit(" "), left(i), F.lit(" @"), F.get(words, i), F.lit(" "), right(i), F.lit(" ")).alias("around")))


def rule_table(spark: SparkSession) -> DataFrame:
    schema = "order int, label string, keyword string, also string, pattern string, priority int, score double, base boolean"
    return spark.createDataFrame([tuple(r) for r in rules()], schema)


def detect(scanned: DataFrame) -> DataFrame:
    """rid, start, end (words, exclusive), and the rule's columns, for every match."""
    each = scanned.where(F.size("found") > 0).select("rid", F.explode("found").alias("x")).select("rid", "x.*")
    table = F.broadcast(rule_table(scanned.sparkSession))  # a constant of the code, some hundred rows
    hit = (F.col("kw") == F.col("keyword")) & ((F.col("also") == "") | F.contains(F.col("around"), F.concat(F.lit(" "), F.col("also"), F.lit(" "))) | F.contains(F.col("around"), F.concat(F.lit("@"), F.col("also"), F.lit(" "))))
    met = each.join(table, hit).withColumn("m", F.expr("regexp_extract(around, concat('(?<= )(', pattern, ')(?= )'), 1)"))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    start = F.col("i") - spaces(F.substring_index("m", "@", 1))
    met = met.where("m != ''").withColumn("start", start).withColumn("end", F.col("start") + spaces(F.col("m")) + 1)
    return met.select("rid", "start", "end", "order", "label", "priority", "score", "base").distinct()


def suppress(found: DataFrame, width: int = 64) -> DataFrame:
    """Without the detections that a stronger one contains; base ones stay."""
    over = found.select(*[F.col(c).alias(f"q_{c}") for c in ("rid", "start", "end", "order", "priority")])
    over = over.withColumn("q_bin", F.explode(F.sequence(F.floor(F.col("q_start") / width), F.floor(F.col("q_end") / width))))
    length, other = F.col("end") - F.col("start"), F.col("q_end") - F.col("q_start")
    stronger = (F.col("q_priority") > F.col("priority")) | ((F.col("q_priority") == F.col("priority")) & ((other > length) | ((other == length) & (F.col("q_order") < F.col("order")))))
    inside = (F.col("rid") == F.col("q_rid")) & (F.col("_bin") == F.col("q_bin")) & (F.col("q_start") <= F.col("start")) & (F.col("q_end") >= F.col("end"))
    weak = found.where(~F.col("base")).withColumn("_bin", F.floor(F.col("start") / width))
    return found.where("base").unionByName(weak.join(over, inside & stronger, "left_anti").drop("_bin"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and detections (start, end, label, priority, score, base), one row for each of ``docs``."""
    picked = keywords()
    # no word can be a keyword in lower case unless it is one in some case
    gate = F.col("spaced").rlike("(?i) (?:" + "|".join(picked) + ") ")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", spaced(text_of()).alias("spaced"))
    rows = rows.select("rid", "doc_id", n_words(F.col("spaced")).alias("n_words"), F.when(gate, F.split(F.trim(ascii_lower(F.col("spaced"))), " ")).alias("words"))
    none = F.array().cast("array<struct<i:bigint,kw:string,around:string>>")
    scanned = cut(rows.select("rid", "doc_id", "n_words", F.when(F.col("words").isNotNull(), contexts(F.col("words"), picked)).otherwise(none).alias("found")))
    kept = suppress(cut(detect(scanned)))
    lists = kept.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "priority", "score", "base"))).alias("detections"))
    empty = F.array().cast(dict(lists.dtypes)["detections"])
    return scanned.select("rid", "doc_id", "n_words").join(lists, "rid", "left").select("doc_id", "n_words", F.coalesce("detections", empty).alias("detections"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    names = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")
    doubt = F.aggregate("detections", F.lit(1.0), lambda a, d: a * (1 - d["score"]))
    return scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("detections")).alias("labels"), F.round(1 - doubt, 9).alias("score"),
    )

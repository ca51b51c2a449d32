"""Quality rules as weak supervision.

Each rule looks at one statistic of a whole text and votes *bad*, *good* or abstains. No rule
rejects a document alone: expectation-maximisation over all documents estimates how often each
rule gives each vote on good and on bad documents, and the posterior probability of *good*
decides.

Statistics, votes and verdicts are DataFrame expressions. Votes are pre-aggregated to one row per distinct
vote pattern, at most 3 to the power of the number of rules whatever the number of documents; this
table comes to the driver once, and the iterations run there.

Cases: a null text is an empty one; very long texts are read whole; an empty text has no words, fails the base rule and gets the
votes of its (zero) statistics; repeated rows each get a row; an empty table gives an empty
result; columns other than doc_id and text are ignored, and null doc_ids are kept as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, documents, split_words, text_of, written

#: Frequent function words of the four languages of the corpus.
STOPWORDS = (
    "the", "of", "and", "to", "in", "is", "that", "with", "for", "it",
    "der", "die", "und", "das", "ist", "ein", "von", "nicht", "zu", "den",
    "de", "la", "le", "les", "un", "une", "et", "que", "dans", "pour",
    "el", "los", "del", "se", "por", "con", "no", "su", "las", "en",
)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_stop", "n_runs")


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str


#: Shares are of words (or lines, or characters), so that they mean the same for any length.
RULES = (
    Rule("length", "n_words < 20", "n_words >= 50"),
    Rule("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    Rule("upper_case", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    Rule("shouting", "10 * n_shouts > n_words", "100 * n_shouts <= n_words"),
    Rule("word_runs", "10 * n_runs > n_words", "50 * n_runs <= n_words"),
    Rule("function_words", "100 * n_stop < n_words", "20 * n_stop >= n_words"),
)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics the rules read, one narrow pass over whole texts.

    Windows of three words are compared by a 64-bit hash of the three words.
    """
    spread = (
        docs.withColumn("_text", text_of())
        .withColumn("_words", split_words(F.col("_text")))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    )
    words, n = F.col("_words"), F.size("_words")
    grams = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))
    spread = spread.withColumn("_grams", grams)
    grams = F.col("_grams")
    # sorted windows put equal ones side by side; texts without equal windows skip the sort
    again = F.size(F.array_distinct(grams)) < F.size(grams)
    spread = spread.withColumn("_sorted", F.when(again, F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    by = F.col("_sorted")
    twice = F.filter(by, lambda x, i: (x["g"] == F.get(by, i - 1)["g"]) | (x["g"] == F.get(by, i + 1)["g"]))
    spread = spread.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    run = F.aggregate(F.zip_with(F.slice(words, F.lit(2), F.greatest(n, F.lit(0))), words, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x)
    stop = F.size(F.filter(words, lambda w: w.isin(*STOPWORDS)))
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    added = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": count("[#*$%&|<>]"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_upper": count(r"\p{Lu}"),
        "n_shouts": count("!!+"),
        "n_stop": stop.cast("long"),
        "n_runs": run.cast("long"),
    }
    return spread.select(*docs.columns, *[c.alias(k) for k, c in added.items()])


def votes() -> list[Column]:
    """The vote of each rule: -1 bad, 0 none, 1 good."""
    return [F.expr(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END") for r in RULES]


@dataclass(frozen=True)
class Model:
    """prior: share of good documents. odds[j][v]: log P(v | good) - log P(v | bad) of rule j."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def odds(self) -> list[list[float]]:
        return [[math.log(x) - math.log(y) for x, y in zip(g, b)] for g, b in zip(self.good, self.bad)]

    def posterior(self, v: list[Column]) -> Column:
        """P(good | votes), one vote a rule."""
        z = F.lit(math.log(self.prior) - math.log(1 - self.prior))
        for j, w in enumerate(self.odds()):
            z = z + F.when(v[j] == -1, w[0]).when(v[j] == 0, w[1]).otherwise(w[2])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def start() -> Model:
    """Rules are trusted alike at first; a bad vote is rare on good documents."""
    n = len(RULES)
    return Model(0.85, ((0.02, 0.1, 0.88),) * n, ((0.3, 0.1, 0.6),) * n)


def fit(patterns: DataFrame, steps: int = 25, tol: float = 1e-5, weight: float = 0.02) -> Model:
    """EM over a table (v, n) of vote patterns and their counts.

    weight: the starting model counts as so many documents, as a share of all; it names which
    class is the good one and keeps every probability above zero.
    """
    rows = sorted((tuple(r["v"]), r["n"]) for r in patterns.collect())  # 3 ** len(RULES) at most
    model = first = start()
    n = sum(c for _, c in rows)
    if not n:
        return first
    held = weight * n
    share = lambda a, p, total: (a + held * p) / (total + held)
    for _ in range(steps):
        odds, prior = model.odds(), math.log(model.prior) - math.log(1 - model.prior)
        good = [[0.0] * 3 for _ in RULES]
        every = [[0.0] * 3 for _ in RULES]
        g = 0.0
        for v, c in rows:
            p = c / (1 + math.exp(-(prior + sum(w[x + 1] for w, x in zip(odds, v)))))
            g += p
            for own, whole, x in zip(good, every, v):
                own[x + 1] += p
                whole[x + 1] += c
        new = Model(
            min(0.999, max(0.001, share(g, first.prior, n))),
            tuple(tuple(share(a, p, g) for a, p in zip(own, f)) for own, f in zip(good, first.good)),
            tuple(tuple(share(c - a, p, n - g) for a, c, p in zip(own, whole, f)) for own, whole, f in zip(good, every, first.bad)),
        )
        moved = max(abs(a - b) for x, y in zip(new.good + new.bad, model.good + model.bad) for a, b in zip(x, y))
        model = new
        if moved < tol:
            break
    return model


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def patterns(stats: DataFrame) -> DataFrame:
    """stats: (v, ...). (v, n): distinct vote patterns and their documents."""
    return stats.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def rate(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the statistics, posterior, base_failed and kept of every row of ``docs``."""
    stats = cut(with_statistics(docs.select("doc_id", "text")).drop("text"))
    model = fit(patterns(stats.select(F.array(*votes()).alias("v"))))
    rated = stats.select("*", model.posterior(votes()).alias("posterior"), base_failed().alias("base_failed"))
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with the columns of ``docs``.

    Rows are written once with their votes; the fit reads the votes alone, and the filter the
    rows. Texts are never shuffled.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    voted = written(with_statistics(packed).select("row", F.array(*votes()).alias("v"), base_failed().alias("failed")))
    model = fit(patterns(voted))
    posterior = model.posterior([F.get("v", F.lit(j)) for j in range(len(RULES))])
    return voted.where(~F.col("failed") & (posterior >= threshold)).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rate(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")

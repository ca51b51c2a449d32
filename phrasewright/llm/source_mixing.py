"""Mixing sources to target weights by entropy balancing.

Target words of a source follow from its weight: all sources share ``share`` times all words,
no source gets more than ``cap`` times its own, and the excess is shared again by weight among the
others until none is above (``targets``).

Document rates lie between 0 and ``cap`` copies. Among all rates that meet the word constraint
of every source, those with the least entropy loss against a uniform rate of cap/2 are

    rate = cap / (1 + exp(-lambda(source) * size / mean size of the source)),

an exponential tilt of the document's size. The dual is convex and separates by source; Newton
steps, safeguarded by a bracket, find every lambda at once. Before the iterations the documents
are pre-aggregated to (source, size, count); each iteration is one small aggregate over that
table and a hot source is no more in it than its distinct sizes.

Rates become copies: the whole part, and one more with the probability of the fraction, decided by
a hash of the row. What a source then lacks (or has too many) of words, about the square root
of its documents, is evened out along one order of its documents by whole copies and at most one
cut copy, through prefix sums over chunks; so each source takes its target rounded to a word.

Cases: null texts and empty ones have size 0 and take 0; null sources form one source, last in
the order; repeated rows are rows of their own (equal rows may differ in copies, in any
order); empty tables give empty results; very long texts are counted and cut whole; other columns are
ignored (and kept by ``mix``). Equal rows are counted and then numbered in pieces, so that neither a
task nor an array holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD_RE, cut, documents, parts_of, text_of, written

WEIGHTS = (3.0, 1.0, 2.0)
#: The places where words end and white space begins.
WORD_END_RE = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
#: Equal rows that one task numbers.
PIECE = 10_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RE)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources: (source, source_size, ...), one row each. Adds weight and target.

    Sources that end at their cap are those with the smallest cap/weight: in that order, with
    prefix sums, source i is capped iff cap_i <= weight_i * (total - caps before) / (weights from
    i on). A table of one row per source, so one window over it is small; ranks by source name come
    the same way.
    """
    one = F.lit(0)
    by_name = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sources.withColumn("weight", w).withColumn("_cap", cap * F.col("source_size"))
    by_ratio = Window.partitionBy(one).orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("_total", share * F.sum("source_size").over(Window.partitionBy(one)))
    ranked = ranked.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_open", F.sum("weight").over(after))
    ranked = ranked.withColumn("_full", F.col("_cap") * F.col("_open") <= F.col("weight") * F.col("_left"))
    # beyond the first source that isn't full none is; the rest share what is left there
    ranked = ranked.withColumn("_rate", F.first(F.when(~F.col("_full"), F.col("_left") / F.col("_open")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_rate")))
    return ranked.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("_cap", "_total", "_left", "_open", "_full", "_rate")


def rate_of(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    z = F.least(F.greatest(lam * size / mean, F.lit(-700.0)), F.lit(700.0))
    return F.lit(cap) / (F.lit(1.0) + F.exp(-z))


def balance(hist: DataFrame, goals: DataFrame, cap: float = 2.0, steps: int = 60, tol: float = 1e-9) -> DataFrame:
    """lambda of each source: (source, lam, mean). hist: (source, size, n); goals: (source, source_size, source_rows, target).

    Sources with nothing to meet (no words, or the target at the cap) need no iterations.
    """
    mean = F.col("source_size") / F.col("source_rows")
    state = goals.select("source", "target", "source_size", mean.alias("mean"), F.lit(0.0).alias("lam"), F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"), ((F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)) | (F.col("target") <= 0)).alias("done"))
    state = cut(state)
    for _ in range(steps):
        open_ = state.where(~F.col("done")).select(F.col("source").alias("s"), "lam", "mean")
        got = hist.join(open_, F.col("source").eqNullSafe(F.col("s")))
        r = rate_of(F.col("lam"), F.col("size"), F.col("mean"), cap)
        g = got.groupBy("s").agg(F.sum(F.col("n") * F.col("size") * r).alias("words"), F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r * (1 - r / cap)).alias("slope"))
        both = state.join(g, F.col("source").eqNullSafe(F.col("s")), "left")
        over = F.col("words") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - over / F.col("slope")
        moved = both.select(
            "source", "target", "source_size", "mean", F.col("lam").alias("was"), F.coalesce(lo, "lo").alias("lo"), F.coalesce(hi, "hi").alias("hi"), newton.alias("newton"),
            (F.col("done") | F.coalesce(F.abs(over) <= tol * F.greatest(F.col("target"), F.lit(1.0)), F.lit(True))).alias("done"),
        )
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        state = cut(moved.select("source", "target", "source_size", "mean", F.when(F.col("done"), F.col("was")).when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), "lo", "hi", "done"))
        if state.where(~F.col("done")).isEmpty():
            break
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    return state.select("source", "mean", F.when(full, F.lit(float("inf"))).when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(F.col("lam")).alias("lam"))


def _apart(rows: DataFrame) -> DataFrame:
    """rows, with another ``u`` for the second and further ones of equal rows. A rerun gives the same."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    pieces = counted.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / PIECE))))
    first = F.col("_p") * PIECE
    each = pieces.repartition(parts_of(rows), "u", "_p").withColumn("_k", F.explode(F.sequence(first, F.least(F.col("_n"), first + PIECE) - 1)))
    u = F.when(F.col("_k") == 0, F.col("u")).otherwise(_unit(F.col("u"), F.col("_k")))
    return each.select(*[u.alias(c) if c == "u" else F.col(f"`{c}`") for c in rows.columns])


def take(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """rows: (source, size, u, ...), u a number in [0, 1) that a rerun gives again. Adds source_size,
    target, rate and taken (words); u differs between equal rows."""
    own = rows.columns
    rows = cut(_apart(rows))
    hist = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows"))
    goals = cut(targets(goals, weights, share, cap))
    known = goals.join(balance(hist, goals, cap).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight", "source_rows")
    known = cut(known.withColumnRenamed("source", "s"))
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("s")), "left")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam") == float("inf"), cap).when(F.col("lam") == float("-inf"), 0.0).otherwise(rate_of(F.col("lam"), F.col("size"), F.col("mean"), cap))
    chunks = parts_of(rows)
    rounded = joined.withColumn("rate", rate).withColumn("copies", F.least(F.floor(F.col("rate") + F.col("u")), F.lit(cap)).cast("long"))
    rounded = rounded.withColumn("_full", F.floor(F.col("size") * cap).cast("long")).withColumn("_had", F.col("copies") * F.col("size"))
    rounded = rounded.withColumn("_chunk", F.floor(F.pmod(F.col("u") * 1048576.0, F.lit(1.0)) * chunks).cast("int")).drop("mean", "lam", "s")
    rounded = cut(rounded)
    # words that each (source, chunk) can still take or give, and those of the chunks before
    totals = rounded.groupBy("source", "_chunk").agg(F.sum("_had").alias("_sum"), F.sum(F.col("_full") - F.col("_had")).alias("_room"), F.max("target").alias("_goal"))
    whole = Window.partitionBy("source")
    before = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_miss", F.round(F.col("_goal")).cast("long") - F.sum("_sum").over(whole))
    can = F.when(F.col("_miss") > 0, F.col("_room")).otherwise(F.col("_sum"))
    totals = totals.withColumn("_before", F.coalesce(F.sum(can).over(before), F.lit(0)).cast("long"))
    totals = cut(totals.select(F.col("source").alias("s"), F.col("_chunk").alias("c"), "_miss", "_before"))
    placed = rounded.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("_chunk") == F.col("c")), "left")
    can = F.when(F.col("_miss") > 0, F.col("_full") - F.col("_had")).otherwise(F.col("_had"))
    inner = Window.partitionBy("source", "_chunk").orderBy("u", "size", *[c for c in own if c not in ("u", "size", "source")]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum("_can").over(inner), F.lit(0))
    placed = placed.withColumn("_can", can).withColumn("_ahead", ahead)
    change = F.greatest(F.lit(0).cast("long"), F.least(F.col("_can"), F.abs("_miss") - F.col("_ahead")))
    taken = F.col("_had") + F.when(F.col("_miss") > 0, change).otherwise(-change)
    return placed.select(*own, "source_size", "target", "rate", taken.cast("long").alias("taken"))


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash, 53 bits of it."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h (a hash of the text) and u of every row."""
    h = F.xxhash64(text_of())
    return docs.select("doc_id", "source", n_words(text_of()).alias("size"), h.alias("h"), _unit(F.col("doc_id"), F.lit("mix"), h).alias("u"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed corpus: ``docs`` with each row as often as it is taken.

    A cut copy is the text up to the end of its last word taken, as it stands; n_chars follows. Texts without
    words aren't taken. Texts are shuffled once, to meet what is taken of them; rows with the same id, text and
    source are written and numbered (by the task that reads them, and within its rows) and dealt their
    shares in turn.
    """
    key = lambda h: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), h.cast("string"), F.xxhash64("source").cast("string")).alias("key")
    plan = take(sized(docs), weights, share, cap).select(key(F.col("h")), "size", "taken")
    # a key's rows take few different shares: none, whole copies and its source's cut one
    plan = plan.groupBy("key", "size", "taken").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy(F.col("taken").desc()).rowsBetween(Window.unboundedPreceding, 0))
    plan = plan.select("key", "size", "n", F.struct(upto.alias("upto"), "taken").alias("share"))
    plan = plan.groupBy("key").agg(F.max("size").alias("size"), F.sum("n").alias("n"), F.sort_array(F.collect_list("share")).alias("each"))
    plan = cut(plan.where(F.col("each")[0]["taken"] > 0))
    rows = docs.select(key(F.xxhash64(text_of())), F.spark_partition_id().alias("part"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once, more = plan.where("n = 1"), plan.where("n > 1")
    met = rows.join(once, "key").select("row", "size", F.col("each")[0]["taken"].alias("taken"))
    if not more.isEmpty():
        repeated = written(rows.join(more, "key", "left_semi"))
        counts = repeated.groupBy("key", "part").agg(F.count(F.lit(1)).alias("own"))
        before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("key", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"))
        turn = F.col("first") + F.row_number().over(Window.partitionBy("key", "part").orderBy("key"))
        dealt = repeated.join(cut(counts.join(more, "key")), ["key", "part"]).withColumn("turn", turn)
        met = met.unionByName(dealt.select("row", "size", F.filter("each", lambda x: x["upto"] >= F.col("turn"))[0]["taken"].alias("taken")))
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = met.select("row", F.explode(copies).alias("first"))
    pieces = F.split(F.col("row.text").cast("string"), WORD_END_RE)  # each a word and the white space before it
    cut_text = F.array_join(F.slice(pieces, F.lit(1), F.col("first").cast("int")), "")
    out = out.select("row", "first", F.when(F.col("first") > 0, cut_text).otherwise(F.col("row.text")).alias("new"))
    value = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.col("first") > 0, F.length("new").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return out.select(*[value[c].alias(c) if c in value else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take(sized(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken", "rate")

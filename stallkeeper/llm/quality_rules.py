r"""Quality rules whose thresholds are risk-controlled, with DataFrame functions only.

Every document gets simple measures (higher is worse). For each stratum and rule, labelled
documents are a holdout: a cutoff may be used only if an exact (Clopper-Pearson) binomial
test shows that it rejects at most ``alpha / rules`` of the good documents of the stratum.
All cutoffs of a fixed grid in all strata are tested at ``delta / tests`` (Bonferroni), so
with probability 1 - delta every stratum loses at most ``alpha`` of its good documents,
whichever rules fire. The strictest cutoff that passes is taken; where none passes, the
rule stays silent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Stash, broadcast_if_small, load

WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Share of good documents that may be rejected, and the chance that this fails in any stratum.
ALPHA, DELTA = 0.02, 0.05
#: Rule: (numerator, denominator, cutoffs from the most lenient to the strictest).
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "duplicate_lines": ("n_dup_lines", "n_lines", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "repeated_words": ("n_repeat_words", "n_words", (0.19, 0.17, 0.15, 0.12, 0.1, 0.08, 0.05, 0.03)),
    "long_words": ("word_chars", "n_words", (40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 10.0)),
    "exclamations": ("n_exclaims", "word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
}


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts over every whole text; a null text counts as empty.

    Windows of five words are compared by a 64-bit hash of their word hashes within one text.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, WHITE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_WHITE))
    base = docs.select(
        *keep, words.alias("_words"), lines.alias("_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclaims"),
    )
    counted = base.select(
        *keep, "n_symbols", "n_exclaims",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda word: F.xxhash64(word)).alias("_hashes"),
    )
    starts = F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))
    windowed = counted.withColumn(
        "_windows",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(starts, lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW)))),
        ),
    )
    # Only a text with a repeated window pays for sorting.
    ordered = windowed.withColumn(
        "_ordered",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_windows", "_hashes")

    def repeated(one: Column, i: Column) -> Column:
        beside = lambda j: F.coalesce(F.get("_ordered", j)["h"] == one["h"], F.lit(False))
        return F.when(beside(i - 1) | beside(i + 1), one["i"])

    found = ordered.withColumn("_found", F.sort_array(F.array_compact(F.transform("_ordered", repeated)))).drop("_ordered")
    covered = F.aggregate(
        F.transform("_found", lambda at, i: F.least(F.coalesce(F.get("_found", i + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda total, one: total + one,
    )
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_found")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_factorial(x: Column) -> Column:
    """ln(x!) for a whole x: a table below 10, else Stirling's series (error under 1e-10)."""
    small = F.array(*(F.lit(math.log(math.factorial(i))) for i in range(10)))
    y = x.cast("double")
    series = y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return F.when(x < 10, F.get(small, x.cast("int"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float, terms: int = 4000) -> Column:
    """P(Bin(n, p) <= k), never below the exact value.

    Sums downwards from k, where each term is the one above times a ratio that shrinks;
    past ``terms`` terms the rest is bounded by a geometric series. From k >= n p on, where no
    test at a level under one half passes, it is 1.
    """
    n_, k_ = n.cast("double"), k.cast("double")
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k_ * math.log(p) + (n_ - k_) * math.log1p(-p)
    ratio = lambda i: i * (1 - p) / ((n_ - i + 1) * p)

    def add(state: Column, down: Column) -> Column:
        term = state["term"] * ratio(k_ - down + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(terms)).cast("int"))).otherwise(F.array().cast("array<int>"))
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    summed = F.aggregate(steps, begin, add, lambda s: s["total"] + F.when(k > terms, s["term"] * ratio(k_) / (1 - ratio(k_))).otherwise(0.0))
    return F.when(k_ >= n_ * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * summed))


def value_of(rule: str) -> Column:
    above, below, _ = RULES[rule]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


def choose_cutoffs(good: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum: ``stratum`` and a nullable double for each rule.

    ``good`` holds the measures of labelled good documents. Counts are taken in one
    aggregation; all that follows has a row for each stratum.
    """
    tests = [(rule, c) for rule, (_, _, cutoffs) in RULES.items() for c in cutoffs]
    above = [F.count_if(value_of(rule) > c).alias(f"k{j}") for j, (rule, c) in enumerate(tests)]
    counts = good.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *above)
    rows = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{j}").alias("k")) for j, (rule, c) in enumerate(tests))))
    strata = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # before rows multiply
    tested = strata.select("stratum", "n", "strata", rows.alias("one"))
    level = F.lit(delta) / (F.col("strata") * len(tests))
    passing = tested.where(binomial_tail(F.col("n"), F.col("one.k"), alpha / len(RULES)) <= level)
    strictest = [F.min(F.when(F.col("one.rule") == rule, F.col("one.cutoff"))).alias(f"cut_{rule}") for rule in RULES]
    return passing.groupBy("stratum", "n").agg(*strictest)


def judge(docs: DataFrame, labels: DataFrame, stash: Stash, stratum: str = "lang") -> DataFrame:
    """Every document's doc_id and stratum, its measures, base_failed and kept.

    ``labels`` has doc_id and quality (1 is good). A document with several labels is good if
    the least of them is 1; null ids and null labels don't count. Documents of a stratum
    without labels, null included, are judged by the base rule alone. Repeated rows are
    judged one by one and alike. Columns of docs other than doc_id, text and the stratum
    are not read; the stratum may have any name that no measure has.
    """
    docs = docs.select("doc_id", F.col(f"`{stratum}`").alias("_stratum"), "text")
    measured = stash.put("measures", measures(docs, ["doc_id", "_stratum"]).withColumn("base_failed", base_failed()))
    good = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    )
    cutoffs = stash.put("cutoffs", choose_cutoffs(measured.where("NOT base_failed").join(good.select("doc_id"), "doc_id", "left_semi"), "_stratum"))
    fires = [F.coalesce(value_of(rule) > F.col(f"cut_{rule}"), F.lit(False)) for rule in RULES]
    rejected = fires[0]
    for one in fires[1:]:
        rejected = rejected | one
    return (
        measured.join(broadcast_if_small(cutoffs), F.col("_stratum").eqNullSafe(F.col("stratum")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~rejected)
        .drop("stratum", "n", *(f"cut_{rule}" for rule in RULES))
        .withColumnRenamed("_stratum", stratum)
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of every document and the verdict of the risk-controlled rules, by language."""
    judged = judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), Stash(spark, "op1"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

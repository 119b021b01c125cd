"""Checks before a comparison: copies of a text, arms beside each other, a control with shuffled keys, and scores within strata of a confound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.scalars import WHITE, identity_text, jaccard, words
from evalloom.operators.exact_tests import fisher
from evalloom.operators.ranking import ranking_metrics
from evalloom.operators.splits import derangement


def text_identity(first: DataFrame, second: DataFrame, key: str, text: str) -> DataFrame:
    """(key, identical) of the keys that both sides have a text for, marks and white space apart. A key that repeats on a side is
    identical if any of its texts is on the other side. Digests are shuffled, texts aren't."""
    side = lambda df, bit: df.where(F.col(text).isNotNull()).select(key, F.sha2(identity_text(F.col(text)).cast("binary"), 256).alias("_d"), F.lit(bit).alias("_in"))
    digests = side(first, 1).unionByName(side(second, 2)).groupBy(key, "_d").agg(F.bit_or("_in").alias("_in"))
    return digests.groupBy(key).agg(F.bit_or("_in").alias("_sides"), (F.max("_in") == 3).alias("identical")).where("_sides = 3").select(key, "identical")


def arm_balance(arms: DataFrame, arm: str, endpoint: str, label: str) -> DataFrame:
    """(arm, endpoint, n, positive_rate); rows without a label count in n alone."""
    return arms.groupBy(arm, endpoint).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("positive_rate"))


def arm_covariates(arms: DataFrame, arm: str, text: str, number: str, category: str) -> DataFrame:
    """(arm, what, level, value): the median of a text's words (none: 0) and of a number (nulls left out), and the share of each category among rows that have one."""
    count = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WHITE}]+"))
    middle = arms.groupBy(arm).agg(F.percentile(count, 0.5).alias("words"), F.percentile(F.col(number).cast("double"), 0.5).alias("number"))
    medians = middle.unpivot([arm], ["words", "number"], "what", "value").select(arm, "what", F.lit(None).cast("string").alias("level"), "value")
    counts = arms.where(F.col(category).isNotNull()).groupBy(arm, F.col(category).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(arm))  # a row a category
    return medians.unionByName(counts.select(arm, F.lit("share").alias("what"), "level", share.alias("value")))


def hits(said: Column, truth: Column) -> Column:
    """Whether two texts share more than half of their words."""
    return F.coalesce(jaccard(F.array_distinct(words(said)), F.array_distinct(words(truth))) > 0.5, F.lit(False))


def shuffled_control(df: DataFrame, key: str, said: str, truth: str, seed: str) -> DataFrame:
    """(n, real_hits, shuffled_hits, p): how often what was said of a key hits its truth, and how often that of another key.

    Every key is met with its successor in hash order, so none meets itself; p is Fisher's, two-sided. Rows without one of the texts
    are left out; with fewer than two rows nothing is counted. A key is one row.
    """
    rows = df.where(F.col(said).isNotNull() & F.col(truth).isNotNull()).select(key, F.col(said).alias("_said"), F.col(truth).alias("_truth"))
    others = rows.select(F.col(key).alias("other"), F.col("_truth").alias("_other"))
    met = rows.join(derangement(rows, key, seed), key).join(others, "other")
    count = lambda t: F.coalesce(F.sum(hits(F.col("_said"), F.col(t)).cast("long")), F.lit(0))
    counts = met.agg(F.count(F.lit(1)).alias("n"), count("_truth").alias("a"), count("_other").alias("c"))
    tested = fisher(counts.withColumns({"b": F.col("n") - F.col("a"), "d": F.col("n") - F.col("c")}), ["n", "a", "c"], "a", "b", "c", "d")
    told = lambda c: F.when(F.col("n") > 1, F.col(c))
    return tested.select("n", told("a").alias("real_hits"), told("c").alias("shuffled_hits"), told("two_sided").alias("p"))


def confound_verdicts(df: DataFrame, cell: str, stratum: str, scores: tuple[str, str, str], label: str, floors: DataFrame, least: int = 20) -> DataFrame:
    """(cell, full, rival, confound, margin, pooled_margin, shrinkage, verdict): whether a score's lead is the confound's.

    scores are those of the model asked about, of its rival and of the confound alone. A cell is CUT where the confound's AP is within
    the cell's floor of the full score's, SOFTENED where the lead over the rival shrinks by more than half within strata, and CONFIRMED
    else. Strata of fewer than `least` rows or of one class are left out; the others' APs are weighted by their rows. floors is (cell, floor).
    """
    names = ("full", "rival", "confound")
    rows = df.select(F.col(cell).alias("cell"), F.col(stratum).alias("stratum"), F.col(label).alias("y"), *[F.col(s).cast("double").alias(n) for s, n in zip(scores, names, strict=True)])
    long = rows.unpivot(["cell", "stratum", "y"], list(names), "arm", "score")
    whole = ranking_metrics(long, ["cell", "arm"], "score", "y").groupBy("cell").pivot("arm", list(names)).agg(F.max("ap"))
    n = F.col("n_pos") + F.col("n_neg")
    parts = ranking_metrics(long.where("arm <> 'confound'"), ["cell", "stratum", "arm"], "score", "y").where((n >= least) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    pooled = parts.groupBy("cell").pivot("arm", ["full", "rival"]).agg(F.sum(F.col("ap") * n) / F.sum(n)).select("cell", (F.col("full") - F.col("rival")).alias("pooled_margin"))
    margin = F.col("full") - F.col("rival")
    found = whole.join(pooled, "cell", "left").join(floors.select(F.col(cell).alias("cell"), "floor"), "cell", "left").withColumn("margin", margin)
    found = found.withColumn("shrinkage", 1 - F.col("pooled_margin") / F.nullif("margin", F.lit(0.0)))
    verdict = F.when(F.abs(F.col("confound") - F.col("full")) <= F.col("floor"), "CUT").when(F.col("shrinkage") > 0.5, "SOFTENED").otherwise("CONFIRMED")
    return found.select(F.col("cell").alias(cell), *names, "margin", "pooled_margin", "shrinkage", verdict.alias("verdict"))

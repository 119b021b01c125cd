"""Closed-form tests on counts of any size, and rank tests whose ranks are relational algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import special
from evalloom.operators.ranking import running


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(X >= k) for n trials with chance p."""
    return special.tail_of_binomial(n, k, p)


def mcnemar(a_only: Column, b_only: Column) -> Column:
    """One-sided exact p that a wins more of the discordant pairs than b; 1 without one."""
    return binomial_tail(a_only + b_only, a_only, F.lit(0.5))


def clopper_pearson(k: Column, n: Column, level: float = 0.95) -> Column:
    """struct(lo, hi): the exact interval of a share; null without trials."""
    return special.interval_of_share(k, n, level)


def fisher(df: DataFrame, keys: list[str], a: str, b: str, c: str, d: str) -> DataFrame:
    """(keys, two_sided, greater) of the 2 x 2 tables [[a, b], [c, d]], with the margins as they are."""
    return df.select(*keys, special.table_p(*map(F.col, (a, b, c, d))).alias("_p")).select(*keys, "_p.two_sided", "_p.greater")


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """df with rank (1 to n, ties share the mean) and ties (rows of the value). Distinct values are ranked in sections."""
    groups = df.groupBy(F.col(value).alias("score")).agg(F.count(F.lit(1)).cast("double").alias("pos")).withColumn("neg", F.lit(0.0))
    everything = groups.agg(F.sum("pos").alias("_all"))
    ranked = running(groups, []).crossJoin(F.broadcast(everything))  # one row
    ranked = ranked.select(F.col("score").alias("_v"), F.col("pos").cast("long").alias("ties"), (F.col("_all") - F.col("tp") + (F.col("pos") + 1) / 2).alias("rank"))
    return df.join(ranked, F.col(value) == F.col("_v")).drop("_v")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """(h, df, p): the Kruskal-Wallis statistic with its correction for ties, its degrees of freedom and its tail."""
    ranked = average_ranks(df.where(F.col(value).isNotNull()), value)
    sums = ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("k"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    n = F.sum("k").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("k")) - 3 * (n + 1)
    found = sums.agg(F.try_divide(h, 1 - F.try_divide(F.sum("t"), n * n * n - n)).alias("h"), (F.count(F.lit(1)) - 1).alias("df"))
    return found.withColumn("p", special.p_of_chi2(F.col("h"), F.col("df")))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(w_plus, n, z, p) of the signed-rank test of a - b; differences of 0 are left out, z is corrected for ties, p is two-sided."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    ranked = average_ranks(d, "size")
    n = F.count(F.lit(1)).cast("double")
    w, spread = F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)), n * (n + 1) * (2 * n + 1) / 24 - F.sum(F.col("ties") * F.col("ties") - 1) / 48
    found = ranked.agg(w.alias("w_plus"), n.cast("long").alias("n"), F.try_divide(w - n * (n + 1) / 4, F.sqrt(spread)).alias("z"))
    return found.withColumn("p", special.p_of_normal(F.col("z")))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho, p): the correlation of average ranks over rows with both values, p two-sided by the t distribution."""
    both = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    x = average_ranks(both, "a").select("b", F.col("rank").alias("ra"))
    y = average_ranks(x, "b").select("ra", F.col("rank").alias("rb"))
    found = y.agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))
    return found.withColumn("p", special.p_of_correlation(F.col("rho"), F.col("n")))


def accuracy_tests(df: DataFrame, by: str, said: str, truth: str, per_family: float = 0.05) -> DataFrame:
    """(by, n, balanced_accuracy, p, significant): per task, the 2 x 2 table of what was said and what is true, Fisher's two-sided p
    and whether it is below per_family shared by all tasks. A task of one class has neither value nor significance."""
    s, t = F.col(said).cast("int"), F.col(truth).cast("int")
    n = lambda x, y: F.sum(((s == x) & (t == y)).cast("long"))
    counts = df.groupBy(by).agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    tested = counts.join(fisher(counts, [by], "a", "b", "c", "d").select(by, F.col("two_sided").alias("p")), by)
    tasks = counts.agg(F.count(F.lit(1)).alias("_tasks"))
    accuracy = (F.try_divide("a", F.col("a") + F.col("c")) + F.try_divide("d", F.col("b") + F.col("d"))) / 2
    p = F.when(accuracy.isNotNull(), F.col("p"))
    all_n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return tested.crossJoin(F.broadcast(tasks)).select(by, all_n.alias("n"), accuracy.alias("balanced_accuracy"), p.alias("p"), F.coalesce(p < per_family / F.col("_tasks"), F.lit(False)).alias("significant"))

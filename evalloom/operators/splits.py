"""Allocation, stratified splits, subsets and folds in hash order."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.scalars import hash_order


def hash_rank(df: DataFrame, by: list[str], seed: str, key: str) -> DataFrame:
    """df with _rank, 1 to n in hash order within `by`.

    Rows are cut into 4,096 sections by the first digits of the hash, each numbered by itself from the count of those before
    it, so that neither all rows nor a hot stratum are one task. Rows that repeat a key are in no fixed order.
    """
    order = hash_order(seed, F.col(key))
    cut = df.withColumn("_h", order).withColumn("_section", F.substring("_h", 1, 3))
    sizes = cut.groupBy(*by, "_section").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows a stratum
    starts = sizes.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_section").alias("_own"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    on = F.col("_section") == F.col("_own")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    own = F.row_number().over(Window.partitionBy(*by, "_section").orderBy("_h", key))
    return cut.withColumn("_place", own).join(starts, on).withColumn("_rank", F.col("_before") + F.col("_place")).select(*df.columns, "_rank")


def largest_remainder(strata: DataFrame, name: str, count: str, total: int) -> DataFrame:
    """(name, count, quota): `total` dealt in proportion, the largest remainders first, then by name."""
    everything = Window.partitionBy(F.lit(0))
    share = strata.withColumn("_x", F.col(count) * total / F.sum(count).over(everything)).withColumn("_f", F.floor("_x"))
    rank = F.row_number().over(everything.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), name))
    short = total - F.sum("_f").over(everything)
    return share.select(name, count, (F.col("_f") + (rank <= short).cast("int")).cast("bigint").alias("quota"))


def stratified_subset(df: DataFrame, key: str, stratum: str, total: int, seed: str) -> DataFrame:
    """(key, stratum): exactly `total` rows, in proportion to the strata, chosen by hash order."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    quotas = largest_remainder(counts, stratum, "n", total).select(stratum, "quota")
    placed = hash_rank(df.select(key, stratum), [stratum], seed, key)
    return placed.join(quotas, stratum).where("_rank <= quota").select(key, stratum)  # a row a stratum


def stratified_split(df: DataFrame, key: str, label: str, share: float, seed: str) -> DataFrame:
    """df with split: the first share of each label in hash order, rounded up, is valid."""
    most = df.groupBy(F.col(label).alias("_label")).agg(F.ceil(F.count(F.lit(1)) * share).alias("_most"))
    placed = hash_rank(df, [label], seed, key).join(most, F.col(label).eqNullSafe(F.col("_label")))  # a row a label
    return placed.withColumn("split", F.when(F.col("_rank") <= F.col("_most"), "valid").otherwise("train")).drop("_label", "_most", "_rank")


def random_folds(df: DataFrame, key: str, folds: int, seed: str) -> DataFrame:
    """df with fold: positions in hash order dealt in turn, so sizes differ by one at most."""
    return hash_rank(df, [], seed, key).withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def sized_folds(df: DataFrame, key: str, sizes: list[int], seed: str) -> DataFrame:
    """df with fold: hash order cut at the running totals of `sizes`; rows beyond them have no fold."""
    ends, total = [], 0
    for n in sizes:
        total += n
        ends.append(total)
    fold = F.when(F.col("_rank") <= total, F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("_rank"))))
    return hash_rank(df, [], seed, key).withColumn("fold", fold).drop("_rank")


def derangement(df: DataFrame, key: str, seed: str) -> DataFrame:
    """(key, other): each key's successor in hash order, the first for the last, so no key meets itself where there are two."""
    placed = hash_rank(df.select(key).distinct(), [], seed, key)
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    wanted = placed.crossJoin(F.broadcast(n)).select(key, (F.col("_rank") % F.col("_n") + 1).alias("_to"))
    return wanted.join(placed.select(F.col(key).alias("other"), F.col("_rank").alias("_to")), "_to").select(key, "other")


def family_folds(df: DataFrame, family: str, folds: int, most: int = 100_000) -> DataFrame:
    """(family, n, fold): families packed whole, the largest first to the smallest fold.

    The packing goes family by family, so their counts come to the driver; more than `most` families are refused.
    """
    counts = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} families; group them first")
    loads, rows = [(0, k) for k in range(folds)], []
    for name, n in sorted(counts, key=lambda r: (-r["n"], str(r[0]))):
        load, k = heapq.heappop(loads)
        rows.append((name, n, k))
        heapq.heappush(loads, (load + n, k))
    kind = dict(df.dtypes)[family]
    return df.sparkSession.createDataFrame(rows, f"`{family}` {kind}, n bigint, fold int")


def holdout_rows(df: DataFrame, key: str, family: str, folds: DataFrame, k: int) -> DataFrame:
    """df with part: eval for families of fold k, train for all others; rows without a family are never evaluated."""
    fold = folds.where(F.col("fold") == k).select(F.col(family).alias("_family"))
    return df.join(fold, F.col(family) == F.col("_family"), "left").withColumn("part", F.when(F.col("_family").isNotNull(), "eval").otherwise("train")).drop("_family")


def capped_sample(df: DataFrame, key: str, label: str, most: int, seed: str) -> DataFrame:
    """At most about `most` rows, at least one of each label, in hash order."""
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy(F.lit(0)))  # a row a label
    quotas = counts.select("_label", F.greatest(F.lit(1), F.round(F.col("_c") * F.least(F.lit(1.0), most / total))).alias("_q"))
    placed = hash_rank(df, [label], seed, key).join(quotas, F.col(label).eqNullSafe(F.col("_label")))
    return placed.where("_rank <= _q").drop("_label", "_q", "_rank")


def arm_sample(pooled: DataFrame, key: str, endpoint: str, label: str, total: int | None, seed: str) -> DataFrame:
    """(key, endpoint, label): rows with a label, all of them or `total` in proportion to the (endpoint, label) strata in hash order.

    A key of several endpoints is a row of each, drawn by itself.
    """
    rows = pooled.select(key, endpoint, label).where(F.col(label).isNotNull())
    if total is None:
        return rows
    named = rows.withColumn("_stratum", F.concat_ws("|", endpoint, label)).withColumn("_row", F.concat_ws("|", endpoint, key))
    return named.join(stratified_subset(named, "_row", "_stratum", total, seed).select("_row"), "_row", "left_semi").select(key, endpoint, label)

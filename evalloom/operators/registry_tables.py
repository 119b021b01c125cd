"""Labels, pivots and slices over normalised tables with many rows per parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pooled_rate(df: DataFrame, key: str, part: Column, whole: Column) -> DataFrame:
    """(key, rate) of sums over all rows of a key; a null sum is 0 and a zero denominator gives null."""
    a, b = F.coalesce(F.sum(part), F.lit(0)), F.coalesce(F.sum(whole), F.lit(0))
    return df.groupBy(key).agg(F.try_divide(a.cast("double"), b.cast("double")).alias("rate"))


def class_codes(train: DataFrame, label: str, name: str) -> DataFrame:
    """(label, name): the training rows' classes numbered from 0 in order."""
    order = Window.partitionBy(F.lit(0)).orderBy(label)  # a row a class
    return train.select(label).distinct().withColumn(name, F.row_number().over(order) - 1)


def any_event(df: DataFrame, key: str, count: Column) -> DataFrame:
    return df.groupBy(key).agg((F.coalesce(F.sum(count), F.lit(0)) > 0).cast("int").alias("label"))


def status_label(df: DataFrame, key: str, title: str, wanted: str, count: Column) -> DataFrame:
    """1 if the key's rows with the wanted title count more than 0; a key without such a row is 0."""
    return df.groupBy(key).agg((F.sum(F.when(F.col(title) == wanted, count).otherwise(0)) > 0).cast("int").alias("label"))


def counts_by_type(df: DataFrame, key: str, kind: str, values: list[str]) -> DataFrame:
    """One column of counts per listed type, 0 where a key has none."""
    return df.groupBy(key).pivot(kind, values).agg(F.count(F.lit(1)).cast("bigint")).fillna(0)


def joined_strings(df: DataFrame, key: str, value: str, mark: str = "; ") -> DataFrame:
    """Distinct values in order, joined; only nulls give an empty string."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), mark).alias("joined"))


def ordered_list(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda s: s[value]).alias("values"))


def first_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_first = 1").drop("_first")


def date_slices(dates: DataFrame, key: str, registered: str, posted: str, cutoff: str) -> DataFrame:
    """(key, slice): a if registered before and posted after the cutoff, b if both are after it. Equal dates are in neither."""
    cut = F.to_date(F.lit(cutoff))
    late = F.col(posted) > cut
    name = F.when((F.col(registered) < cut) & late, "a").when((F.col(registered) > cut) & late, "b")
    return dates.select(key, name.alias("slice")).where("slice is not null")


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, rate), one scan for all columns."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return sums.unpivot(["n"], columns, "column", "n_missing").select("column", F.col("n_missing").cast("bigint").alias("n_missing"), (F.col("n_missing") / F.col("n")).alias("rate"))


def histogram(df: DataFrame, share: Column, bins: int = 10) -> DataFrame:
    """Counts in bins of [0, 1]; the last bin is closed."""
    return df.where(share.isNotNull()).groupBy(F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def value_shares(df: DataFrame, by: str) -> DataFrame:
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def tie_profile(df: DataFrame, value: str) -> DataFrame:
    """Distinct values, rows in the largest block of equal values, and that block's share."""
    blocks = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    return blocks.agg(F.count(F.lit(1)).alias("n_distinct"), F.max("c").alias("largest"), (F.max("c") / F.sum("c")).alias("share"))


def crosstab(df: DataFrame, a: str, b: str, value: Column) -> DataFrame:
    return df.groupBy(a, b).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def without(df: DataFrame, columns: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """df without the named columns and those whose name holds one of the patterns; absent ones are no error."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in set(columns) and not any(p in c for p in patterns)])


def with_missing(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    """df with the columns that it lacks as nulls."""
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def mapped(value: Column, to: dict[str, str]) -> Column:
    """The value's counterpart; null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in to.items() for x in pair]), value)


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a value in any row."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if counts[c] == 0]

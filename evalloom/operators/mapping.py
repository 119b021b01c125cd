"""Terms mapped to their nearest codes, how far two mappings of records agree, and what is drawn for adjudication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.audit import nearest, right_closed_bins
from evalloom.operators.splits import hash_rank


def nearest_codes(terms: DataFrame, index: DataFrame, term: str, code: str, vector: str, block: int = 2048) -> DataFrame:
    """(term, code): the code whose vector has the highest cosine with a term's; ties go to the smallest code.

    A term or code that occurs with several vectors takes the least of them. Null, zero and unnamed vectors are mapped to nothing.
    """
    once = lambda df, name: df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("_k")).agg(F.min(vector).alias("_v"))
    met = nearest(once(terms, term), once(index, code), "_k", "_v", 1, block, with_itself=True)
    return met.select(F.col("_k").alias(term), F.col("other").alias(code))


def agreement(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, level, n_first, n_second, n_both, jaccard) of two mappings given as (key, level, term) rows.

    A record that neither mapping gives a term of a level has no row there. Terms are met in one shuffle, as rows.
    """
    rows = lambda df, bit: df.where("term is not null").select(key, "level", "term", F.lit(bit).alias("_in"))
    terms = rows(first, 1).unionByName(rows(second, 2)).groupBy(key, "level", "term").agg(F.bit_or("_in").alias("_in"))
    count = lambda bits: F.sum((F.col("_in").bitwiseAND(F.lit(bits)) == bits).cast("long"))
    return terms.groupBy(key, "level").agg(count(1).alias("n_first"), count(2).alias("n_second"), count(3).alias("n_both"), (count(3) / F.count(F.lit(1))).alias("jaccard"))


def mean_agreement(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, level, mean_jaccard, n_scored) of `agreement`'s rows."""
    return found.groupBy(*by, "level").agg(F.avg("jaccard").alias("mean_jaccard"), F.count(F.lit(1)).alias("n_scored"))


def disagreement_sample(found: DataFrame, key: str, value: str, total: int, seed: str, bins: int = 4) -> DataFrame:
    """Rows whose value is below 1, with bin and place: as many from each quantile bin of the value, `total` at most, in hash order.

    A bin that has fewer rows than its share gives them all, and its share isn't dealt to the others. Bins are closed at the right.
    """
    apart = found.where(F.col(value) < 1)
    binned = right_closed_bins(apart, apart, value, bins)
    ranked = hash_rank(binned, ["bin"], seed, key).withColumnRenamed("_rank", "place")
    few = ranked.where(F.col("place") <= max(1, total // bins))
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bin", "place"))  # at most `total` rows, or one a bin
    return few.withColumn("_at", first).where(F.col("_at") <= total).drop("_at")

"""Frames that stand in for the reference's inputs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.scalars import ESCAPED, WHITE

SCORED = """scored AS (
    SELECT d.doc_id AS id, d.lang, d.source AS cluster, d.n_chars::DOUBLE AS a, (d.n_chars % 97)::DOUBLE AS b, l.quality AS y
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
RUNS = """runs AS (
    SELECT 'm' || (l_suppkey % 7) AS method, (l_partkey % 9)::INT AS cell, l_linenumber AS seed,
           round(avg(l_discount) * 10, 9) AS value, round(avg(l_tax), 9) AS half
    FROM lineitem WHERE l_suppkey % 7 <> 3 OR l_partkey % 9 <> 4 GROUP BY ALL)"""
#: Draws of SQL oracles: w is how often unit k of n comes up in each draw.
DRAWS = """units AS (SELECT cluster, row_number() OVER (ORDER BY sha256('unit|' || cluster)) - 1 AS k FROM (SELECT DISTINCT cluster FROM scored)),
    drawn AS (SELECT draw, ('0x' || substr(sha256('{seed}|' || draw || '|' || u.k), 1, 8))::BIGINT % (SELECT count(*) FROM units) AS k
              FROM units u, range(1, {draws} + 1) t(draw)),
    weights AS (SELECT d.draw, u.cluster, count(*) AS w FROM drawn d JOIN units u ON d.k = u.k GROUP BY ALL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    both = docs.select("doc_id", "lang", "source", "n_chars").join(labels.select("doc_id", "quality"), "doc_id")
    return both.select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("cluster"), F.col("n_chars").cast("double").alias("a"), (F.col("n_chars") % 97).cast("double").alias("b"), F.col("quality").alias("y"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_suppkey % 7 <> 3 or l_partkey % 9 <> 4")
    keyed = li.groupBy(F.concat(F.lit("m"), F.col("l_suppkey") % 7).alias("method"), (F.col("l_partkey") % 9).cast("int").alias("cell"), F.col("l_linenumber").alias("seed"))
    return keyed.agg(F.round(F.avg("l_discount") * 10, 9).alias("value"), F.round(F.avg("l_tax"), 9).alias("half"))


def identity_sql(text: str) -> str:
    """The text in which two copies are compared."""
    bare = f"""replace(replace(replace(coalesce({text}, ''), '~', ' '), '"', ''), ' * ', ' - ')"""
    return f"""trim(regexp_replace(regexp_replace({bare}, '\\\\({ESCAPED})', '\\1', 'g'), '[{WHITE}]+', ' ', 'g'))"""


def ranking_sql(source: str, by: str, score: str, label: str = "y", weight: str = "1", name: str = "ranked") -> str:
    """CTE `name`: by, ap, auroc, n_pos, n_neg of the rows of `source`. Weighted rows are draws, where AP of one class is null."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{name}_g AS (SELECT {keys}{score} AS s, sum({weight} * {label}) AS pos, sum({weight} * (1 - {label})) AS neg FROM {source} GROUP BY {keys}{score}),
    {name}_r AS (SELECT *, sum(pos) OVER ({part}ORDER BY s DESC) AS tp, sum(neg) OVER ({part}ORDER BY s DESC) AS fp FROM {name}_g),
    {name} AS (SELECT {keys}CASE WHEN sum(pos) > 0 {"" if weight == "1" else "AND sum(neg) > 0 "}THEN sum(pos * tp / nullif(tp + fp, 0)) / sum(pos) {"WHEN sum(neg) > 0 THEN 0 " if weight == "1" else ""}END AS ap,
               (sum(pos * (neg / 2 - fp)) + sum(pos) * sum(neg)) / nullif(sum(pos) * sum(neg), 0) AS auroc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM {name}_r {group})"""

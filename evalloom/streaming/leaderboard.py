"""A leaderboard that is rebuilt as run records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalloom.operators.runs import leaderboard

RUN = "method string, cell string, seed int, prauc double"
BUCKETS = 64


def incremental(spark: SparkSession, source: str, store: str, out: str, state: str, schema: str = RUN) -> StreamingQuery:
    """Takes new run files (JSON) into `store` and adds a leaderboard to `out`; ends when all that is there is read.

    A batch is written under its own number, in `store` and in `out`, so one that is repeated after a failure replaces
    itself and no reader meets a half-written leaderboard. Of runs that repeat a method, cell and seed the last batch's
    counts, and within a batch the highest value.

    store/runs keeps a row a run and store/means each method's mean of a cell, both by batch and by bucket of the cell. A batch
    reads the runs of the buckets that it has cells of and no others; the leaderboard is made from each bucket's last means.
    """

    def rebuild(batch: DataFrame, number: int) -> None:
        stored = lambda name, kind: batch.sparkSession.read.schema(f"{kind}, batch int, bucket int").parquet(f"{store}/{name}").where(F.col("batch") <= number)
        bucket = F.pmod(F.xxhash64("cell"), F.lit(BUCKETS)).cast("int")
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/runs/batch={number}")
        runs = stored("runs", schema)
        touched = [r["bucket"] for r in runs.where(F.col("batch") == number).select("bucket").distinct().collect()]  # at most BUCKETS
        last = runs.where(F.col("bucket").isin(touched)).groupBy("bucket", "method", "cell", "seed").agg(F.max(F.struct("batch", "prauc")).alias("r"))
        means = last.groupBy("bucket", "method", "cell").agg(F.avg("r.prauc").alias("prauc"))
        means.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/means/batch={number}")
        known = stored("means", "method string, cell string, prauc double")
        newest = known.groupBy("bucket").agg(F.max("batch").alias("batch"))
        leaderboard(known.join(newest, ["bucket", "batch"], "left_semi"), "method", "cell", "prauc").write.mode("overwrite").parquet(f"{out}/batch={number}")

    arrivals = spark.readStream.schema(schema).json(source)
    return arrivals.writeStream.foreachBatch(rebuild).option("checkpointLocation", state).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The leaderboard of the last batch."""
    boards = spark.read.parquet(out)
    return boards.join(boards.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")

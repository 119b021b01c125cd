"""Stores that are written once, or by content: tables with a manifest, records that replace each other whole, and a cache of replies."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
CACHE_ROW = "key string, model string, temperature double, tier string, prompt string, reply string, at timestamp, writer string"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _text(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())  # a manifest or a record, one short file


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file unless it is there: the store decides between two writers, as HDFS and object stores with conditional puts do."""
    fs, at = _fs(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as refused:
        if "already exists" in str(refused) or fs.exists(at):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def put_once(df: DataFrame, path: str) -> bool:
    """Writes df as the table at path unless there is one; whether it was this one. The table counts from when its manifest is made,
    so a writer that fails, or comes second, leaves nothing that is read."""
    spark = df.sparkSession
    data = f"{path}/data-{uuid.uuid4().hex}"
    if _text(spark, f"{path}/{MANIFEST}") is not None:
        return False
    df.write.parquet(data)
    if _create(spark, f"{path}/{MANIFEST}", json.dumps({"data": data.rsplit("/", 1)[1]})):
        return True
    fs, at = _fs(spark, data)
    fs.delete(at, True)
    return False


def read_once(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, None if none has been written whole."""
    manifest = _text(spark, f"{path}/{MANIFEST}")
    return None if manifest is None else spark.read.parquet(f"{path}/{json.loads(manifest)['data']}")


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made first if it isn't there. All callers get the one that was there first."""
    if (found := read_once(spark, path)) is None:
        put_once(make(), path)
        found = read_once(spark, path)
    return found


def put_record(spark: SparkSession, path: str, record: dict) -> None:
    """Writes a JSON record under a name of its own and renames it over the old one, so no reader meets half a record."""
    fs, at = _fs(spark, path)
    temporary = f"{path}.{uuid.uuid4().hex}"
    if not _create(spark, temporary, json.dumps(record, sort_keys=True)):
        raise FileExistsError(temporary)
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(_fs(spark, temporary)[1], at, how)


def record(spark: SparkSession, path: str) -> dict | None:
    text = _text(spark, path)
    return None if text is None else json.loads(text)


def cache_key(model: Column, prompt: Column, temperature: Column, tier: Column) -> Column:
    """A digest of what a reply depends on."""
    return F.sha2(F.to_json(F.struct(model.alias("m"), prompt.alias("p"), temperature.cast("double").alias("t"), tier.alias("s"))), 256)


def cache_put(replies: DataFrame, path: str) -> None:
    """Appends (model, prompt, temperature, tier, reply) under their keys. Prompts are stored beside them, so a reply can be checked."""
    key = cache_key(F.col("model"), F.col("prompt"), F.col("temperature"), F.col("tier"))
    rows = replies.select(key.alias("key"), "model", F.col("temperature").cast("double").alias("temperature"), "tier", "prompt", "reply", F.current_timestamp().alias("at"), F.lit(uuid.uuid4().hex).alias("writer"))
    rows.withColumn("part", F.substring("key", 1, 2)).write.mode("append").partitionBy("part").parquet(path)


def cache_get(asked: DataFrame, path: str) -> DataFrame:
    """asked (model, prompt, temperature, tier) with key and reply, null where the cache has none; of several the last one written counts."""
    spark = asked.sparkSession
    wanted = asked.withColumn("key", cache_key(F.col("model"), F.col("prompt"), F.col("temperature"), F.col("tier")))
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return wanted.withColumn("reply", F.lit(None).cast("string"))
    stored = spark.read.schema(f"{CACHE_ROW}, part string").parquet(path)
    needed = stored.join(wanted.select(F.substring("key", 1, 2).alias("part"), "key").distinct(), ["part", "key"], "left_semi")
    last = needed.groupBy("key").agg(F.max_by("reply", F.struct("at", "writer")).alias("reply"))
    return wanted.join(last, "key", "left").select(*asked.columns, "key", "reply")

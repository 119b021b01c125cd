"""Readers and writers: keyed CSV pairs, delimited registry tables, crosswalks, run records, predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.codes import nested_rows
from evalloom.operators.runs import markdown

RUN_RECORD = """task string, phase string, method string, seed int, task_type string, num_classes int, n_train bigint, n_test bigint,
    n_features bigint, fit_secs double, headline string, point map<string,double>,
    bootstrap map<string,struct<mean:double,lo:double,hi:double,std:double>>, status string, reason string"""


def require_columns(df: DataFrame, wanted: set[str]) -> DataFrame:
    """df itself; raises if a wanted column is missing. More columns are allowed."""
    if missing := sorted(wanted - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def aligned_pair(spark: SparkSession, features: str, labels: str, key: str, candidates: list[str]) -> DataFrame:
    """Feature and label CSVs joined on their key, never by position; label is the first candidate there is, else the last column."""
    x, y = (spark.read.csv(p, header=True) for p in (features, labels))
    name = next((c for c in candidates if c in y.columns), y.columns[-1])
    return x.join(y.select(key, F.col(name).alias("label")), key)


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None, wanted: set[str] = frozenset()) -> DataFrame:
    """A pipe-delimited table with a header; only the asked columns are parsed."""
    df = require_columns(spark.read.csv(path, header=True, sep="|"), set(wanted) | set(columns or ()))
    return df.select(*columns) if columns else df


def rows_of_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def crosswalk(spark: SparkSession, path: str, code: int, categories: list[int]) -> DataFrame:
    """(code, categories): a quoted CSV by column positions; empty categories are left out."""
    df = spark.read.csv(path, header=True, quote='"')
    bare = lambda i: F.trim(F.regexp_replace(F.col(f"`{df.columns[i]}`"), "^'|'$", ""))
    each = df.select(bare(code).alias("code"), F.explode(F.array(*[bare(i) for i in categories])).alias("category"))
    return each.where("category <> ''").groupBy("code").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def run_records(spark: SparkSession, path: str) -> DataFrame:
    """Run records (JSON, one a file); broken files are left out, intervals become columns."""
    rows = spark.read.schema(f"{RUN_RECORD}, _broken string").option("columnNameOfCorruptRecord", "_broken").option("multiLine", True).json(path)
    ok = rows.where(F.col("_broken").isNull() & F.col("method").isNotNull()).drop("_broken")
    top = F.element_at("bootstrap", F.col("headline"))
    return ok.withColumns({"value": F.try_element_at("point", F.col("headline")), "lo": top["lo"], "hi": top["hi"]})


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions by task, phase, method and seed; a rewritten cell replaces only itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task", "phase", "method", "seed").parquet(path)


def predictions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def write_batches(df: DataFrame, path: str, most: int = 10_000) -> None:
    """JSON lines, at most `most` records in a file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", most).json(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id): a text file of ids, one a line, trimmed; empty lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def write_subset(df: DataFrame, key: str, path: str) -> str:
    """Writes the ids in order, one a line, and gives the SHA-256 of the sorted ids' digests, which names the subset at any partitioning."""
    df.select(F.col(key).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)
    return subset_digest(df, key)


def subset_digest(df: DataFrame, key: str) -> str:
    """A digest of a set of ids: their SHA-256 digests are summed in four parts, so no task holds them all."""
    h = F.sha2(F.col(key).cast("string"), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.select(key).distinct().agg(F.concat_ws("|", *[F.coalesce(part(k).cast("string"), F.lit("0")) for k in range(4)]).alias("s"))
    return sums.select(F.sha2("s", 256)).first()[0]


#: Fixed value: a chapter's description ends with its range of codes in brackets.
RANGE = r"\(([A-Z0-9]+-[A-Z0-9]+)\)\s*$"


def hierarchy(spark: SparkSession, path: str, chapters: int | None = 22) -> DataFrame:
    """(char3, block, chapter) of an XML code list: chapters by the range in their description, sections by their id.

    Only diagnoses whose code has three characters are taken, and only chapters with a range; `chapters` is how many of these
    there must be.
    """
    rows = spark.read.format("xml").option("rowTag", "chapter").schema("desc string, section array<struct<_id:string,diag:array<struct<name:string>>>>").load(path)
    ranged = rows.withColumn("chapter", F.regexp_extract(F.coalesce("desc", F.lit("")), RANGE, 1)).where("chapter <> ''")
    found = ranged.count()
    if chapters is not None and found != chapters:
        raise ValueError(f"{path} has {found} chapters, there must be {chapters}")
    blocks = ranged.select("chapter", F.explode("section").alias("s")).select("chapter", F.col("s._id").alias("block"), F.explode("s.diag").alias("d"))
    named = blocks.select(F.upper(F.trim("d.name")).alias("char3"), "block", "chapter").where(F.length("char3") == 3)
    return named.groupBy("char3").agg(F.min(F.struct("chapter", "block")).alias("p")).select("char3", "p.block", "p.chapter")


def code_tree(spark: SparkSession, path: str) -> DataFrame:
    """(parent, code, descriptor) of an XML code list, where codes nest in codes to any depth that the file has. A code's first parent in order counts."""
    rows = spark.read.format("xml").option("rowTag", "section").load(path)
    every = reduce(DataFrame.unionByName, nested_rows(rows, F.col("diag")))
    return every.where("code <> ''").groupBy("code").agg(F.min("parent").alias("parent"), F.min("descriptor").alias("descriptor")).select("parent", "code", "descriptor")


def category_names(spark: SparkSession, path: str, categories: list[int]) -> DataFrame:
    """(category, name) of a crosswalk file: a category's name stands one column to its right; the last of several counts."""
    df = spark.read.csv(path, header=True, quote='"').withColumn("_at", F.monotonically_increasing_id())
    bare = lambda i: F.trim(F.regexp_replace(F.col(f"`{df.columns[i]}`"), "^'|'$", ""))
    pairs = df.select("_at", F.posexplode(F.array(*[F.struct(bare(i).alias("category"), bare(i + 1).alias("name")) for i in categories])).alias("k", "e"))
    return pairs.where("e.category <> ''").groupBy("e.category").agg(F.max_by("e.name", F.struct("_at", "k")).alias("name"))


def term_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(term, vector): a text file, packed or not, of a term and its numbers, parted by tabs or spaces."""
    parts = F.split(F.trim("value"), r"[\t ]+")
    return spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2).select(F.col("p")[0].alias("term"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("double")).alias("vector"))


def response_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, reply) of a JSON lines cache; the last of lines that repeat a key counts, broken lines are left out."""
    rows = spark.read.schema("key string, reply string, at double").json(path).where("key is not null")
    return rows.groupBy("key").agg(F.max_by("reply", F.coalesce("at", F.lit(0.0))).alias("reply"))


def batch_records(spark: SparkSession, path: str) -> DataFrame:
    """(recordId, body, error) of batch output files: each record has an output or an error."""
    text = spark.read.text(path)
    get = lambda x: F.get_json_object("value", x)
    return text.select(get("$.recordId").alias("recordId"), get("$.modelOutput").alias("body"), get("$.error").alias("error")).where("recordId is not null")


def write_leaderboard(board: DataFrame, path: str, columns: list[str]) -> None:
    """The leaderboard as CSV and as a Markdown table, under path/csv and path/md."""
    board.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    markdown(board, columns).coalesce(1).write.mode("overwrite").text(f"{path}/md")


def write_adjudication(sample: DataFrame, path: str) -> None:
    """A sample that people judge, as one CSV file in UTF-8 with an empty column for notes."""
    sample.withColumn("adjudication_note", F.lit("")).coalesce(1).write.mode("overwrite").options(header=True, encoding="UTF-8", emptyValue="").csv(path)


def append_usage(calls: DataFrame, path: str) -> None:
    """Adds calls to the usage log, JSON lines by day."""
    calls.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").json(path)

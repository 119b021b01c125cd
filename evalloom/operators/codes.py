"""Code levels: a tree of codes walked step by step, each code's prefix, block, chapter and categories, and blocks of features.

A tree is (code, parent) rows of any depth. Levels are those of records' code sets; a granularity says which of them a record's
terms are, in one block or one block a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.storage import cut

#: The names of the levels, and of the granularities that a record's codes can be given in.
LEVELS = ("full", "char3", "block", "chapter")
GRANULARITIES = ("char3", "full", "chapter", "block", "ccsr", "ancestors", "stack")


def tree_paths(nodes: DataFrame, code: str = "code", parent: str = "parent", deepest: int = 64) -> DataFrame:
    """(code, ancestor, up): every code with itself (up 0) and all codes above it, one step nearer to the root in each round.

    A parent that is no code ends its path. A path of more than `deepest` steps, as a circle has, is an error. Rounds are
    written joins: a recursive query stops at a number of rows, and a tree of codes of a large table can have more.
    """
    rows = cut(nodes.select(F.col(code).alias("code"), F.col(parent).alias("parent")).where("code is not null").distinct(), "codes")
    above = rows.select(F.col("code").alias("_up"), F.col("parent").alias("_next"))
    step = rows.select("code", F.col("code").alias("ancestor"), "parent", F.lit(0).alias("up"))
    out = step
    for k in range(1, deepest + 2):
        step = cut(step.where("parent is not null").join(above, F.col("parent") == F.col("_up")).select("code", F.col("_up").alias("ancestor"), F.col("_next").alias("parent"), F.lit(k).alias("up")), "codes")
        if not step.limit(1).count():
            return out.select("code", "ancestor", "up")
        out = out.unionByName(step)
    raise ValueError("codes that lie in a circle, or too deep")


def tree_levels(nodes: DataFrame, code: str = "code", parent: str = "parent") -> DataFrame:
    """(code, depth, root, path): depth 0 is a root; path has the codes from root to code."""
    paths = tree_paths(nodes, code, parent)
    steps = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "ancestor")))
    return paths.groupBy("code").agg(F.max("up").alias("depth"), steps.alias("s")).select("code", "depth", F.col("s")[0]["ancestor"].alias("root"), F.col("s.ancestor").alias("path"))


def described(codes: DataFrame, code: str, descriptors: DataFrame) -> DataFrame:
    """codes with `descriptor`: of the code as it is, else of the code without its point. descriptors is (code, descriptor)."""
    names = descriptors.groupBy(F.upper(F.trim("code")).alias("_code")).agg(F.min("descriptor").alias("_d"))
    key = F.upper(F.trim(F.col(code)))
    exact = codes.join(names, key == F.col("_code"), "left").withColumnRenamed("_d", "_exact").drop("_code")
    bare = exact.join(names, F.when(F.col("_exact").isNull(), F.replace(key, F.lit("."), F.lit(""))) == F.col("_code"), "left")
    return bare.withColumn("descriptor", F.coalesce("_exact", "_d")).drop("_exact", "_d", "_code")


def code_levels(df: DataFrame, key: str, codes: str, hierarchy: DataFrame) -> DataFrame:
    """(key, level, term): every level of each record's codes, each term once. hierarchy has (char3, block, chapter), one row a char3."""
    each = df.select(key, F.explode(codes).alias("code")).select(key, F.upper(F.trim("code")).alias("full")).where("full <> ''").distinct()
    each = each.withColumn("char3", F.substring("full", 1, 3)).join(hierarchy, "char3", "left")
    return each.unpivot([key], list(LEVELS), "level", "term").where("term is not null").distinct()


def code_categories(levels: DataFrame, key: str, crosswalk: DataFrame) -> DataFrame:
    """(key, term): the crosswalk's categories of full codes, which it lists without their points; a code that it lacks has none."""
    full = levels.where("level = 'full'").select(key, F.replace("term", F.lit("."), F.lit("")).alias("_code"))
    known = crosswalk.select(F.upper(F.trim("code")).alias("_code"), F.explode("categories").alias("term"))
    return full.join(known, "_code").select(key, "term").distinct()


def code_terms(levels: DataFrame, key: str, granularity: str, crosswalk: DataFrame | None = None) -> DataFrame:
    """(key, block, term) of records' codes in a granularity: one level, crosswalk categories, all levels in one block, or a block for each."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"no granularity {granularity!r}, there are {', '.join(GRANULARITIES)}")
    if granularity == "ccsr":
        if crosswalk is None:
            raise ValueError("categories need a crosswalk")
        return code_categories(levels, key, crosswalk).select(key, F.lit("icd").alias("block"), "term")
    if granularity == "stack":
        return levels.select(key, F.concat(F.lit("icd_"), "level").alias("block"), "term")
    wanted = levels if granularity == "ancestors" else levels.where(F.col("level") == granularity)
    return wanted.select(key, F.lit("icd").alias("block"), "term").distinct()


def code_blocks(granularity: str) -> list[str]:
    return [f"icd_{x}" for x in LEVELS] if granularity == "stack" else ["icd"]


class CodeView:
    """Blocks of terms as features: a vocabulary for each block, fitted on training rows, and a count and a flag of all terms.

    terms are (key, block, term) rows, each once; blocks stay apart, so a term of two blocks is two features.
    """

    def __init__(self, key: str, blocks: list[str], min_df: int = 10):
        self.key, self.blocks, self.min_df = key, blocks, min_df

    def fit(self, terms: DataFrame) -> CodeView:
        """Terms of at least min_df keys are kept."""
        self.vocabulary = terms.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= self.min_df)
        return self

    def transform(self, keys: DataFrame, terms: DataFrame) -> DataFrame:
        """(key, feature, value): block__term 1 for each known term; n_block_terms and has_block for every key, terms unknown too."""
        known = terms.join(self.vocabulary.select("block", "term"), ["block", "term"]).select(self.key, F.concat_ws("__", "block", "term").alias("feature"), F.lit(1.0).alias("value"))
        own = terms.groupBy(self.key, "block").agg(F.count(F.lit(1)).cast("double").alias("n"))
        cells = keys.select(self.key).distinct().select(self.key, F.explode(F.array(*map(F.lit, self.blocks))).alias("block"))
        counted = cells.join(own, [self.key, "block"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
        pairs = F.array(F.struct(F.concat(F.lit("n_"), "block", F.lit("_terms")).alias("feature"), F.col("n").alias("value")), F.struct(F.concat(F.lit("has_"), "block").alias("feature"), (F.col("n") > 0).cast("double").alias("value")))
        return known.unionByName(counted.select(self.key, F.inline(pairs)))


def code_vocabulary(levels: DataFrame, key: str, min_df: int = 10) -> DataFrame:
    """(level, term, df) of the terms that at least min_df records have."""
    return levels.groupBy("level", "term").agg(F.countDistinct(key).alias("df")).where(F.col("df") >= min_df)


def ancestors(levels: DataFrame, key: str) -> DataFrame:
    """(key, terms): all levels of a record's codes as one set, in order."""
    return levels.groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws(":", "level", "term"))).alias("terms"))


def retained(levels: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, level, n, kept): how many of a record's terms the vocabulary has."""
    known = vocabulary.select("level", "term", F.lit(1).alias("_in"))
    return levels.join(known, ["level", "term"], "left").groupBy(key, "level").agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("kept"))


def rare_common(train: DataFrame, test: DataFrame, keys: DataFrame, key: str, least: int = 20) -> DataFrame:
    """(key, rarest, part) of every key: in how many training records its rarest term occurs, and whether that is rare or common.

    train and test are (key, term) rows. Rare is up to the median of the keys with terms, common above it. part is null for a key
    without terms, and for all keys where fewer than `least` have terms.
    """
    known = train.where("term is not null").groupBy("term").agg(F.countDistinct(key).alias("_df"))
    own = test.where("term is not null").join(known, "term", "left").groupBy(key).agg(F.min(F.coalesce("_df", F.lit(0))).alias("rarest"))
    middle = own.agg(F.when(F.count(F.lit(1)) >= least, F.percentile("rarest", 0.5)).alias("_m"))  # one row
    part = F.when(F.col("rarest") <= F.col("_m"), "rare").when(F.col("rarest") > F.col("_m"), "common")
    return keys.select(key).distinct().join(own, key, "left").crossJoin(F.broadcast(middle)).select(key, "rarest", part.alias("part"))


def nested_rows(df: DataFrame, node: Column, child: str = "diag") -> list[DataFrame]:
    """(parent, code, descriptor) frames of a column of nested nodes, one for each level that its type has; a level may be a struct or an array of them."""
    out, level, parent = [], df.select(node.alias("n"), F.lit(None).cast("string").alias("parent")), None
    while True:
        kind = level.schema["n"].dataType
        if kind.typeName() == "array":
            level, kind = level.select(F.explode("n").alias("n"), "parent"), kind.elementType
        level = level.where("n is not null").select("n", "parent", F.upper(F.trim("n.name")).alias("code"))
        parent = level.select("parent", "code", F.trim("n.desc").alias("descriptor") if "desc" in kind.names else F.lit(None).cast("string").alias("descriptor"))
        out.append(parent)
        if child not in kind.names:
            return out
        level = level.select(F.col(f"n.{child}").alias("n"), F.col("code").alias("parent"))

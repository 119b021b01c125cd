"""Cells of a benchmark: labels, splits and subsets of a training and a test table, and records assembled from many tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.registry_tables import class_codes
from evalloom.operators.splits import stratified_split


@dataclass
class Cell:
    """Frames with the key, features and y; test has _pos, its row's place, where a subset gives the order. classes is (label, y)."""

    train: DataFrame
    valid: DataFrame
    test: DataFrame
    classes: DataFrame | None


def encoded_labels(train: DataFrame, test: DataFrame, label: str, binary: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """train and test with y. Binary: the number, 0 where there is none, kept within 0 and 1. Else the training labels in order of
    their text; test rows of another class are left out."""
    if binary:
        value = F.least(F.greatest(F.coalesce(F.col(label).cast("string").try_cast("double").cast("int"), F.lit(0)), F.lit(0)), F.lit(1))
        with_y = lambda df: df.withColumn("_y", value).drop(label).withColumnRenamed("_y", "y")
        return with_y(train), with_y(test), None
    text = F.coalesce(F.col(label).cast("string"), F.lit("nan")).alias("_label")
    classes = class_codes(train.select(text), "_label", "y")
    with_y = lambda df: df.withColumn("_label", text).drop(label).join(classes, "_label").drop("_label")
    return with_y(train), with_y(test), classes.withColumnRenamed("_label", "label")


def in_given_order(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted (key, _pos) with their place; a wanted key without a row is an error that names some of them."""
    placed = wanted.select(key, "_pos").join(df.withColumn("_there", F.lit(True)), key, "left")
    lost = placed.where("_there is null").select(key)
    some = [r[0] for r in lost.limit(3).collect()]
    if some:
        raise ValueError(f"{lost.count()} of the subset's keys aren't in the table, such as {some}")
    return placed.drop("_there")


def load_cell(train: DataFrame, test: DataFrame, key: str, label: str, binary: bool, valid_share: float = 0.2, seed: str = "cell", subset: DataFrame | None = None, most_train: int | None = None, most_test: int | None = None) -> Cell:
    """A cell from its two tables: labels encoded, the training rows split by label in hash order, the test rows all, the first
    `most_test` by key, or those of `subset`, (key, _pos), in its order."""
    train, test, classes = encoded_labels(train, test, label, binary)
    if most_train is not None:
        train = train.orderBy(key).limit(most_train)
    if subset is not None:
        test = in_given_order(test, key, subset)
    elif most_test is not None:
        test = test.orderBy(key).limit(most_test)
    dealt = stratified_split(train, key, "y", valid_share, seed)
    return Cell(dealt.where("split = 'train'").drop("split"), dealt.where("split = 'valid'").drop("split"), test, classes)


#: What a column of a record can be of a table's rows of its key, and the aggregate that makes it of the rows of all tables.
SHAPES = ("one", "count", "joined", "listed", "first")


@dataclass(frozen=True)
class Part:
    """A table's share in a record: columns name -> (shape, value). one: the value of its only row; count: rows where the value is
    true; joined: distinct values in order; listed: values in order of `position`; first: the least value."""

    table: DataFrame
    columns: dict[str, tuple[str, Column]]
    position: Column | None = None


def assembled(keys: DataFrame, key: str, parts: list[Part], mark: str = "; ") -> DataFrame:
    """keys (key, _pos) with all parts' columns, a row a key: what a key has no row for is null, or 0 for counts.

    The tables' rows are put under one another, each with the values it gives, and one aggregate by key makes the record. So
    there is one exchange however many tables there are, counts and sets are reduced before it, and rows of other keys fall out.
    """
    rows, aggregates = keys.select(key, "_pos"), [F.max("_pos").alias("_pos")]
    for part in parts:
        values = {}
        for name, (shape, value) in part.columns.items():
            if shape not in SHAPES:
                raise ValueError(f"no shape {shape!r}, there are {', '.join(SHAPES)}")
            values[name] = value.cast("boolean") if shape == "count" else F.struct(part.position.alias("p"), value.alias("v")) if shape == "listed" else value
            col = F.col(f"`{name}`")
            made = {
                "one": F.max(col),
                "first": F.min(col),
                "count": F.count(F.when(col, 1)),
                "joined": F.when(F.count(col) > 0, F.array_join(F.array_sort(F.collect_set(col)), mark)),
                "listed": F.transform(F.array_sort(F.collect_list(col)), lambda s: s["v"]),
            }
            aggregates.append(made[shape].alias(name))
        rows = rows.unionByName(part.table.select(key, *[v.alias(n) for n, v in values.items()]), allowMissingColumns=True)
    return rows.groupBy(key).agg(*aggregates).where("_pos is not null")

"""Runs a grid of cells: load, view, fit, score, write predictions, resample and record, with a status for whatever happens.

A cell's record is written whole under its own name when the cell has ended, so a grid that stops goes on with the cells that
have none. A record made with another view or granularity is refused, since two settings in one folder can't be told apart later.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.scalars import path_safe_name
from evalloom.operators import bootstrap, ranking
from evalloom.operators.cells import Cell
from evalloom.operators.codes import CodeView, code_blocks
from evalloom.operators.features import Featurizer, StackedView
from evalloom.plans.methods import METHODS, Skipped, fitted_scores
from evalloom.sources import stores, tables
from evalloom.storage import cut

#: The views a method can be given, and what became of a cell.
VIEWS = ("tabular", "tabular+codes", "codes")
STATUSES = ("ok", "skipped", "no_data", "error")


@dataclass
class Grid:
    """A results folder and how its cells are made.

    load(task, phase, seed) gives a cell of two classes keyed by `key`; terms(df), for views with codes, gives (key, block, term) rows.
    """

    root: str
    load: Callable[[str, str, int], Cell]
    view: str = "tabular"
    granularity: str = "char3"
    terms: Callable[[DataFrame], DataFrame] | None = None
    key: str = "id"
    draws: int = 1000
    min_df: int = 10
    featurizer: dict = field(default_factory=dict)

    def path(self, task: str, phase: str, method: str, seed: int) -> str:
        return f"{self.root}/runs/{path_safe_name('__'.join((task, phase, method, f'seed{seed}')))}.json"

    def settings(self) -> dict:
        return {"feature_view": self.view, "icd_granularity": self.granularity if "codes" in self.view else None}

    def vectors(self, cell: Cell) -> tuple[dict[str, DataFrame], int]:
        """(id, y, raw) of each part, the view fitted on the training rows, and the number of features."""
        if self.view not in VIEWS:
            raise ValueError(f"no view {self.view!r}, there are {', '.join(VIEWS)}")
        parts = {"train": cell.train, "valid": cell.valid, "test": cell.test.drop("_pos")}
        labels = {name: df.select(F.col(self.key).alias("id"), "y") for name, df in parts.items()}
        made = Featurizer(self.key, "y", **self.featurizer).fit(cell.train) if "tabular" in self.view else None
        if self.view == "tabular":
            names = made.names()
            raw = {name: made.transform(df).select(F.col(self.key).alias("id"), array_to_vector(F.array(*[F.col(f"`{c}`") for c in names])).alias("raw")) for name, df in parts.items()}
            return {name: labels[name].join(raw[name], "id") for name in parts}, len(names)
        terms = {name: cut(self.terms(df), "terms") for name, df in parts.items()}
        codes = CodeView(self.key, code_blocks(self.granularity), self.min_df).fit(terms["train"])
        blocks = {name: {"codes": codes.transform(df, terms[name])} for name, df in parts.items()}
        if made is not None:
            long = lambda df: made.transform(df).unpivot([self.key], made.names(), "feature", "value")
            blocks = {name: {"tabular": long(parts[name]), **blocks[name]} for name in parts}
        stacked = StackedView(self.key).fit(blocks["train"])
        raw = {name: stacked.transform(df, blocks[name]).select(F.col(self.key).alias("id"), F.col("features").alias("raw")) for name, df in parts.items()}
        return {name: labels[name].join(raw[name], "id") for name in parts}, stacked.size

    def run_cell(self, spark: SparkSession, task: str, phase: str, method: str, seed: int) -> dict:
        """The record of one cell that went well; its predictions are written."""
        cell, start = self.load(task, phase, seed), time.time()
        METHODS[method](1.0)  # one that can't run says so before anything is fitted
        parts, n_features = self.vectors(cell)
        train = cut(parts["train"], "train")
        asked = parts["valid"].withColumn("split", F.lit("valid")).unionByName(parts["test"].withColumn("split", F.lit("test")))
        scored = fitted_scores(method, train, asked, [StandardScaler(inputCol="raw", outputCol="features", withMean=self.view == "tabular")])
        found = cut(asked.select("id", "y", "split").join(scored, "id"), "scored")
        seconds = time.time() - start
        name = {"task": task, "phase": phase, "method": method, "seed": seed}
        tables.write_predictions(found.withColumns({k: F.lit(v) for k, v in name.items()}), f"{self.root}/predictions")
        test = found.where("split = 'test'").select("id", "y", F.round("proba", 12).alias("proba"))
        point = ranking.ranking_metrics(test, [], "proba", "y").first()
        flat = ranking.threshold_metrics(test, [], (F.col("proba") >= 0.5).cast("int"), "y").first().asDict()
        draws = bootstrap.resampled(test, "id", "proba", "y", self.draws, f"cell{seed}")
        ends = {m: bootstrap.interval(draws, c).select("mean", "lo", "hi", "std").first().asDict() for m, c in (("prauc", "ap"), ("auroc", "auroc"))}
        counts = {"n_train": train.count(), "n_test": test.count()}
        return name | counts | self.settings() | {"task_type": "binary", "num_classes": 2, "n_features": n_features, "fit_secs": round(seconds, 2), "headline": "prauc", "point": {"prauc": point["ap"], "auroc": point["auroc"]} | flat, "bootstrap": ends, "status": "ok"}

    def recorded(self, spark: SparkSession, task: str, phase: str, method: str, seed: int) -> dict:
        """run_cell's record, or one that says why there is none."""
        name = {"task": task, "phase": phase, "method": method, "seed": seed}
        try:
            return self.run_cell(spark, task, phase, method, seed)
        except (Skipped, NotImplementedError, ImportError) as why:
            return name | {"status": "skipped", "reason": f"{type(why).__name__}: {why}"}
        except FileNotFoundError as why:
            return name | {"status": "no_data", "reason": str(why)}
        except Exception as why:  # a cell that fails doesn't stop the grid
            return name | {"status": "error", "reason": f"{type(why).__name__}: {why}"[:2000]}

    def run(self, spark: SparkSession, specs: list[tuple[str, str, str, int]]) -> list[str]:
        """Runs the (task, phase, method, seed) cells that have no record; gives the statuses of those that it ran."""
        ran = []
        for spec in specs:
            path = self.path(*spec)
            old = stores.record(spark, path)
            if old is not None:
                if old["status"] == "ok" and any(k in old and old[k] != v for k, v in self.settings().items()):
                    raise ValueError(f"{path} was made with {({k: old.get(k) for k in self.settings()})}, not {self.settings()}")
                continue
            rec = self.recorded(spark, *spec)
            stores.put_record(spark, path, rec)
            ran.append(rec["status"])
        return ran

    def records(self, spark: SparkSession) -> DataFrame:
        return tables.run_records(spark, f"{self.root}/runs")

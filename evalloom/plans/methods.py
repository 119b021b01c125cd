"""A registry of learners on Spark ML. A learner that isn't installed is registered and says that it was skipped."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.scalars import mask_phrases_of
from evalloom.operators.audit import nearest_euclidean
from evalloom.operators.features import column_scales, fit_idf, gram_counts, numbered_terms, sparse_vectors, tfidf
from evalloom.operators.probes import AveragePrecision, tuned
from evalloom.operators.splits import hash_rank
from evalloom.storage import cut

METHODS: dict[str, Callable[[float], object]] = {}


class Skipped(Exception):
    """The method can't run here."""


def register(name: str):
    def add(make):
        if name in METHODS:
            raise ValueError(f"{name} is registered twice")
        METHODS[name] = make
        return make

    return add


@register("majority")
def majority(weight: float):
    return None


@register("logreg_l2")
def logreg_l2(weight: float):
    return LogisticRegression(labelCol="y", weightCol="weight", elasticNetParam=0.0, regParam=1 / weight, standardization=False)


@register("logreg_l1")
def logreg_l1(weight: float):
    return LogisticRegression(labelCol="y", weightCol="weight", elasticNetParam=1.0, regParam=1 / weight, standardization=False)


@register("random_forest")
def random_forest(weight: float):
    return RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=400, seed=0)


@register("hist_gbm")
def hist_gbm(weight: float):
    return GBTClassifier(labelCol="y", maxIter=300, stepSize=0.1, seed=0)


@register("svm_linear")
def svm_linear(weight: float):
    return LinearSVC(labelCol="y", weightCol="weight", regParam=1 / weight, maxIter=100, tol=1e-4)


for _absent in ("extra_trees", "xgboost", "lightgbm", "catboost", "tabnet", "ft_transformer", "tabpfn", "clinical_bert_finetuned", "clinical_embeddings"):

    @register(_absent)
    def absent(weight: float, name: str = _absent):
        raise Skipped(f"{name} is not installed")


def balanced(train: DataFrame) -> DataFrame:
    """Weights that give both classes the same total."""
    total = Window.partitionBy(F.lit(0))
    counts = train.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    weights = counts.select("y", (F.sum("_n").over(total) / (F.count(F.lit(1)).over(total) * F.col("_n"))).alias("weight"))
    return train.join(F.broadcast(weights), "y")  # two rows


def platt(train: DataFrame, margin_stages: Callable[[DataFrame], Pipeline], folds: int = 3):
    """A logistic fit of y on margins that each row got from a model of the other folds."""
    dealt = hash_rank(train, ["y"], "platt", "id").withColumn("_fold", F.col("_rank") % folds).drop("_rank")
    rows = [margins(margin_stages(balanced(part)).transform(dealt.where(F.col("_fold") == k))) for k in range(folds) for part in [dealt.where(F.col("_fold") != k)]]
    stages = [VectorAssembler(inputCols=["m"], outputCol="margin"), LogisticRegression(labelCol="y", featuresCol="margin", rawPredictionCol="r", probabilityCol="p", predictionCol="q")]
    return Pipeline(stages=stages).fit(reduce(DataFrame.unionByName, [r.select("m", "y") for r in rows]))


def margins(df: DataFrame) -> DataFrame:
    return df.withColumn("m", vector_to_array("rawPrediction")[1])


def scores(name: str, df: DataFrame, inputs: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """(id, proba) of the rows that aren't trained on: every fifth id. An SVM's margins are calibrated out of fold."""
    train, test = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    return fitted_scores(name, train, test, [VectorAssembler(inputCols=list(inputs), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)])


def fitted_scores(name: str, train: DataFrame, rows: DataFrame, prepare: list) -> DataFrame:
    """(id, proba) of `rows` by a learner that is fitted on `train` (id, y and what the prepare stages make `features` of)."""
    learner = METHODS[name](float(max(1, train.count())))
    if learner is None:
        prior = train.agg(F.avg("y").alias("proba"))
        return rows.select("id").crossJoin(F.broadcast(prior))  # one row
    fit = Pipeline(stages=[*prepare, learner]).fit
    model = fit(balanced(train))
    if name != "svm_linear":
        return model.transform(rows).select("id", vector_to_array("probability")[1].alias("proba"))
    fitted = platt(train, fit)
    return fitted.transform(margins(model.transform(rows)).select("id", "m")).select("id", vector_to_array("p")[1].alias("proba"))


#: Which text a text learner reads, from a record's text and the phrases that name its condition.
TEXT_VIEWS: dict[str, Callable[[Column, Column], Column]] = {
    "tfidf_logreg": lambda text, phrases: text,
    "disease_text_only": lambda text, phrases: F.concat_ws(" ", phrases),
    "disease_blind": lambda text, phrases: mask_phrases_of(text, phrases, " "),
}


def text_scores(df: DataFrame, key: str, text: str, label: str, view: str = "tfidf_logreg", phrases: str | None = None, terms: int = 50_000, train: DataFrame | None = None) -> DataFrame:
    """(key, proba) of every fifth key by a balanced logistic fit on the others' word and word-pair weights, in a view of the text.

    train, with the same columns, is fitted on instead where it is given: one reference for several cells.
    """
    named = F.col(phrases) if phrases else F.array().cast("array<string>")
    read = lambda d: d.select(key, F.col(label).alias("y"), TEXT_VIEWS[view](F.col(text), named).alias("_text"))
    fitted_on, asked = read(df.where(F.col(key) % 5 != 0) if train is None else train), read(df.where(F.col(key) % 5 == 0) if train is None else df)
    counts = cut(gram_counts(fitted_on, key, "_text"), "grams")
    n = fitted_on.count()
    vocabulary = cut(numbered_terms(fit_idf(counts, n, most=terms)), "terms")
    places = F.broadcast(vocabulary.select("term", "place"))  # at most `terms` rows

    def vectors(rows: DataFrame, grams: DataFrame) -> DataFrame:
        weights = tfidf(grams, vocabulary.select("term", "idf"), key, bounded=True).join(places, "term")
        return sparse_vectors(rows, weights, key, "place", "weight", terms)

    both = balanced(vectors(fitted_on, counts).join(fitted_on.select(key, "y"), key))
    model = LogisticRegression(labelCol="y", weightCol="weight", elasticNetParam=0.0, regParam=1 / float(max(1, n)), standardization=False).fit(both)
    tested = vectors(asked, gram_counts(asked, key, "_text"))
    return model.transform(tested).select(key, vector_to_array("probability")[1].alias("proba"))


def knn_scores(df: DataFrame, inputs: tuple[str, ...] = ("a", "b"), k: int = 25) -> DataFrame:
    """(id, proba): the share of class 1 among the k nearest training rows, inputs scaled by the training rows; ties go to the smaller id."""
    train, test = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    scales = {r["column"]: r for r in column_scales(train, list(inputs)).collect()}  # a row a column
    scaled = lambda d: d.select("id", F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(scales[c]["median"])) - scales[c]["mean"]) / scales[c]["std"] for c in inputs]).alias("v"))
    met = nearest_euclidean(scaled(test), scaled(train), "id", "v", k)
    votes = met.join(train.select(F.col("id").alias("other"), "y"), "other")
    return votes.groupBy("id").agg(F.avg("y").alias("proba"))


def tuned_scores(df: DataFrame, inputs: tuple[str, ...] = ("a", "b"), strengths: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """(id, proba) of every fifth id: a sparse logistic fit whose strength has the best AP on the next fifth."""
    part = lambda k: df.where(F.col("id") % 5 == k)
    train, valid, test = df.where("id % 5 > 1"), part(1), part(0)
    prepare = Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(train)
    ready = cut(prepare.transform(balanced(train)).select("y", "weight", "features"), "train")
    n = float(max(1, ready.count()))
    learner = LogisticRegression(labelCol="y", weightCol="weight", elasticNetParam=1.0, standardization=False)
    grid = [{learner.regParam: 1 / (c * n)} for c in strengths]
    model, _, _ = tuned(learner, grid, ready, cut(prepare.transform(valid).select("y", "features"), "valid"), AveragePrecision())
    return model.transform(prepare.transform(test)).select("id", vector_to_array("probability")[1].alias("proba"))

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashed presence of its words, the first letters of longer words, word pairs and pairs with
one word between, taken over the whole text. Per-coordinate rates and an L1 term leave few weights, which are what is
broadcast: at most DIM of them. The model is fitted in one task on a bounded sample of labelled rows (SAMPLE rows, the
first by a hash of their id); scoring reads every text where it lies.

Defined cases: a null or empty text has no feature and gets the intercept's score. A null label isn't learnt from; an
id with several labels counts as toxic if one says so. Without any label every score is 0. Rows that repeat are scored
alike, and of texts that repeat a labelled id the smallest is learnt from; an empty table gives an empty result; other columns pass or are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.shared import cut, small_batches

#: Hashed coordinates, the most labelled rows that a fit reads, and entries in a worker's dictionary of words.
DIM = 1 << 20
SAMPLE = 12_000
CACHE = 400_000
#: L1 strength, the best of 3 to 15 on a split of the rows that may be learnt from.
L1 = 10.0
#: A fit ends after a pass whose rows had this mean log loss or less, as they came up, or after PASSES.
LOSS = 0.005
PASSES = 20
#: Letters of a word's beginning that are a feature of their own.
STEM = 5
WORDS = re.compile(r"\w+").findall


class WordHashes(dict):
    """(hash of the word, hash of its beginning) of each word seen."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHE:
            self.clear()
        whole = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 1)
        self[word] = found = (whole, xxhash.xxh64_intdigest(word[:STEM].encode("utf-8", "replace"), 2) if len(word) > STEM else whole)
        return found


@cache
def word_hashes() -> WordHashes:
    return WordHashes()


def coordinates(text: str | None, dim: int = DIM) -> np.ndarray:
    """Hashed coordinates of the text's features, with repeats."""
    words = WORDS((text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    both = np.array(list(map(word_hashes().__getitem__, words)), np.uint64)
    h = both[:, 0]
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    skip = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    mixed = np.concatenate((h, both[:, 1], pair, skip)) * np.uint64(0xFF51AFD7ED558CCD)
    return (mixed >> np.uint64(64 - int(math.log2(dim)))).astype(np.int64)


def fit(texts: list[str], labels: list[int], alpha: float = 1.0, beta: float = 1.0, l1: float = L1, l2: float = 1.0, passes: int = PASSES, dim: int = DIM) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the texts in order: the coordinates with weight, their weights, the intercept."""
    z, n, bias, bias_n = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    rows = [np.unique(coordinates(x, dim)).astype(np.int32) for x in texts]
    for _ in range(passes):
        loss = 0.0
        for x, y in zip(rows, labels, strict=True):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + bias))))
            loss -= math.log(p if y else 1 - p)
            g = p - y
            after = np.sqrt(nx + g * g)
            z[x] = zx + g - (after - root) / alpha * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
        if loss <= LOSS * len(texts):
            break
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    kept = np.flatnonzero(w)
    return kept, w[kept], bias


def held_out(id_col: str) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from at most `sample` labelled documents that aren't held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    chosen = cut(known.orderBy(F.xxhash64("_id"), "_id").limit(sample), "labels")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    one_text = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    rows = one_text.select(F.xxhash64("_id").alias("_at"), "_id", "_text", "_y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = [], []
        for pdf in batches:
            x += pdf["_text"].tolist()
            y += pdf["_y"].astype(int).tolist()
        if x:
            place, weight, bias = fit(x, y)
            yield pd.DataFrame({"place": [-1, *place.tolist()], "weight": [bias, *weight.tolist()]})

    one = rows.repartition(1).sortWithinPartitions("_at", "_id", "_text")
    found = one.mapInPandas(run, "place long, weight double").toPandas()
    inner = found["place"] >= 0
    bias = float(found.loc[~inner, "weight"].iloc[0]) if len(found) else -math.inf
    return found.loc[inner, "place"].to_numpy(np.int64), found.loc[inner, "weight"].to_numpy(float), bias


def score_column(spark, text: Column, model: tuple[np.ndarray, np.ndarray, float], dim: int = DIM) -> Column:
    """Score of a text column, 0 to 1."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place, weight, bias = sent.value
        dense = np.zeros(dim)
        dense[place] = weight
        live = dense != 0
        for batch in texts:
            out = []
            for text in batch:
                x = coordinates(text, dim)
                total = dense[np.unique(x[live[x]])].sum() + bias
                out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, total)))) if bias > -math.inf else 0.0)
            yield pd.Series(out, dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from the threshold on)."""
    model = train(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(docs.sparkSession, F.col(text_col).cast("string"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs that score under the threshold, with all their columns."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(score_column(docs.sparkSession, F.col(text_col).cast("string"), model) < threshold)

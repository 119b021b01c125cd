"""Embedding near-dedup: int8 tile products with per-vector error bounds, full precision only where they can't decide.

Every vector is compared with every other one of its label. A label's vectors are dealt to tiles (pairs of blocks);
a tile multiplies int8 codes, adds the bound that the two quantisation errors allow, and recomputes in double only
the pairs that could reach the threshold. A tile sends on link counts and a spanning forest, never its pairs.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, and one with a null label
or id, links with nothing. Vectors of different lengths never link. Equal vectors of one label form one class before
the tiles, so copies cost one member. Rows that repeat an id count as vectors of their own. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.forest import unite
from evalloom.llm.shared import components, cut, tiles

#: Rows of one block; a task holds two blocks.
BLOCK = 2048
#: Pairs recomputed at once.
CHUNK = 65_536


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, the norms of scale * code and bounds on what the codes lose."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    kept = codes * scale[:, None]
    return codes, scale, np.linalg.norm(kept, axis=1), np.linalg.norm(unit - kept, axis=1) + 1e-12


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes; in float32 a sum of under 2**24 is exact, so up to 1,040 dimensions go at once."""
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1040):
        total += a[:, k : k + 1040].astype(np.float32) @ b[:, k : k + 1040].astype(np.float32).T
    return total


def tile_links(vectors: np.ndarray, side: np.ndarray, threshold: float):
    """Yields index arrays (i, j) with cosine >= threshold; with two sides only pairs across them."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    codes, scale, norm, lost = quantise(vectors)
    square = np.einsum("ij,ij->i", vectors, vectors)
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() and not side.all() else (np.arange(len(side)),) * 2
    within = left is right
    for k in range(0, len(left), 512):
        rows = left[k : k + 512]
        near = code_products(codes[rows], codes[right]) * scale[rows][:, None] * scale[right]
        near += norm[rows][:, None] * lost[right] + lost[rows][:, None] * norm[right] + lost[rows][:, None] * lost[right]
        x, y = np.nonzero(near >= threshold - 1e-9)
        i, j = rows[x], right[y]
        if within:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), CHUNK):
            a, b = i[c : c + CHUNK], j[c : c + CHUNK]
            cosine = np.einsum("ij,ij->i", vectors[a], vectors[b]) / np.sqrt(square[a] * square[b])
            yield a[cosine >= threshold], b[cosine >= threshold]


def link_tile(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "h"], ignore_index=True)
        copies, links, root = pdf["copies"].to_numpy(), np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        side = (pdf["_block"] == pdf["_hi"]).to_numpy() & (pdf["_lo"] != pdf["_hi"]).to_numpy()
        for i, j in tile_links(np.stack(pdf["vector"].to_numpy()).astype(np.float64), side, threshold):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            unite(root, i, j)
        out = pd.DataFrame({"rep": pdf["rep"], "h": pdf["h"], "links": links, "root": pdf["rep"].to_numpy()[root]})
        return out[links > 0]

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links (other vectors at or above the threshold), component_id, kept."""
    #: Floats stay floats until they are in a tile; adding 0 makes -0.0 equal to 0.0.
    kind = "float" if dict(df.dtypes)[vector_col] == "array<float>" else "double"
    whole = F.transform(F.col(vector_col), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("vector"))
    rows = rows.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    #: Two hashes stand for the vector where copies are gathered: 128 bits, within one label.
    rows = rows.withColumn("h", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(7), "vector"))
    classes = rows.where("ok").groupBy("label", "h", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("dim", F.size("vector")), "vectors")
    dealt = tiles(classes.select("label", "dim", "rep", "h", "copies", "vector"), ["label", "dim"], F.xxhash64("h", "rep"), block)
    found = dealt.groupBy("label", "dim", "_lo", "_hi").applyInPandas(link_tile(threshold), "rep long, h long, links long, root long")
    found = cut(found, "links")
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    known = classes.select("label", "h", "h2", "rep", "copies").join(linked, ["rep", "h"], "left").join(joined, F.col("rep") == F.col("id"), "left")
    known = known.where("copies > 1 or links is not null or component is not null")
    known = cut(known.select("label", "h", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component")), "classes")
    plain = rows.select("id", F.when(F.col("ok"), F.col("label")).alias("label"), "h", "h2")
    out = plain.join(known, ["label", "h", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

"""Highest cosines against all products, over blocks, slabs and the three ways in which a term's products are made."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_catalogue import DATA

from evalloom.operators import audit
from evalloom.plans import catalogue


def matrix(rows, terms, seed, often=1.0):
    """Unit rows whose terms are rare to common, some rows near copies of the one before."""
    rng = np.random.default_rng(seed)
    m = rng.random((rows, terms)) * (rng.random((rows, terms)) < often * np.linspace(0.002, 0.6, terms) ** 2)
    m[:, -1] += 0.01
    for k in range(3, rows, 4):
        m[k] = m[k - 1] + 0.1 * m[k] * (k % 8 == 3)
    return m / np.linalg.norm(m, axis=1)[:, None]


def as_packed(m):
    places = [np.flatnonzero(r) for r in m]
    return pa.table({"places": pa.array(places, pa.list_(pa.int64())), "values": pa.array([r[p] for r, p in zip(m, places, strict=True)], pa.list_(pa.float64())), "length": np.ones(len(m))})


def test_best_and_above_equal_all_products():
    q, c = matrix(400, 300, 1), np.concatenate([matrix(1500, 300, 2), matrix(400, 300, 1)[::5]])
    block, want = audit.QueryBlock.of(as_packed(q)), q @ c.T
    assert block.best(as_packed(c), rows=150) == pytest.approx(want.max(axis=1))
    for floor in (0.85, 0.6):
        top = want.max(axis=1)
        got = block.above(as_packed(c), floor, pairs=5000)
        assert got[top >= floor + 1e-9] == pytest.approx(top[top >= floor + 1e-9]) and np.isneginf(got[top < floor - 1e-9]).all() and (top >= floor).sum() > 50


def test_blocks_and_tables_of_few_rows(spark):
    m = matrix(120, 40, 3)
    rows = [(k, int(t), float(m[k, t])) for k in range(120) for t in np.flatnonzero(m[k])]
    v = audit.packed(spark.createDataFrame(rows, "id int, place long, w double").orderBy(F.rand(1)), "id", "place", "w").cache()
    want = {k: m[k] @ m[[j for j in range(120) if j % 3]].T for k in range(0, 120, 3)}
    for floor in (0.0, 0.7):
        got = {r["id"]: r["sim"] for r in audit.highest_cosines(v.where("id % 3 = 0"), v.where("id % 3 <> 0"), "id", floor, entries=100).collect()}
        assert got == pytest.approx({k: x.max() if x.max() >= floor else 0.0 for k, x in want.items()})
    assert audit.highest_cosines(v.where("id < 0"), v, "id").count() == 0
    assert [r["sim"] for r in audit.highest_cosines(v.where("id = 0"), v.where("id < 0"), "id").collect()] == [0.0]
    sizes = [(len(t), len(t.column("places").combine_chunks().flatten())) for t in audit.rows_of(as_packed(m).to_batches(max_chunksize=7), rows=10, entries=60)]
    assert sum(n for n, _ in sizes) == 120 and max(n for n, _ in sizes) <= 10 and all(e <= 60 or n == 1 for n, e in sizes)


@pytest.mark.parametrize("name", ["neardup_max_cosine", "dup_rate_by_threshold"])
def test_no_pair_is_a_row(spark, name):
    """Terms aren't joined with themselves: on 0.1 GB that was 6.9 billion rows."""
    plan = catalogue.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Join [term" not in plan

"""Neighbours in tables of several blocks, where a task of each pair of blocks has both sides, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_catalogue import plain

from evalloom.functions import scalars as C
from evalloom.operators import audit
from evalloom.plans import catalogue

TASKS = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng, at = np.random.default_rng(4), tmp_path_factory.mktemp("blocks")
    n, ids = 5000, np.arange(5000)
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(rng.normal(size=(n, 8)).astype("float32"))), "label": pa.array(rng.integers(0, 10, n), pa.int32())}), at / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": ids, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array(np.exp(rng.normal(6, 1.5, n)).astype("int64"))}), at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": ids, "quality": pa.array(rng.integers(0, 2, n), pa.int32())}), at / "labels.parquet")
    return at


@pytest.fixture
def many_tasks(spark):
    before = {k: spark.conf.get(k) for k in TASKS}
    for k, v in TASKS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def same_as_sql(spark, tables, name):
    df, con = catalogue.QUERIES[name](spark, str(tables)), duckdb.connect()
    for p in tables.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    theirs = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", ["topk_neighbors", "knn_vote", "mapping_agreement", "remapped_codes", "disagreement_sample"])
def test_matches_sql_over_blocks(many_tasks, tables, name):
    same_as_sql(many_tasks, tables, name)


def test_rounded_by_its_multiple(spark):
    (row,) = spark.range(1).select(*[C.half_up(F.lit(x), 7).alias(n) for n, x in (("a", 0.40218075), ("b", 0.5), ("c", -0.00000015), ("d", None))]).collect()
    assert tuple(row) == (0.4021807, 0.5, *duckdb.sql("select round(-0.00000015::double, 7)").fetchall()[0], None)


def test_reply_parse_beside_other_letters(spark, tmp_path):
    said = ["Señor.\nNoñas", "ñno", "nó", "İno", "İ no", "NO x", "no_", "٣yes", "yes, nó", "yeſ", "know", "1no", "no‍", "No. 1,204.5", "", None]
    pq.write_table(pa.table({"conv_id": range(len(said)), "turn": [1] * len(said), "text": said}), tmp_path / "conversations.parquet")
    same_as_sql(spark, tmp_path, "reply_parse")


def test_knn_scores(many_tasks, tables):
    same_as_sql(many_tasks, tables, "knn_scores")


def test_far_rows_keep_the_digits_of_their_distances():
    a, b = np.array([[3e4 + 0.25, 1.0]]), np.array([[3e4, 1.0], [3e4 + 0.5, 1.0 + 1e-4], [3e4 + 0.25, 1.0]])
    assert audit.less_distance(a, b)[0] == pytest.approx([-0.0625, -0.0625 - 1e-8, 0.0], abs=1e-11)

"""Mappings, rare terms, gains and combiners on cases that the tables don't have, and a leaderboard that reads what it must."""

import json
import math

from pyspark.sql import functions as F

from evalloom.operators import codes, mapping, ranking, runs, splits
from evalloom.plans import methods
from evalloom.sources import tables
from evalloom.streaming.leaderboard import incremental, latest

VECTOR = "array<double>"


def test_nearest_codes(spark):
    terms = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 2.0]), ("tie", [1.0, 1.0]), ("zero", [0.0, 0.0]), ("none", None), ("C1", [0.0, 1.0]), ("a", [1.0, 0.1])], f"term string, v {VECTOR}")
    index = spark.createDataFrame([("C1", [0.0, 5.0]), ("C2", [3.0, 0.0]), ("C3", [3.0, 0.0]), (None, [1.0, 1.0])], f"code string, v {VECTOR}")
    found = {r["term"]: r["code"] for r in mapping.nearest_codes(terms, index, "term", "code", "v", block=2).collect()}
    assert found == {"a": "C2", "b": "C1", "tie": "C1", "C1": "C1"}  # a term may be spelled as a code is
    assert mapping.nearest_codes(terms, index.limit(0), "term", "code", "v").count() == 0


def test_agreement(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, level string, term string")
    a = rows((1, "x", "p"), (1, "x", "q"), (1, "x", "q"), (2, "x", "p"), (3, "x", None), (4, "y", "p"))
    b = rows((1, "x", "q"), (1, "x", "r"), (2, "x", "p"), (5, "x", "p"))
    found = {(r["k"], r["level"]): (r["n_first"], r["n_second"], r["n_both"], r["jaccard"]) for r in mapping.agreement(a, b, "k").collect()}
    assert found == {(1, "x"): (2, 2, 1, 1 / 3), (2, "x"): (1, 1, 1, 1.0), (4, "y"): (1, 0, 0, 0.0), (5, "x"): (0, 1, 0, 0.0)}


def test_disagreement_sample(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 5 / F.lit(4.0)).alias("j"))
    rows = mapping.disagreement_sample(df, "k", "j", 40, "s").collect()
    assert len(rows) == 40 and {r["j"] for r in rows} == {0.0, 0.25, 0.5, 0.75}
    assert all(len([r for r in rows if r["bin"] == b]) == 10 for b in range(4))
    assert mapping.disagreement_sample(df.where("k % 5 = 4"), "k", "j", 40, "s").count() == 0
    few = mapping.disagreement_sample(df, "k", "j", 2, "s").collect()
    assert len(few) == 2
    tables.write_adjudication(mapping.disagreement_sample(df, "k", "j", 8, "s").withColumn("term", F.lit("Sjögren, a \"b\"")), str(tmp_path / "s"))
    back = spark.read.options(header=True, escape='"').csv(str(tmp_path / "s"))
    assert back.columns[-1] == "adjudication_note" and back.where("adjudication_note is null").count() == 8
    assert {r["term"].replace("\\", "") for r in spark.read.options(header=True).csv(str(tmp_path / "s")).collect()} == {'Sjögren, a "b"'}


def test_rare_and_common(spark):
    train = spark.createDataFrame([(k, t) for k in range(10) for t in ("a", "b", "a")[: 1 + k % 3]], "k int, term string")
    keys = spark.range(100, 131).select(F.col("id").cast("int").alias("k"))
    test = keys.where("k < 130").select("k", F.when(F.col("k") % 3 == 0, "a").when(F.col("k") % 3 == 1, "b").otherwise("new").alias("term"))
    found = {r["k"]: (r["rarest"], r["part"]) for r in codes.rare_common(train, test, keys, "k").collect()}
    assert found[102] == (10, "common") and found[100] == (6, "rare") and found[101] == (0, "rare") and found[130] == (None, None) and len(found) == 31
    assert {r["part"] for r in codes.rare_common(train, test, keys, "k", least=31).collect()} == {None}


def test_gains_and_joint_scores(spark):
    run = lambda *r: spark.createDataFrame(list(r), "cell string, m string, seed int, ap double")
    pre = run(("c", "a", 0, 0.5), ("c", "a", 1, 0.5), ("c", "b", 0, 0.4), ("d", "a", 0, 0.3), ("e", "a", 0, None))
    post = run(("c", "a", 0, 0.6), ("c", "a", 1, 0.8), ("c", "b", 0, 0.2), ("c", "b", 9, 0.9), ("d", "a", 0, 0.3), ("e", "a", 0, 0.5))
    floors = spark.createDataFrame([("c", 0.01)], "cell string, floor double")
    found = {r["cell"]: r for r in runs.gain_by_cell(pre, post, ["cell"], "m", "seed", "ap", floors).collect()}
    assert set(found) == {"c", "d"} and math.isclose(found["c"]["gain"], 0.0, abs_tol=1e-12) and found["c"]["n_pairs"] == 3
    assert found["c"]["exceeds"] is False and found["d"]["exceeds"] is None
    both = runs.scored_by_all(post, ["cell", "seed"], "m", "ap", ["a", "b"]).collect()
    assert [tuple(r) for r in both] == [("c", 0, 0.6, 0.2)]


def test_combiner(spark):
    """Two scores that are each wrong about one positive; their mean puts both on top."""
    rows = [("g", 1.0, 0.2, 1), ("g", 0.2, 1.0, 1), ("g", 0.5, 0.1, 0), ("g", 0.1, 0.5, 0), ("none", 0.5, 0.5, 0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int")
    (found,) = ranking.combiner_lifts(df, df, ("g",), "a", "b", "y", steps=10).where("g = 'g'").collect()
    assert math.isclose(found["source"], (1 + 2 / 3) / 2, abs_tol=1e-9) and math.isclose(found["fixed"], 1 - found["source"], abs_tol=1e-9)
    assert found["fixed"] == found["tuned"] == found["oracle"] and math.isclose(found["captured"], 100.0) and 0 < found["width"] < 1


def test_ranks_in_sections(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    rows = splits.hash_rank(df, ["g"], "s", "k").orderBy(F.sha2(F.concat(F.lit("s|"), F.col("k").cast("string")), 256)).collect()
    assert all([r["_rank"] for r in rows if r["g"] == g] == list(range(1, 1001)) for g in range(3))


def test_leaderboard_reads_touched_buckets_only(spark, tmp_path):
    source, paths = tmp_path / "in", [str(tmp_path / n) for n in ("store", "out", "state")]
    source.mkdir()

    def arrive(name, *records):
        lines = [json.dumps(dict(zip(("method", "cell", "seed", "prauc"), r, strict=True))) for r in records]
        (source / f"{name}.json").write_text("\n".join(lines))
        incremental(spark, str(source), *paths).awaitTermination()
        return {r["method"]: (r["mean"], r["n_cells"]) for r in latest(spark, paths[1]).collect()}

    bucket = {c: spark.range(1).select(F.pmod(F.xxhash64(F.lit(c)), F.lit(64))).first()[0] for c in "cd"}
    assert bucket["c"] != bucket["d"]
    assert arrive("0", ("a", "c", 0, 0.4), ("b", "c", 0, 0.5), ("a", "d", 0, 0.2), ("b", "d", 0, 0.6), ("a", "c", 0, 0.3)) == {"a": (0.30000000000000004, 2), "b": (0.55, 2)}
    for f in (tmp_path / "store/runs/batch=0" / f"bucket={bucket['c']}").glob("*"):
        f.unlink()
    (tmp_path / "store/runs/batch=0" / f"bucket={bucket['c']}" / "x.parquet").write_text("not to be read")
    assert arrive("1", ("a", "d", 0, 0.8), ("a", "d", 1, 0.4)) == {"a": (0.5, 2), "b": (0.55, 2)}
    assert arrive("2") == {"a": (0.5, 2), "b": (0.55, 2)}


def test_a_reference_stays_as_it_was_fitted(spark):
    """A text's score doesn't depend on which others are scored with it; texts of no known word are scored too."""
    train = spark.createDataFrame([(k, "cell%d good words here" % (k % 3) if k % 2 else "cell%d bad signs there" % (k % 3), k % 2) for k in range(60)], "k int, text string, y int")
    arms = spark.createDataFrame([(1, "good words", None), (2, "bad signs", None), (3, "unknown", None), (4, None, None)], "k int, text string, y int")
    score = lambda df: {r["k"]: round(r["proba"], 9) for r in methods.text_scores(df, "k", "text", "y", train=train).collect()}
    every, one = score(arms), score(arms.where("k = 1"))
    assert set(every) == {1, 2, 3, 4} and every[1] == one[1] and every[1] > every[3] > every[2] and every[3] == every[4]

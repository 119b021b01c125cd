import numpy as np
from pyspark.sql import functions as F

from evalloom.llm import line_dedup


def long_lines(spark):
    """60 lines of 50 to 190 of 400 words: pairs share some of their rarest words, few are similar; each tenth is a near copy."""
    rng, words = np.random.default_rng(3), np.array([f"w{k}" for k in range(400)])
    lines = [list(rng.choice(words, int(rng.integers(50, 190)), replace=False)) for _ in range(60)]
    lines += [[*x[3:], "other", f"own{k}"] for k, x in enumerate(lines[::10])]
    return [(k, " ".join(x)) for k, x in enumerate(lines)]


def similar(a, b):
    a, b = set(a.split()), set(b.split())
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def test_words_are_made_once(spark):
    """No filter that Spark infers makes the words, the lines or a tile's links a second time."""
    docs = spark.createDataFrame([(1, "a b c d e\nf g"), (2, None)], "doc_id long, text string")
    classes = line_dedup.split_lines(docs, "doc_id", "text").select("line").withColumn("cid", F.monotonically_increasing_id())
    rows = line_dedup.prefixes(classes, line_dedup.rarity_table(classes), (4, 5))
    for df, made in ((rows, "array_distinct("), (classes, "split(")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(made) == 1


def test_unlike_long_lines_leave_no_candidates(spark):
    rows = long_lines(spark)
    classes = spark.createDataFrame(rows, "cid long, line string")
    found = line_dedup.with_candidates(line_dedup.prefixes(classes, line_dedup.rarity_table(classes), (4, 5)), (4, 5))
    linked = {i for i, x in rows for j, y in rows if i != j and similar(x, y)}
    assert len(linked) == 12 and {r["cid"] for r in found.collect()} == linked


def test_long_lines_match_brute_force(spark):
    rows = long_lines(spark)
    got = {r["doc_id"]: (r["first_id"], r["n_links"], r["removed"]) for r in line_dedup.judge_lines(spark.createDataFrame([*rows, (100, rows[0][1])], "doc_id long, text string")).collect()}
    want = {i: (i, sum(i != j and similar(x, y) for j, y in rows), any(j < i and similar(x, y) for j, y in rows)) for i, x in rows}
    assert got == want | {100: (0, want[0][1], True)}

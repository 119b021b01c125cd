"""Code trees, cells, probes, decision tables and stores on the cases that the queries' tables don't have."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from evalloom.functions import scalars as C
from evalloom.operators import cells, codes, decisions, elicitation, features, probes, registry_tables, splits
from evalloom.plans import catalogue, runner
from evalloom.sources import stores

DATA = "/root/testdata/sf0.001"
#: Booleans of which one value is right on any table of this kind, and learners, which take long.
ONE_VALUE = {"wide_records"}
SLOW = {"hist_gbm_scores", "random_forest_scores", "svm_linear_scores", "logreg_l1_scores", "logreg_l2_scores", "grid_cells"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_no_query_is_hollow(spark, name):
    """Every query has rows, and booleans of its rows have both values where there are enough of them."""
    df = catalogue.QUERIES[name](spark, DATA)
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, BooleanType)]
    found = df.agg(F.count(F.lit(1)), *[F.count_distinct(c) for c in flags]).first()
    assert found[0] > 0
    if found[0] >= 40 and name not in ONE_VALUE:
        assert all(n > 1 for n in found[1:]), flags


def test_literals_are_terms():
    assert C.parse_terms("('a', ['b', \"('c',)\"])") == ["a", "b", "c"] and C.parse_terms("'Asthma'") == ["Asthma"]
    assert C.parse_terms("12") == ["12"] and C.parse_terms("[None, 'nan', '', 'x']") == ["x"] and C.parse_terms(" [] ") == [] and C.parse_terms("[broken") == ["[broken"]


def test_repeated_records_and_plans(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    records = spark.createDataFrame([(1, None, "late"), (1, '{"probability": 30}', None), (1, '{"probability": 20}', None), (2, None, "a"), (2, None, "b")], "k int, body string, error string")
    got = {r["k"]: (r["status"], r["proba"]) for r in elicitation.reassembled(asked, records, "k", "body", "error").collect()}
    assert got == {1: ("ok", 0.3), 2: ("error", 0.5), 3: ("missing", 0.5)}
    grid = spark.createDataFrame([("a", 5), ("b", 4), ("c", 6), ("d", 1)], "cell string, n int")
    plan = spark.createDataFrame([("a", 5), ("a", 5), ("b", 5), ("c", 5)], "cell string, n int")
    broken = lambda default: {r["cell"] for r in elicitation.unregistered(grid, plan, ["cell"], "n", default).collect()}
    assert broken(None) == {"b", "c", "d"} and broken(1) == {"b", "c"}


def test_code_trees(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("b", "a")], "code string, parent string")
    assert {(r["code"], r["depth"], r["root"], tuple(r["path"])) for r in codes.tree_levels(nodes).collect()} == {("a", 0, "a", ("a",)), ("b", 1, "a", ("a", "b")), ("c", 2, "a", ("a", "b", "c")), ("d", 0, "d", ("d",))}
    with pytest.raises(ValueError, match="circle"):
        codes.tree_paths(spark.createDataFrame([("a", "b"), ("b", "a")], "code string, parent string"), deepest=5)
    assert codes.tree_paths(nodes.limit(0)).count() == 0
    with pytest.raises(ValueError, match="granularity"):
        codes.code_terms(nodes, "code", "fine")
    with pytest.raises(ValueError, match="crosswalk"):
        codes.code_terms(nodes, "code", "ccsr")


def test_cells(spark):
    train = spark.createDataFrame([(k, ["poor", "good", None][k % 3]) for k in range(60)], "id int, label string")
    test = spark.createDataFrame([(100, "good"), (101, "unseen"), (102, None)], "id int, label string")
    cell = cells.load_cell(train, test, "id", "label", binary=False, most_train=30)
    assert {(r["label"], r["y"]) for r in cell.classes.collect()} == {("good", 0), ("nan", 1), ("poor", 2)}
    assert {(r["id"], r["y"]) for r in cell.test.collect()} == {(100, 0), (102, 1)} and cell.train.count() + cell.valid.count() == 30
    assert [r[0] for r in cell.valid.groupBy("y").count().select("count").collect()] == [2, 2, 2]
    order = spark.createDataFrame([(102, 1), (100, 2)], "id int, _pos int")
    assert [r["id"] for r in cells.load_cell(train, test, "id", "label", False, subset=order).test.orderBy("_pos").collect()] == [102, 100]
    with pytest.raises(ValueError, match="101"):
        cells.load_cell(train, test, "id", "label", False, subset=spark.createDataFrame([(101, 1)], "id int, _pos int"))
    numbers = spark.createDataFrame([(1, "3"), (2, "-1"), (3, "x"), (4, None)], "id int, label string")
    assert {r["id"]: r["y"] for r in cells.encoded_labels(numbers, numbers, "label", True)[0].collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_a_record_takes_one_exchange(spark):
    keys = spark.createDataFrame([(2, 0), (1, 1)], "k int, _pos int")
    rows = spark.createDataFrame([(1, "b", 3), (1, "a", 1), (1, "b", 2), (9, "z", 1)], "k int, v string, n int")
    v, parts = F.col("v"), []
    for shape in cells.SHAPES:
        one = rows.where("n = 3 or k = 9") if shape == "one" else rows
        parts.append(cells.Part(one, {shape: (shape, v == "b" if shape == "count" else v)}, F.col("n")))
    made = cells.assembled(keys, "k", parts)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r["k"]: (r["_pos"], r["one"], r["count"], r["joined"], r["listed"], r["first"]) for r in made.collect()}
    assert got == {1: (1, "b", 2, "a; b", ["a", "b", "b"], "a"), 2: (0, None, 0, None, [], None)}
    with pytest.raises(ValueError, match="shape"):
        cells.assembled(keys, "k", [cells.Part(rows, {"x": ("sum", v)})])


def test_decisions(spark):
    results = spark.createDataFrame([(1, 0.1, float("nan")), (2, 0.0, 0.2), (3, None, None)], "id int, x double, y double")
    rules = [("BOTH", {"x": (None, 0.0), "y": (0.0, None)}), ("HIGH", {"x": (0.0, None)}), ("ELSE", {})]
    assert {r["id"]: r["verdict"] for r in decisions.decide(results, "id", decisions.rule_table(spark, rules)).collect()} == {1: "HIGH", 2: "BOTH", 3: "ELSE"}
    gap = decisions.decide(results, "id", decisions.rule_table(spark, rules[:2]))
    with pytest.raises(Exception, match="no rule for 3"):
        gap.collect()


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    df = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "id int, y int")
    seen = []

    def fit(train):
        ids = {r["id"] for r in train.collect()}
        seen.append(ids)
        return lambda rows: rows.withColumn("score", F.lit(float(len(seen))))

    got = probes.out_of_fold(df, "id", "y", 5, "s", fit).collect()
    assert len(got) == 80 and all(r["id"] not in seen[r["fold"]] and r["score"] == r["fold"] + 1 for r in got)
    assert {sum(1 for r in got if r["fold"] == k and r["y"] == 1) for k in range(5)} == {4}
    with pytest.raises(ValueError, match="two classes"):
        probes.out_of_fold(df.where("y = 0"), "id", "y", 5, "s", fit)


def test_tuning_by_average_precision(spark):
    from pyspark.ml.classification import LogisticRegression

    rng = np.random.default_rng(0)
    rows = [(int(k % 2), float(k % 2 + rng.normal()), float(rng.normal())) for k in range(400)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "y int, a double, b double"))
    learner = LogisticRegression(labelCol="y", elasticNetParam=1.0)
    model, choice, values = probes.tuned(learner, [{learner.regParam: r} for r in (10.0, 0.01, 0.01)], df, df, probes.AveragePrecision())
    assert choice == {learner.regParam: 0.01} and values[1] == values[2] > values[0] and model.coefficients[0] > 0


def test_importance_of_a_column_that_counts_for_nothing(spark):
    df = spark.createDataFrame([(k, k % 2, float(k % 2), float(k % 7)) for k in range(200)], "id int, y int, a double, b double")
    got = {r["feature"]: r["importance"] for r in probes.permutation_importance(df, "id", ["a", "b"], "y", lambda x: x["a"] + 0 * x["b"], 3, "s").collect()}
    assert got["a"] > 0.3 and got["b"] == 0
    top = probes.top_features(spark.createDataFrame(list(got.items()), "feature string, importance double"), 1).collect()
    assert [(r["place"], r["feature"], r["n_negligible"]) for r in top] == [(1, "a", 1)]


def test_sparse_vectors_and_stacked_views(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a = spark.createDataFrame([(1, "x", 2.0), (2, "z", 1.0)], "k int, feature string, value double")
    b = spark.createDataFrame([(1, "x", 5.0)], "k int, feature string, value double")
    view = features.StackedView("k").fit({"a": a, "b": b})
    more = a.union(spark.createDataFrame([(3, "new", 1.0)], a.schema))
    got = {r["k"]: list(r["v"]) for r in view.transform(keys, {"a": more, "b": b}).select("k", vector_to_array("features").alias("v")).collect()}
    assert got == {1: [2.0, 0.0, 5.0], 2: [0.0, 1.0, 0.0], 3: [0.0, 0.0, 0.0]}


def test_packed_bits_across_words(spark):
    bits = [F.lit(k in (0, 63, 64, 69)) for k in range(70)]
    words = features.packed_bits(bits)
    df = spark.createDataFrame([("a",), ("b",), (None,)], "g string").select("g", *[F.when(F.col("g") != "b", w).alias(f"w{k}") for k, w in enumerate(words)])
    got = {r["g"]: (r["n"], [k for k, x in enumerate(r["fingerprint"]) if x], len(r["fingerprint"])) for r in features.packed_pool(df, "g", ["w0", "w1"], 70).collect()}
    assert got == {"a": (1, [0, 63, 64, 69], 70), "b": (0, [], 70), None: (0, [], 70)}


def test_two_writers_leave_one_table(spark, tmp_path):
    path = str(tmp_path / "once")
    assert stores.read_once(spark, path) is None
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda k: stores.put_once(spark.range(100).withColumn("w", F.lit(k)), path), range(4)))
    kept = stores.read_once(spark, path).groupBy("w").count().collect()
    assert sum(won) == 1 and [(r["w"], r["count"]) for r in kept] == [(won.index(True), 100)]
    assert len(list((tmp_path / "once").glob("data-*"))) == 1
    again = stores.once(spark, path, lambda: spark.range(3))
    assert again.count() == 100


def test_records_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "run.json")
    assert stores.record(spark, path) is None
    for k in range(3):
        stores.put_record(spark, path, {"status": "ok", "k": k, "text": "ü\n"})
    assert stores.record(spark, path) == {"status": "ok", "k": 2, "text": "ü\n"}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["run.json"]


def test_cache_tells_requests_apart(spark, tmp_path):
    path = str(tmp_path / "cache")
    asked = spark.createDataFrame([("m", "p", 0.0, "sync"), ("m", "p", 0.5, "sync"), ("n", "p", 0.0, "sync"), ("m", "q", 0.0, "sync")], "model string, prompt string, temperature double, tier string")
    assert stores.cache_get(asked, path).where("reply is null").count() == 4
    for reply in ("first", "last"):
        stores.cache_put(asked.limit(1).withColumn("reply", F.lit(reply)), path)
    got = stores.cache_get(asked, path)
    assert [r["reply"] for r in got.orderBy("model", "prompt", "temperature").collect()] == ["last", None, None, None] and got.select("key").distinct().count() == 4


def test_providers(spark):
    models = spark.createDataFrame([("us.Anthropic.x",), ("amazon.nova-1",), ("meta.x",), ("LLAMA",), ("deepseek.r1",)], "m string")
    assert [r[0] for r in models.select(elicitation.provider_of(F.col("m"))).collect()] == ["anthropic", "amazon_nova", "meta_llama", "meta_llama", "deepseek"]
    with pytest.raises(Exception, match="no record format for model other"):
        spark.range(1).select(elicitation.provider_of(F.lit("other"))).collect()


def small_cell(rows):
    df = rows.withColumn("label", (F.col("id") % 2).cast("string")).withColumn("kind", F.when(F.col("id") % 2 == 1, F.concat(F.lit("k"), F.col("id") % 3)).otherwise("z"))
    return cells.load_cell(df.where("id % 4 < 2"), df.where("id % 4 >= 2"), "id", "label", binary=True)


def test_a_grid_says_what_became_of_its_cells(spark, tmp_path):
    def load(task, phase, seed):
        if phase == "gone":
            raise FileNotFoundError("no such phase")
        return small_cell(spark.range(120))

    terms = lambda df: df.select("id", F.lit("icd").alias("block"), F.col("kind").alias("term"))
    grid = runner.Grid(f"file://{tmp_path}/grid", load, draws=3, view="tabular+codes", terms=terms, min_df=2)
    specs = [("t", "one", "logreg_l2", 1), ("t", "one", "tabnet", 1), ("t", "gone", "majority", 1), ("t", "one", "nobody's", 1)]
    assert grid.run(spark, specs) == ["ok", "skipped", "no_data", "error"] and grid.run(spark, specs) == []
    rec = {(r["phase"], r["method"]): r for r in grid.records(spark).collect()}
    good = rec["one", "logreg_l2"]
    assert good["point"]["prauc"] > 0.99 and good["n_test"] == 60 and good["n_features"] > 4 and good["lo"] <= good["value"] <= good["hi"]
    assert spark.read.parquet(f"{grid.root}/predictions").groupBy("split").count().count() == 2
    with pytest.raises(ValueError, match="was made with"):
        runner.Grid(grid.root, load, view="tabular").run(spark, specs)
    with pytest.raises(ValueError, match="no view"):
        runner.Grid(grid.root, load, view="all").vectors(small_cell(spark.range(40)))


def test_column_shapes(spark):
    df = spark.createDataFrame([(1, "t", None)], "a int, b string, c string")
    assert registry_tables.without(df, ["a", "x"], ["c"]).columns == ["b"] and registry_tables.empty_columns(registry_tables.with_missing(df, ["d", "b"])) == ["c", "d"]
    assert df.select(registry_tables.mapped(F.col("b"), {"t": "Yes"}), registry_tables.mapped(F.lit("u"), {"t": "Yes"})).first() == ("Yes", None)


def test_masked_texts_are_checked_before_anything_is_asked(spark):
    df = spark.createDataFrame([(1, "Has Asthma", ["Asthma"]), (2, "Clean", ["Asthma"])], "id int, t string, terms array<string>")
    with pytest.raises(ValueError, match="1 texts hold"):
        elicitation.without_leaks(df, "id", F.col("t"), F.col("terms"))
    assert elicitation.without_leaks(df.where("id = 2"), "id", F.col("t"), F.col("terms")).count() == 1


def test_a_key_of_two_endpoints_is_drawn_by_each(spark):
    pooled = spark.createDataFrame([(k, e, None if k == 0 else k % 2) for k in range(41) for e in ("x", "y")], "k int, e string, y int")
    got = splits.arm_sample(pooled, "k", "e", "y", 40, "s").groupBy("e", "y").count().collect()
    assert sorted((r["e"], r["y"], r["count"]) for r in got) == [("x", 0, 10), ("x", 1, 10), ("y", 0, 10), ("y", 1, 10)]
    assert splits.arm_sample(pooled, "k", "e", "y", None, "s").count() == 80

"""Operators whose results SQL doesn't state in the catalogue: guards, exact tests, sources and sinks."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import scalars as C
from evalloom.functions import special
from evalloom.operators import audit, bootstrap, codes, elicitation, exact_tests, features, runs, splits
from evalloom.sources import tables


@pytest.mark.parametrize(
    ("text", "terms"),
    [("Filariasis", ["Filariasis"]), ("[\"Crohn's disease\", 'a, b']", ["Crohn's disease", "a, b"]), ("[\"['J45.998', 'J82.83']\"]", ["J45.998", "J82.83"]), ("[['C50'], []]", ["C50"]), (None, []), ("nan", []), ("['open", ["['open"]), ("[]", [])],
)
def test_nested_terms(spark, text, terms):
    assert spark.createDataFrame([(text,)], "t string").select(C.nested_terms(F.col("t")).alias("x")).first()["x"] == terms


def test_phrases_of_a_row_are_masked(spark):
    df = spark.createDataFrame([("Type 2 diabetes and DIABETES (a+b)", ["diabetes", "Type 2 Diabetes", " a+b "]), ("plain", None), ("plain", [])], "t string, p array<string>")
    got = [r["x"] for r in df.select(C.mask_phrases_of(F.col("t"), F.col("p")).alias("x")).collect()]
    assert got == ["[MASK] and [MASK] ([MASK])", "plain", "plain"]


def test_arms(spark):
    none = F.array().cast("array<string>")
    with pytest.raises(ValueError, match="L6"):
        elicitation.slot("L6", none, none, none, none, none, F.lit(None))
    df = spark.createDataFrame([(1, "Healthy people", "Healthy"), (2, "Asthma study", "Asthma")], "id int, title string, name string")
    names, text = F.array("name"), elicitation.body({"Title": F.col("title")}, set(), F.array("name"))
    slots = {"L0": F.lit(elicitation.MASKED), "L1": elicitation.listed(names)}
    assert elicitation.broken_bodies(df, "id", {a: F.concat(text, s) for a, s in slots.items()}, slots).count() == 0
    odd = {"L0": F.concat(text, slots["L0"]), "L1": F.concat(F.lit("x"), text, slots["L1"])}
    assert [r["arms"] for r in elicitation.broken_bodies(df, "id", odd, slots).collect()] == [["L1"], ["L1"]]
    assert [(r["id"], r["term"]) for r in elicitation.leaks(df, "id", F.concat(text, slots["L0"]), names).collect()] == [(2, "Asthma")]


def test_exact_tests(spark):
    one = spark.range(1)
    share = exact_tests.clopper_pearson(F.lit(3), F.lit(10))
    got = one.select(share["lo"].alias("lo"), share["hi"].alias("hi"), exact_tests.mcnemar(F.lit(8), F.lit(2)).alias("p"), exact_tests.mcnemar(F.lit(0), F.lit(0)).alias("none")).first()
    assert (got["lo"], got["hi"]) == pytest.approx((0.0667395, 0.6524529), abs=1e-6)
    assert got["p"] == pytest.approx(sum(math.comb(10, k) for k in (8, 9, 10)) / 1024) and got["none"] == 1.0
    ends = exact_tests.clopper_pearson(F.lit(0), F.lit(5)), exact_tests.clopper_pearson(F.lit(5), F.lit(5))
    assert one.select(ends[0]["lo"].alias("a"), ends[1]["hi"].alias("b")).first() == (0.0, 1.0)
    table = spark.createDataFrame([(1, 8, 2, 1, 5)], "k int, a long, b long, c long, d long")
    found = exact_tests.fisher(table, ["k"], "a", "b", "c", "d").first()
    assert found["two_sided"] == pytest.approx(0.0349650, abs=1e-6) and found["greater"] == pytest.approx(0.0244755, abs=1e-6)


def binomial_by_fractions(n, k, p):
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def fisher_by_fractions(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    p = {x: Fraction(math.comb(row, x) * math.comb(n - row, col - x), math.comb(n, col)) for x in range(max(0, row + col - n), min(row, col) + 1)}
    return float(min(1, sum(v for v in p.values() if v <= p[a] * Fraction(10**7 + 1, 10**7)))), float(sum(v for x, v in p.items() if x >= a))


def test_tails_against_fractions():
    rng = random.Random(5)
    for n, k, p in [(10, 3, (1, 2)), (300, 140, (1, 2)), (1000, 20, (1, 50)), (1000, 0, (1, 3)), (1000, 1000, (9, 10)), (2000, 1100, (1, 2)), (7000, 3400, (1, 2)), (7000, 3600, (1, 2))]:
        want = binomial_by_fractions(n, k, Fraction(*p))
        assert special.binomial_tail(n, k, p[0] / p[1])[()] == pytest.approx(want, rel=1e-9)
    for _ in range(400):
        cells = [rng.randint(0, rng.choice([3, 12, 60])) for _ in range(4)]
        assert special.fisher_p(*cells) == pytest.approx(fisher_by_fractions(*cells), abs=1e-9)


def test_tails_at_large_counts(spark):
    df = spark.createDataFrame([(100, 3000), (300, 3000), (50, 20_000), (1000, 10**6), (0, 0), (None, 5)], "k long, n long")
    got = [tuple(r["e"]) if r["e"] else None for r in df.select(exact_tests.clopper_pearson(F.col("k"), F.col("n")).alias("e")).collect()]
    assert got[4:] == [None, None]
    assert [x for e in got[:4] for x in e] == pytest.approx([0.0272019, 0.0403953, 0.0894921, 0.1112951, 0.0018561, 0.0032946, 0.000939, 0.0010639], abs=1e-6)
    pairs = spark.createDataFrame([(5000, 10_000), (10_000, 5000), (7500, 7500), (500_030_000, 499_970_000)], "a long, b long")
    p = [r["p"] for r in pairs.select(exact_tests.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()]
    normal = lambda z: math.erfc(z / math.sqrt(2)) / 2
    assert p[0] == 1.0 and p[1] < 1e-300 and p[2:] == pytest.approx([0.5032573, normal((500_030_000 - 0.5 - 5e8) / math.sqrt(1e9 / 4))], rel=1e-6)
    tables = spark.createDataFrame([(1, 10**6, 10**6 + 1500, 10**6, 10**6), (2, 2 * 10**8, 2 * 10**8 + 40_000, 2 * 10**8, 2 * 10**8), (3, 0, 0, 0, 0), (4, 3, 0, 0, 0)], "k int, a long, b long, c long, d long")
    for r, x in zip(exact_tests.fisher(tables, ["k"], "a", "b", "c", "d").orderBy("k").collect(), tables.orderBy("k").collect(), strict=True):
        if x["k"] > 2:
            assert (r["two_sided"], r["greater"]) == (1.0, 1.0)
            continue
        n, row, col = x["a"] + x["b"] + x["c"] + x["d"], x["a"] + x["b"], x["a"] + x["c"]
        sd = math.sqrt(row * col * (n - row) / n * ((n - col) / n) / (n - 1))
        z = (row * col / n - x["a"] - 0.5) / sd
        assert r["two_sided"] == pytest.approx(2 * normal(z), rel=1e-3) and r["greater"] == pytest.approx(1 - normal((row * col / n - x["a"] + 0.5) / sd), rel=1e-3)


def test_tails_of_statistics():
    assert [special.chi2_tail(x, d) for x, d in ((3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (11.070498, 5), (0.0, 3))] == pytest.approx([0.05] * 5 + [1], abs=1e-6)
    assert special.chi2_tail(2000, 1500) == pytest.approx(5.8099e-17, rel=1e-3)
    assert [special.t_tail(2.228139, 10), special.t_tail(0.0, 3), special.t_tail(math.inf, 3)] == pytest.approx([0.05, 1, 0], abs=1e-6)


def test_donors_lose_no_row(spark):
    rows = [(1, "g1", "x"), (2, "g1", "y"), (3, "g2", "X "), (4, "g2", "z"), (5, "g3", "x"), (6, None, "x")]
    got = {r["id"]: r for r in audit.donors(spark.createDataFrame(rows, "id int, g string, n string"), "id", "g", "n", "s").collect()}
    groups, names = {r[0]: r[1] for r in rows}, {r[0]: r[2].strip().lower() for r in rows}
    assert set(got) == set(groups) and got[6]["donor"] is None
    for k in (1, 2, 3, 4, 5):
        d = got[k]["donor"]
        assert d is None or groups[d] not in (groups[k], None) and names[d] != names[k]
    assert sum(got[k]["donor"] is not None for k in got) >= 3
    alone = audit.donors(spark.createDataFrame(rows[:2], "id int, g string, n string"), "id", "g", "n", "s").collect()
    assert [r["donor"] for r in alone] == [None, None]


def test_neighbours_lie_beyond_any_first_width(spark):
    rows = [(1, 0, "a"), (2, 1, "A "), (3, 1000, "b"), (4, 1001, "b"), (5, 90_000, "c")]
    got = audit.nearest_by_number(spark.createDataFrame(rows, "id int, x int, t string"), "id", "x", "t", 2).collect()
    near = {r["id"]: [] for r in got}
    for r in sorted(got, key=lambda r: r["rank"]):
        near[r["id"]].append(r["other"])
    assert near == {1: [3, 5], 2: [3, 5], 3: [2, 5], 4: [2, 5], 5: [4, 2]}


def test_neighbours_with_a_title_and_a_number_that_many_rows_have(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.randint(0, 300), rng.randint(0, 20), 7, None]), rng.choice(["most"] * 6 + [f" T{rng.randint(0, 12)}", None])) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, x int, t string").repartition(7)
    got = sorted(tuple(r) for r in audit.nearest_by_number(df, "id", "x", "t", 3).collect())
    title, want = lambda t: None if t is None else t.strip().lower(), []
    for k, x, t in rows:
        best = {}
        for o, y, u in rows:
            if x is not None and y is not None and title(u) != title(t):
                best[title(u)] = min(best.get(title(u), (10**9, 0)), (abs(x - y), o))
        want += [(k, o, gap, r) for r, (gap, o) in enumerate(sorted(best.values())[:3], 1)]
    assert got == sorted(want)


def test_floor_keeps_what_is_above_it(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(60):
        v = rng.random(12) * (rng.random(12) < 0.5) + (np.arange(12) == 0) * 0.3
        rows += [(k, f"t{j}", float(x)) for j, x in enumerate(v / np.linalg.norm(v)) if x]
    df = spark.createDataFrame(rows, "id int, term string, weight double")
    q, c = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    full, cut = ({r["id"]: r["sim"] for r in audit.max_cosine(q, c, "id", f).collect()} for f in (0.0, 0.8))
    assert any(x >= 0.8 for x in full.values()) and cut == pytest.approx({k: x if x >= 0.8 else 0.0 for k, x in full.items()})


def test_hash_rank_equals_one_window(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"))
    want = sorted((r["g"], r["h"], r["id"]) for r in df.select("id", "g", F.sha2(F.concat_ws("|", F.lit("s"), F.col("id").cast("string")), 256).alias("h")).collect())
    place, rank = {}, {}
    for g, _, i in want:
        rank[i] = place[g] = place.get(g, 0) + 1
    assert {r["id"]: r["_rank"] for r in splits.hash_rank(df, ["g"], "s", "id").collect()} == rank


def test_permuted_labels_keep_their_counts(spark):
    df = spark.range(50).select("id", (F.col("id") < 20).cast("int").alias("y"))
    got = bootstrap.permuted_labels(df, "id", "y", 3, "p").groupBy("draw").agg(F.sum("permuted").alias("s"), F.countDistinct("id").alias("n")).collect()
    assert [(r["s"], r["n"]) for r in got] == [(20, 50)] * 3


def test_featurizer_on_unseen_rows(spark):
    train = spark.createDataFrame([(k, f"{k % 5} Years" if k % 4 else None, "ab"[k % 2], f"c{k}", k % 2, k % 3 == 0) for k in range(60)], "id int, age string, small string, big string, y int, flag_x boolean").withColumn("flag_x", F.col("flag_x").cast("int"))
    made = features.Featurizer("id", "y", durations=("age",), flags="flag_").fit(train)
    row = made.transform(spark.createDataFrame([(100, None, "z", "new", None, None)], "id int, age string, small string, big string, y int, flag_x int")).first().asDict()
    assert row == {"id": 100, "age": 24.0, "flag_x": 0.0, "small__te": 0.5, "big__te": 0.5}
    classes = features.Featurizer("id", "y", durations=("age",), flags="flag_", binary=False).fit(train)
    row = classes.transform(spark.createDataFrame([(100, None, "z", "new", None)], "id int, age string, small string, big string, y int")).first().asDict()
    assert row == {"id": 100, "age": 24.0, "flag_x": 0.0, "small__a": 0.0, "small__b": 0.0}
    empty = train.withColumn("flag_y", F.when(F.col("id") < 20, 1)).withColumn("gone", F.when(F.col("id") < 20, "x"))
    assert features.Featurizer("id", "y", flags="flag_", raw=("big",)).fit(empty).names() == ["flag_x", "age__te", "small__te"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" N1 \n\nN2\n")
    ids = tables.id_list(spark, str(tmp_path / "ids.txt"))
    assert [r["id"] for r in ids.collect()] == ["N1", "N2"]
    digest = tables.write_subset(ids, "id", str(tmp_path / "subset"))
    assert digest == tables.subset_digest(ids.repartition(5), "id") != tables.subset_digest(ids.limit(1), "id")
    diags = "<diag><name>I10</name><desc>High</desc><diag><name>i10.1</name><desc>Higher</desc><diag><name>I10.11</name><desc>Highest</desc></diag></diag></diag><diag><name>I11</name><desc>Other</desc></diag><diag><name>I1</name><desc>Short</desc></diag>"
    (tmp_path / "codes.xml").write_text(f"<root><chapter><desc>Of the heart (I00-I99)</desc><section id='I10-I1A'>{diags}</section></chapter><chapter><desc>No range</desc><section id='X'><diag><name>X10</name></diag></section></chapter></root>")
    got = {(r["char3"], r["block"], r["chapter"]) for r in tables.hierarchy(spark, str(tmp_path / "codes.xml"), chapters=1).collect()}
    assert got == {("I10", "I10-I1A", "I00-I99"), ("I11", "I10-I1A", "I00-I99")}
    with pytest.raises(ValueError, match="1 chapters"):
        tables.hierarchy(spark, str(tmp_path / "codes.xml"))
    tree = tables.code_tree(spark, str(tmp_path / "codes.xml"))
    assert {tuple(r) for r in tree.collect()} == {(None, "I10", "High"), ("I10", "I10.1", "Higher"), ("I10.1", "I10.11", "Highest"), (None, "I11", "Other"), (None, "I1", "Short"), (None, "X10", None)}
    asked = spark.createDataFrame([("i10.11 ",), ("I.11",), ("Z9",)], "c string")
    assert {r["c"]: r["descriptor"] for r in codes.described(asked, "c", tree).collect()} == {"i10.11 ": "Highest", "I.11": "Other", "Z9": None}
    (tmp_path / "v.txt").write_text("asthma 1 2.5\nbad\n")
    assert [tuple(r) for r in tables.term_vectors(spark, str(tmp_path / "v.txt")).collect()] == [("asthma", [1.0, 2.5])]
    (tmp_path / "cache.jsonl").write_text('{"key": "a", "reply": "old", "at": 1}\n{"key": "a", "reply": "new", "at": 2}\n{"key": \n')
    assert [tuple(r) for r in tables.response_cache(spark, str(tmp_path / "cache.jsonl")).collect()] == [("a", "new")]
    (tmp_path / "out.jsonl").write_text('{"recordId": "1", "modelOutput": {"probability": 40}}\n{"recordId": "2", "error": "late"}\n')
    records = tables.batch_records(spark, str(tmp_path / "out.jsonl"))
    asked = spark.createDataFrame([("1",), ("2",), ("3",)], "recordId string")
    assert sorted(tuple(r) for r in elicitation.reassembled(asked, records, "recordId", "body", "error").collect()) == [("1", "ok", 0.4), ("2", "error", 0.5), ("3", "missing", 0.5)]
    board = spark.createDataFrame([("a", 0.5), ("b", None)], "method string, mean double")
    tables.write_leaderboard(board, str(tmp_path / "board"), ["method", "mean"])
    assert [r["line"] for r in runs.markdown(board, ["method", "mean"]).collect()] == ["| method | mean |", "|-|-|", "| a | 0.5 |", "| b |  |"]
    assert spark.read.csv(str(tmp_path / "board" / "csv"), header=True).count() == 2
    calls = spark.createDataFrame([("m", "2026-01-02 03:04:05")], "model string, at string").withColumn("at", F.to_timestamp("at"))
    for _ in range(2):
        tables.append_usage(calls, str(tmp_path / "usage"))
    assert spark.read.json(str(tmp_path / "usage")).count() == 2
    tables.write_batches(spark.range(25), str(tmp_path / "batches"), 10)
    assert spark.read.json(str(tmp_path / "batches")).count() == 25
    (tmp_path / "cross.csv").write_text("code,label,c1,c1 name,c2\n'J45','x','RSP1','a',''\n'J45','x','RSP2','a','RSP1'\n")
    assert [tuple(r) for r in tables.crosswalk(spark, str(tmp_path / "cross.csv"), 0, [2, 4]).collect()] == [("J45", ["RSP1", "RSP2"])]
    (tmp_path / "names.csv").write_text("code,label,c1,c1 name\n'A','x','END1','Old'\n'B','x','END1','New'\n'C','x','','None'\n")
    assert [tuple(r) for r in tables.category_names(spark, str(tmp_path / "names.csv"), [2]).collect()] == [("END1", "New")]

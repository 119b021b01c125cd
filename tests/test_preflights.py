"""Checks before a comparison, on cases that the tables don't have."""

import math

import pytest
from pyspark.sql import functions as F

from evalloom.functions import scalars as C
from evalloom.operators import audit, preflight


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("a~b  c\r\n d", "a b c d"),
        (r"\[PSP\] p \< 0.001, mg/m\^2", "[PSP] p < 0.001, mg/m^2"),
        ('the "OFF" time', "the OFF time"),
        ("one * two * three", "one - two - three"),
        ("\u00a0x\u2003y\u3000", "x y"),
        (r"C:\temp stays", r"C:\temp stays"),
        ("Case Stays", "Case Stays"),
        ("", ""),
        (None, ""),
    ],
)
def test_identity_text(spark, text, plain):
    assert spark.createDataFrame([(text,)], "t string").select(C.identity_text(F.col("t"))).first()[0] == plain


def test_text_identity(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, t string")
    a = rows((1, "x y"), (2, "x"), (3, "x"), (4, None), (5, "p"), (5, "q"), (None, "x"))
    b = rows((1, "x~y"), (2, "z"), (4, "x"), (5, "q"), (6, "x"), (None, "x"))
    assert {r["k"]: r["identical"] for r in preflight.text_identity(a, b, "k", "t").collect()} == {1: True, 2: False, 5: True, None: True}
    assert preflight.text_identity(a.limit(0), b, "k", "t").count() == 0


def test_arms(spark):
    arms = spark.createDataFrame([("A", "e", 1, "one two", 3, "x"), ("A", "e", 0, "\u00a0one ", 5, "x"), ("A", "f", None, None, None, "y"), ("B", "e", 1, "", 7, None)], "arm string, endpoint string, y int, text string, n int, cat string")
    assert {(r["arm"], r["endpoint"]): (r["n"], r["positive_rate"]) for r in preflight.arm_balance(arms, "arm", "endpoint", "y").collect()} == {("A", "e"): (2, 0.5), ("A", "f"): (1, None), ("B", "e"): (1, 1.0)}
    found = {(r["arm"], r["what"], r["level"]): r["value"] for r in preflight.arm_covariates(arms, "arm", "text", "n", "cat").collect()}
    assert found == {("A", "words", None): 1.0, ("A", "number", None): 4.0, ("A", "share", "x"): 2 / 3, ("A", "share", "y"): 1 / 3, ("B", "words", None): 0.0, ("B", "number", None): 7.0}


def test_shuffled_control(spark):
    df = spark.createDataFrame([(k, f"word{k} other", f"word{k} other" if k < 6 else f"none{k}") for k in range(10)] + [(20, None, "x"), (21, "x", None)], "k int, said string, truth string")
    found = preflight.shuffled_control(df, "k", "said", "truth", "s").first()
    assert (found["n"], found["real_hits"], found["shuffled_hits"]) == (10, 6, 0)
    assert math.isclose(found["p"], 2 * math.comb(10, 6) / math.comb(20, 6), rel_tol=1e-9)
    one = preflight.shuffled_control(df.where("k = 1"), "k", "said", "truth", "s").first()
    assert one["n"] == 1 and one["real_hits"] is None and one["p"] is None
    none = preflight.shuffled_control(df.where("k = 20"), "k", "said", "truth", "s").first()
    assert none["n"] == 0 and none["shuffled_hits"] is None


def test_confound_verdicts(spark):
    """In each cell the rows of stratum 1 are mostly positive. `era` knows the stratum alone."""
    rows = []
    for k in range(40):
        stratum, y = k % 2, int(k % 2 == 1 and k % 10 != 1 or k % 10 == 0)
        era, noise = float(stratum), (k * 7 % 11) / 11
        rows += [("cut", stratum, era + noise / 1000, noise, era, y), ("kept", stratum, y + noise / 10, noise, era, y), ("soft", stratum, era + 0.2 * noise + 0.9 * (y == 1 and k % 4 == 1), noise, noise, y)]
    df = spark.createDataFrame(rows, "cell string, s int, model double, rival double, era double, y int")
    floors = spark.createDataFrame([("cut", 0.08), ("kept", 0.01)], "cell string, floor double")
    found = {r["cell"]: r for r in preflight.confound_verdicts(df, "cell", "s", ("model", "rival", "era"), "y", floors).collect()}
    assert found["cut"]["verdict"] == "CUT" and found["kept"]["verdict"] == "CONFIRMED"
    assert found["kept"]["full"] == 1.0 and found["kept"]["shrinkage"] < 0.5
    few = {r["cell"]: r for r in preflight.confound_verdicts(df, "cell", "s", ("model", "rival", "era"), "y", floors, least=21).collect()}
    assert few["soft"]["pooled_margin"] is None and few["soft"]["verdict"] == "CONFIRMED"
    assert found["soft"]["verdict"] == "SOFTENED" and found["soft"]["margin"] > found["soft"]["pooled_margin"]


def test_swap_donors(spark):
    pool = [(k, ["g1"], ["Asthma"]) for k in range(5)] + [(5, ["g2"], ["Flu "]), (6, ["g2"], ["Cold"]), (7, ["g2", "g1"], ["Both"]), (8, ["g3"], ["A", "B"]), (9, [], ["None"])]
    rows = [(100 + k, ["g1"], ["flu", None]) for k in range(20)] + [(200, ["g1", "g2"], ["x"]), (201, None, ["x"]), (202, [], ["x"]), (203, ["g2"], ["ASTHMA"]), (204, ["g9"], None)]
    kind = "k int, groups array<string>, terms array<string>"
    found = {r["k"]: (r["donor_group"], r["donor_name"]) for r in audit.swap_donors(spark.createDataFrame(pool, kind), spark.createDataFrame(rows, kind), "k", "groups", "terms", "s").collect()}
    assert len(found) == 25 and all(found[100 + k] == ("g2", "Cold") for k in range(20))  # its own name, spelled otherwise, is never drawn
    assert found[200] == found[201] == found[202] == found[203] == (None, None) and found[204][0] in ("g1", "g2")
    none = audit.swap_donors(spark.createDataFrame([], kind), spark.createDataFrame(rows, kind), "k", "groups", "terms", "s")
    assert none.count() == 25 and none.where("donor_name is not null").count() == 0

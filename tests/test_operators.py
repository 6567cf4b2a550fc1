"""Operators on literal frames: rule sets, dedup policies, quality, aggregates."""

import pytest
from pyspark.sql import functions as F

from casebook.operators import aggregates as A
from casebook.operators import quality as Q
from casebook.operators import rules as R


@pytest.fixture
def dup6(spark):
    return spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "d", 4), (None, "e", 5), (None, "f", 6)],
                                 "k int, v string, ord int")


def _vals(df):
    return sorted(r["v"] for r in df.collect())


def test_dedup_policies(dup6):
    assert _vals(Q.dedup(dup6, ["k"], "first", ["ord"])) == ["a", "d", "e"]
    assert _vals(Q.dedup(dup6, ["k"], "last", ["ord"])) == ["c", "d", "f"]
    assert _vals(Q.dedup(dup6, ["k"], "none")) == ["d"]
    assert _vals(Q.dedup(dup6, ["k"], "all_but_last", ["ord"])) == ["a", "b", "e"]
    # NULL keys are never duplicates with null_keys='keep'
    assert _vals(Q.dedup(dup6, ["k"], "none", null_keys="keep")) == ["d", "e", "f"]
    assert _vals(Q.dedup(dup6, ["k"], "all_but_last", ["ord"], null_keys="keep")) == ["a", "b"]


def test_dedup_idempotent(dup6):
    once = Q.dedup(dup6, ["k"], "first", ["ord"])
    assert _vals(Q.dedup(once, ["k"], "first", ["ord"])) == _vals(once)


def test_rules_clean_and_rejected_partition_input(spark):
    df = spark.createDataFrame([(1, 5.0), (0, 2.0), (2, None), (3, -1.0)], "p int, fare double")
    rules = {"no_passenger": F.col("p") == 0, "bad_fare": F.col("fare") <= 0}
    clean, bad = R.clean(df, rules), R.rejected(df, rules)
    assert clean.count() + bad.count() == df.count()
    assert clean.join(bad, ["p"], "inner").count() == 0
    names = {r["p"]: r["broken"] for r in R.apply_rules(df, rules).collect()}
    assert names[2] == ["bad_fare"]              # NULL rule result counts as broken
    assert names[1] == []
    card = R.rule_scorecard(df, rules).first()
    assert (card["n_rows"], card["n_no_passenger"], card["n_bad_fare"], card["n_faulty"]) == (4, 1, 2, 3)


def test_null_profile_after_fill_is_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, 2.0, None)], "a int, b double, c string")
    prof = {r["column"]: (r["n_null"], r["null_pct"]) for r in Q.null_profile(df).collect()}
    assert prof == {"a": (1, 50.0), "b": (1, 50.0), "c": (1, 50.0)}
    filled = Q.fill_constants(df, {"a": 0, "b": 0.0, "c": "none"})
    assert Q.null_profile(filled, min_pct=0).count() == 0


def test_drop_sparse_and_constant(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, None, "k"), (3, 1.0, "k")], "a int, b double, c string")
    kept, dropped = Q.drop_sparse(df, 60.0)
    assert dropped == ["b"] and kept.columns == ["a", "c"]
    kept2, dropped2 = Q.drop_constant(df)
    assert set(dropped2) == {"b", "c"}           # b has one non-null value, c one value


def test_iqr_two_passes(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    kept, dropped = Q.iqr_filter(df, "x", passes=2)
    assert sorted(r[0] for r in kept.collect()) == [1.0, 2.0, 3.0, 4.0]
    assert [r[0] for r in dropped.collect()] == [100.0]


def test_mode_repair_tie_smallest(spark):
    df = spark.createDataFrame([(s,) for s in ["NY", "NJ", "NJ", "NY", "99", "99", "99"]], "s string")
    out = sorted(r[0] for r in Q.replace_with_mode(df, "s", ["99"]).collect())
    assert out == ["NJ"] * 5 + ["NY"] * 2


def test_histogram_top_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 10]], "x double")
    h = {r["bin"]: r["n"] for r in A.histogram(df, "x", n_bins=5).collect()}
    assert h == {1: 3, 2: 0, 3: 0, 4: 0, 5: 1}


def test_boxplot_stats_global_and_grouped(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 5.0)], "g string, x double")
    g = A.boxplot_stats(df.where("g = 'a'"), "x").first()
    assert (g["q1"], g["median"], g["q3"], g["n_outliers"], g["whisker_hi"]) == (2.0, 3.0, 4.0, 1, 4.0)
    by = {r["g"]: r["n_outliers"] for r in A.boxplot_stats(df, "x", by=["g"]).collect()}
    assert by == {"a": 1, "b": 0}


def test_share_of_total_sums_to_100(spark):
    df = spark.createDataFrame([(k,) for k in "aaabbc"], "k string")
    rows = A.share_of_total(df, ["k"], digits=4).collect()
    assert sum(r["n"] for r in rows) == 6
    assert abs(sum(r["share"] for r in rows) - 100.0) < 1e-3

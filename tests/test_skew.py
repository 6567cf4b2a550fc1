"""Hot-key inputs (one key holds a third of the rows): operators rewritten as
aggregates must still give exactly the brute-force (pandas / numpy) answer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebook.operators import aggregates as A
from casebook.operators import quality as Q
from casebook.operators.recommend import centre


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(1)
    n = 3000
    k = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 400, n))
    pdf = pd.DataFrame({"k": k.astype("int64"), "ord": rng.permutation(n).astype("int64"),
                        "v": rng.normal(size=n).round(3)})
    return pdf, spark.createDataFrame(pdf)


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dedup_hot_key_matches_pandas(hot):
    pdf, df = hot
    s = pdf.sort_values("ord")
    first = s.drop_duplicates("k", keep="first")
    last = s.drop_duplicates("k", keep="last")
    none = s.drop_duplicates("k", keep=False)
    abl = s[s.duplicated("k", keep="last")]
    cols = ["k", "ord", "v"]
    for keep, ref in [("first", first), ("last", last), ("none", none), ("all_but_last", abl)]:
        got = _rows(Q.dedup(df, ["k"], keep, ["ord"]), cols)
        assert got == sorted(map(tuple, ref[cols].itertuples(index=False))), keep


def test_group_size_and_centre(hot):
    pdf, df = hot
    sizes = {r["k"]: r["group_size"] for r in Q.group_size(df, ["k"]).select("k", "group_size").distinct().collect()}
    assert sizes == pdf.groupby("k").size().to_dict()
    c = centre(df, "k", "v", "c").select("ord", "c").collect()
    ref = (pdf["v"] - pdf.groupby("k")["v"].transform("mean")).set_axis(pdf["ord"]).to_dict()
    assert all(abs(r["c"] - ref[r["ord"]]) < 1e-9 for r in c)


def test_exact_quantiles_hot_group(hot):
    pdf, df = hot
    q = A.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], by=["k"], n_buckets=16)
    got = {r["k"]: [r[f"q{i}"] for i in range(5)] for r in q.collect()}
    for key, grp in pdf.groupby("k"):
        ref = np.percentile(grp["v"].to_numpy(), [0, 25, 50, 90, 100])
        assert np.allclose(got[key], ref, atol=1e-12), key
    glob = A.exact_quantiles(df, "v", [0.5]).first()["q0"]
    assert glob == pytest.approx(float(np.median(pdf["v"])))


def test_exact_quantiles_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,)], "x double")
    assert A.exact_quantiles(df, "x", [0.5]).first()["q0"] == 2.0
    assert F is not None


def test_exact_quantiles_by_repeated_selection(spark):
    """Narrowing rounds (forced by a small ``few``), a value on a third of the rows, a NULL key, native types."""
    rows = [("a" if i % 3 else None, float(i % 7 if i % 3 == 0 else (i * 7919) % 1009)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r["k"]: r for r in A.exact_quantiles(df, "v", probs, by=["k"], few=20, n_buckets=8, count_name="n").collect()}
    for k in ("a", None):
        v = [x for g, x in rows if g == k]
        assert got[k]["n"] == len(v)
        assert [got[k][f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(v, probs)))
    big = spark.createDataFrame([(2 ** 53 + i,) for i in (1, 3, 5)], "v long")
    q = A.exact_quantiles(big, "v", [0.0, 0.5, 1.0], interpolation="lower", few=1).first()
    assert list(q) == [2 ** 53 + 1, 2 ** 53 + 3, 2 ** 53 + 5]


def test_range_bucket_search_forms_agree(spark):
    from casebook.operators.ordered import _search, _search_many
    bounds = [float(i * i) for i in range(300)]
    df = spark.range(0, 91000, 7).select(F.col("id").cast("double").alias("x"))
    assert df.where(_search(F.col("x"), bounds, 0, len(bounds)) != _search_many(F.col("x"), bounds)).isEmpty()

"""Euclidean silhouette against all distances."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from casebook.operators import silhouette as S
from casebook.operators.kmeans import fit_many, label_many


def _brute(x, c):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = (c == c[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i, c == c[i]].sum() / (own - 1)
        b = min(d[i, c == o].mean() for o in set(c) if o != c[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(120, 3)) + 4 * i for i in range(3)] + [np.full((40, 3), 7.5)])
    good = np.repeat([0, 1, 2, 2], [120, 120, 120, 40])
    return x, {"good": good, "poor": rng.integers(0, 4, len(x)), "single": np.append(good[:-1], 9), "one": np.zeros(len(x), int)}


def _frame(spark, points):
    x, c = points
    rows = [([float(v) for v in p], *(int(c[k][i]) for k in c)) for i, p in enumerate(x)]
    odd = [(None, 0, 0, 0, 0), ([1.0, None, 2.0], 0, 0, 0, 0), ([float("nan"), 1.0, 2.0], 0, 0, 0, 0), ([float("inf"), 1.0, 2.0], 0, 0, 0, 0),
           ([0.0, 0.0, 0.0], None, None, None, None)]
    return spark.createDataFrame(rows + odd, "x array<double>, good int, poor int, single int, one int").repartition(5)


def test_exact_where_every_ball_is_a_point(spark, points):
    x, c = points
    got = {r["clustering"]: r for r in S.euclidean_silhouette(_frame(spark, points), "x", list(c)).collect()}
    for k in ("good", "poor", "single"):
        assert got[k]["silhouette"] == pytest.approx(_brute(x, c[k]), abs=1e-6) and got[k]["bound"] == 0 and got[k]["n"] == len(x)
    assert got["one"]["silhouette"] is None
    assert S.euclidean_silhouette(_frame(spark, points).where("good > 9"), "x", ["good"]).first()["silhouette"] is None


def test_bounds_hold_with_few_balls(spark, points):
    x, c = points
    df = _frame(spark, points)
    widths = []
    for most in (4, 24, 96):
        for r in S.euclidean_silhouette(df, "x", ["good", "poor"], most=most, limit=most).collect():
            assert abs(r["silhouette"] - _brute(x, c[r["clustering"]])) <= r["bound"] + 1e-6
            if r["clustering"] == "good":
                widths.append(r["bound"])
    assert widths[0] > widths[1] > widths[2] > 0 and widths[2] < 0.1
    refined = S.euclidean_silhouette(df, "x", ["good"], tolerance=1e-4, most=4).first()
    assert refined["bound"] <= 1e-4 and refined["silhouette"] == pytest.approx(_brute(x, c["good"]), abs=2e-4)


def test_of_k_means(spark, points):
    got = {r["k"]: r for r in S.kmeans_silhouette(_frame(spark, points), "x", [2, 3, 5]).collect()}
    assert got[3]["silhouette"] > max(got[2]["silhouette"], got[5]["silhouette"]) and all(r["bound"] <= 1e-3 for r in got.values())


def test_all_pairs_need_no_balls(spark, points):
    x, c = points
    df = _frame(spark, points)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")       # a block's own rows come in several batches
    try:
        got = {r["clustering"]: r for r in S.euclidean_silhouette(df, "x", list(c), most=4, limit=4, exact=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in ("good", "poor", "single"):
        assert got[k]["silhouette"] == pytest.approx(_brute(x, c[k]), abs=1e-6) and got[k]["bound"] == 0 and got[k]["n"] == len(x)
    assert got["one"]["silhouette"] is None


def test_several_clusterings_sum_all_pairs_where_that_is_less_work(spark, points):
    got = S.kmeans_silhouette(_frame(spark, points), "x", [2, 3, 5], most=16, limit=300, tolerance=1.0).collect()
    assert [r["bound"] for r in got] == [0.0] * 3


def _points(spark, x):
    return spark.createDataFrame([([float(v) for v in p],) for p in x], "x array<double>").repartition(3)


def test_k_means_of_several_k_share_their_rounds(spark):
    rows, ks = _points(spark, np.random.default_rng(8).random((600, 4))).localCheckpoint(), list(range(2, 10))
    spark.sparkContext.setJobGroup("shared-rounds", "k-means of several k")
    try:
        S.kmeans_silhouette(rows, "x", ks, tolerance=1.0).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("shared-rounds"))
    vectors = rows.select(array_to_vector("x").alias("v"))
    models = [KMeans(featuresCol="v", k=k, seed=100, maxIter=50).fit(vectors) for k in ks]
    centres = fit_many(rows, ks)
    for model, got in zip(models, centres, strict=True):
        assert np.array(model.clusterCenters()) == pytest.approx(got, abs=1e-9)
    assert 0 < jobs < 7 * len(ks) + sum(m.summary.numIter for m in models)      # 7 find the first centres of one k
    found = label_many(rows, centres, [f"k{k}" for k in ks])
    sizes = {r["k9"]: r["count"] for r in found.groupBy("k9").count().collect()}
    assert [sizes[i] for i in range(9)] == models[-1].summary.clusterSizes


def test_k_means_with_fewer_points_than_clusters(spark):
    x = np.repeat([[0.0, 0.0], [1.0, 0.0], [0.0, 5.0]], [4, 1, 7], axis=0)
    two, five = fit_many(_points(spark, x).coalesce(1), [2, 5])
    assert sorted(map(tuple, five)) == [(0.0, 0.0), (0.0, 5.0), (1.0, 0.0)]
    assert sorted(map(tuple, two)) == [(0.0, 5.0), (0.2, 0.0)]


def test_cells_are_scanned_some_clusterings_at_a_time(spark, points, monkeypatch):
    """A task holds the cells of as many clusterings as fit and few distances; the ends are those of one scan for all."""
    x, c = points
    names = ["good", "poor", "single"]
    whole = S.euclidean_silhouette(_frame(spark, points), "x", names, most=32, limit=32, tolerance=1.0).collect()
    for r in whole:
        assert r["bound"] > 0 and abs(r["silhouette"] - _brute(x, c[r["clustering"]])) <= r["bound"] + 1e-6
    held = []
    scan = S._scan
    monkeypatch.setattr(S, "_scan", lambda p, m, k, cells: held.append([v["s"].size for v in cells.values()]) or scan(p, m, k, cells))
    monkeypatch.setattr(S, "NUMBERS", 200)
    monkeypatch.setattr(S, "DISTANCES", 150)
    assert S.euclidean_silhouette(_frame(spark, points), "x", names, most=32, limit=32, tolerance=1.0).collect() == whole
    assert sum(map(len, held)) == 3 and all(len(h) == 1 or sum(h) <= 200 for h in held) and len(held) > 1


def test_points_that_all_clusterings_put_together(spark, points):
    x, c = points
    df = _frame(spark, points).selectExpr("x", "good", "good as again", "single", "good as third")
    got = {r["clustering"]: r["silhouette"] for r in S.euclidean_silhouette(df, "x", ["good", "again", "single", "third"], exact=True).collect()}
    for k, of in (("good", "good"), ("again", "good"), ("single", "single"), ("third", "good")):
        assert got[k] == pytest.approx(_brute(x, c[of]), abs=2e-6)

"""Dominant values, sweep elimination, complete linkage, incremental components and Hopkins against brute force."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from casebook.operators import hierarchy as H
from casebook.operators import models as M
from casebook.operators import quality as Q
from casebook.operators import sweep as S
from casebook.operators.incremental import IncrementalPCA, combine, of_rows
from casebook.operators.stats import moment_matrix, vif_values


def test_dominant_values(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" if rng.random() < 0.95 else f"y{i}", None if i % 10 else 5, i % 2 == 0, None, float(i % 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, s string, sparse int, half boolean, none string, `a.b` double").repartition(7)
    got = {r["column"]: (r["value"], r["n"]) for r in Q.dominant_values(df, 0.9).collect()}
    assert got == {"s": ("x", sum(r[1] == "x" for r in rows)), "sparse": ("5", 200)}
    half = {r["column"]: (r["value"], r["n"], r["share"]) for r in Q.dominant_values(df, 0.5).collect()}
    assert half["half"] == ("false", 1000, 0.5) and set(half) == {"s", "sparse", "half"}
    assert Q.drop_dominant(df, 0.9)[1] == ["s", "sparse", "none"]
    assert Q.dominant_values(df.limit(0), 0.9).collect() == []


def _refit(x, y, names, p_max, vif_max):
    """The elimination with a least-squares fit each round."""
    left, out = list(range(len(names))), []
    while len(left) > 1:
        r = np.corrcoef(x[:, left].T)
        vifs = vif_values(r)
        k = max(range(len(left)), key=lambda i: (vifs[i], -i))
        if vifs[k] > vif_max:
            out.append((names[left.pop(k)], "vif"))
            continue
        a = np.column_stack([x[:, left], np.ones(len(x))])
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ beta
        se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (e @ e) / (len(x) - len(left) - 1))
        t = np.abs(beta / se)[:-1]
        k = int(np.argmin(t))
        if S.t_two_sided(t[k], len(x) - len(left) - 1) <= p_max:
            break
        out.append((names[left.pop(k)], "p_value"))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_elimination_equals_refitting(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 7))
    x[:, 3] = x[:, 0] + 0.1 * x[:, 3]
    x[:, 5] = x[:, 1] - x[:, 2] + 0.3 * x[:, 5]
    y = 2 * x[:, 0] - x[:, 1] + 0.15 * x[:, 4] + rng.normal(size=150)
    names = [f"f{i}" for i in range(7)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*names, "y"])
    got = [(r["dropped"], r["reason"]) for r in M.backward_eliminate(df, names, "y").collect()]
    assert got == [*_refit(x, y, names, 0.05, 5.0), (None, "final")]


def test_sweep_table_and_dependent_features(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.0] + 3 + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, r), float(r[0] + r[1]), 4.0, float(v)) for r, v in zip(x, y)], ["a", "b", "c", "sum", "one", "y"])
    sweep = S.Sweep(S.CrossProducts(df, ["a", "b", "c"], "y"))
    assert sweep.add_all(range(3)) == []
    m = np.column_stack([x, np.ones(80)])
    beta, rss, *_ = np.linalg.lstsq(m, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * rss[0] / 76)
    table = sweep.table()
    assert [r[1] for r in table] == pytest.approx(beta) and [r[2] for r in table] == pytest.approx(se)
    assert sweep.r2() == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    before = sweep.m.copy()
    sweep.toggle(1), sweep.toggle(1)
    assert np.allclose(sweep.m, before)
    rounds = M.backward_eliminate(df, ["a", "b", "c", "sum", "one"], "y").collect()
    assert rounds[0]["dropped"] == "one" and rounds[0]["value"] is None
    assert rounds[1]["dropped"] == "a" and rounds[1]["value"] == math.inf
    nulls = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0, float("nan"))], df.schema))
    assert S.CrossProducts(nulls, ["a", "b", "c"], "y").n == 80


def test_t_distribution():
    """Against the density, integrated over the angle atan(t / sqrt(df))."""
    for t, df in [(0.0, 5), (0.3, 2), (2.0, 10), (1.96, 1e5), (12.706205, 1), (-2.570582, 5), (40.0, 3), (7.0, 400)]:
        angle = (np.arange(400_000) + 0.5) / 400_000 * math.pi / 2
        density = np.exp((df - 1) * np.log(np.cos(angle)))
        want = density[angle > math.atan(abs(t) / math.sqrt(df))].sum() / density.sum()
        assert S.t_two_sided(t, df) == pytest.approx(want, rel=2e-3, abs=1e-12)
    assert S.t_two_sided(math.inf, 3) == 0 and math.isnan(S.t_two_sided(1.0, 0))


def _complete(points, k):
    groups = [[i] for i in range(len(points))]
    far = lambda a, b: max(np.linalg.norm(points[i] - points[j]) for i in a for j in b)
    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: far(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("k", [1, 3, 8, 70])
def test_complete_linkage_equals_brute_force(spark, k):
    x = np.random.default_rng(4).normal(size=(60, 3)).round(3)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame([*rows, (60, rows[5][1]), (61, None), (62, [1.0, float("nan"), 2.0])], "id long, v array<double>")
    found, heights = H.cluster(df.repartition(5), "v", k)
    got = {}
    for r in found.collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert got.pop(None) == {61, 62} and sorted(got) == list(range(min(k, 60)))
    want = {g | {60} if 5 in g else g for g in _complete(x, k)}
    assert {frozenset(g) for g in got.values()} == want
    assert heights == sorted(heights) and len(heights) == 59


def test_summaries_are_bounded_and_cover(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 2)) * 50
    x = np.vstack([c + rng.normal(size=(300, 2)) for c in centres])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, v array<double>").repartition(40)
    balls = H.summaries(df, "v", 50)
    assert len(balls.n) <= 50 and balls.n.sum() == 1200
    assert all((np.linalg.norm(balls.centre - p, axis=1) <= balls.radius + 1e-9).any() for p in x)
    found, _ = H.cluster(df, "v", 4, most=50)
    by = {}
    for r in found.collect():
        by.setdefault(r["id"] // 300, set()).add(r["cluster"])
    assert all(len(s) == 1 for s in by.values()) and len(set.union(*by.values())) == 4
    assert H.cluster(df.limit(0), "v", 4)[0].count() == 0


def test_incremental_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6)) @ rng.normal(size=(6, 6)) + 1e4
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(900, None)], "id long, v array<double>").repartition(40)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    parts = [df.where("id < 100"), df.where("id BETWEEN 100 AND 101"), df.where("id > 101")]
    for order in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        model = IncrementalPCA()
        for i in order:
            model.partial_fit(parts[i], "v")
        assert model.state[0] == 900
        assert model.eigen()[0] == pytest.approx(values, rel=1e-9)
    p = np.array([r["pca"] for r in model.transform(df, "v", 3).where("pca IS NOT NULL").collect()])
    assert np.cov(p.T) == pytest.approx(np.diag(values[:3]), abs=1e-8 * values[0])
    assert combine(None, of_rows(x[:1]))[0] == 1 and IncrementalPCA().partial_fit(df.limit(0), "v").state is None


def test_hopkins_counts_copies(spark):
    vec = lambda rows: spark.createDataFrame([(r,) for r in rows], "a array<double>").select(array_to_vector("a").alias("v"))
    corner = [[float(a), float(b), float(c)] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    copies = M.hopkins(vec(corner * 50), "v").first()
    assert copies["hopkins"] == 1.0 and copies["n_sampled"] == 40
    x = np.random.default_rng(2).random((200, 2))
    plain = M.hopkins(vec(x.tolist()), "v", m=60, seed=5).first()
    assert 0.4 < plain["hopkins"] < 0.65
    assert M.hopkins(vec(corner).limit(0), "v").first()["hopkins"] is None


def test_moments_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert vif_values(moment_matrix(df, ["a", "b"])) == [None, None]

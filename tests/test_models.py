"""Model operators against numpy closed forms (sklearn / statsmodels are not installed)."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from casebook.operators import models as M
from casebook.operators import stats as ST
from casebook.plans.tables import t
from tests.conftest import SF_SMALL

FEATS = ["l_quantity", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def lines(spark):
    li = t(spark, SF_SMALL, "lineitem").select("l_extendedprice", *FEATS)
    pdf = li.toPandas()
    return li, pdf


def test_ols_matches_normal_equations(lines):
    li, pdf = lines
    X = np.column_stack([pdf[FEATS].to_numpy(), np.ones(len(pdf))])
    beta, *_ = np.linalg.lstsq(X, pdf["l_extendedprice"].to_numpy(), rcond=None)
    got = {r["term"]: r["coef"] for r in M.ols_summary(li, FEATS, "l_extendedprice", digits=9).collect()}
    ref = dict(zip(FEATS + ["const"], beta))
    for k in ref:
        assert got[k] == pytest.approx(ref[k], rel=1e-6, abs=1e-6)


def test_vif_matches_inverse_correlation(lines):
    li, pdf = lines
    R = np.corrcoef(pdf[FEATS].to_numpy().T)
    ref = dict(zip(FEATS, np.diag(np.linalg.inv(R))))
    got = {r["feature"]: r["vif"] for r in ST.vif(li, FEATS).collect()}
    for k in FEATS:
        assert got[k] == pytest.approx(ref[k], rel=1e-6)


def test_corr_long_symmetric_with_unit_diagonal(lines):
    li, _ = lines
    rows = {(r["a"], r["b"]): r["corr"] for r in ST.corr_long(li, FEATS).collect()}
    for a in FEATS:
        assert rows[(a, a)] == 1.0
        for b in FEATS:
            assert rows[(a, b)] == rows[(b, a)]


def test_pca_explained_variance_matches_eigh(spark):
    e = t(spark, SF_SMALL, "embeddings")
    X = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], dtype=np.float64)
    ev = np.sort(np.linalg.eigvalsh(np.cov(X.T)))[::-1]
    ref = ev[:5] / ev.sum()
    model, centred = M.pca_fit(e.select(array_to_vector("embedding").alias("vec")), "vec", 5)
    got = np.array([float(x) for x in model.explainedVariance])
    assert np.allclose(got, ref, atol=1e-6)
    # components are orthogonal: off-diagonal correlations of the projections vanish
    proj = model.transform(centred).select(F.col("pca"))
    P = np.array([r["pca"].toArray() for r in proj.collect()])
    C = np.corrcoef(P.T)
    assert np.max(np.abs(C - np.eye(5))) < 1e-6


def test_kmeans_sizes_and_hopkins_range(spark):
    e = t(spark, SF_SMALL, "embeddings").select("vec_id", array_to_vector("embedding").alias("vec"))
    n = e.count()
    sizes = M.kmeans(e, "vec", 4).transform(e).groupBy("prediction").count().collect()
    assert sum(r["count"] for r in sizes) == n
    h = M.hopkins(e, "vec", m=20).first()
    assert 0.0 <= h["hopkins"] <= 1.0 and h["n_probes"] == 20


def test_rfe_keeps_n(lines):
    li, _ = lines
    r = M.rfe(li, FEATS, "l_extendedprice", n=2).collect()
    assert sum(1 for x in r if x["kept"]) == 2
    assert sorted(x["rank"] for x in r) == [1, 1, 2]


def test_text_features_are_stored_once(spark):
    from casebook.plans import models_q
    assert models_q.docs(spark, SF_SMALL).inputFiles() == []       # fits do not go back to the texts

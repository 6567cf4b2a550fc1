"""Model fitting on Spark ML, plus the driver loops the analyses ran by hand
(RFE, backward elimination, k sweeps). Every fit is a distributed job; the
driver only iterates over features or k values (a bounded list) and keeps
model summaries (coefficients, k×k matrices), never data rows.

Differences from the single-machine libraries, stated once:
* Spark's PCA projects without centring → :func:`pca_fit` centres first;
* Spark's ``LogisticRegression`` has no ``class_weight``: balanced weights are a
  ``weightCol`` of ``n / (2 · n_class)``;
* kernel machines are in :mod:`casebook.operators.kernel`, grid searches in one
  batch of fits in :mod:`casebook.operators.grids`;
* complete-linkage clusters are in :mod:`casebook.operators.hierarchy`;
* ``ClusteringEvaluator`` uses squared Euclidean distance for silhouette; the Euclidean one is in
  :mod:`casebook.operators.silhouette`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.operators.grids import Setting, search
from casebook.operators.stats import corr_matrix, vif_values
from casebook.operators.sweep import CrossProducts, eliminate
from casebook.session import cut_lineage


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Features as one vector; a NULL or NaN raises, so callers fill or drop it by their own rule."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """sklearn ``class_weight='balanced'``: n / (n_classes · n_c), from one grouped count."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.select(F.count(F.lit(1))).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    w = counts.select(label, (n / (k * F.col("_nc"))).alias(out))
    return df.join(w, label)


# ------------------------------------------------------------------ PCA
def pca_fit(df: DataFrame, vec: str, k: int, with_scaler: bool = False):
    """Centre (mean only), then fit PCA with k components.

    Returns (model, centred df), plus the fitted centring step when
    ``with_scaler`` so other frames (test rows) are centred by the train means."""
    sc = StandardScaler(inputCol=vec, outputCol="_centred", withMean=True, withStd=False).fit(df)
    centred = sc.transform(df)
    model = PCA(k=k, inputCol="_centred", outputCol="pca").fit(centred)
    return (model, centred, sc) if with_scaler else (model, centred)


def pca_scree(spark: SparkSession, model) -> DataFrame:
    ev = [float(x) for x in model.explainedVariance]
    cum = np.cumsum(ev).tolist()
    return spark.createDataFrame([(i + 1, round(e, 6), round(c, 6)) for i, (e, c) in enumerate(zip(ev, cum))],
                                 "component int, explained_ratio double, cumulative double")


def pca_loadings(spark: SparkSession, model, names: Sequence[str], n_pc: int = 2) -> DataFrame:
    """Loadings of each input feature on the first ``n_pc`` components; each
    component's sign is fixed so its largest absolute loading is positive."""
    pc = np.array(model.pc.toArray()[:, :n_pc], copy=True)
    for j in range(pc.shape[1]):
        if pc[np.argmax(np.abs(pc[:, j])), j] < 0:
            pc[:, j] = -pc[:, j]
    rows = [(names[i], *[round(float(pc[i, j]), 6) for j in range(pc.shape[1])]) for i in range(pc.shape[0])]
    schema = "feature string, " + ", ".join(f"pc{j + 1} double" for j in range(pc.shape[1]))
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ linear / logistic fits
def glm_binomial_summary(df: DataFrame, features: Sequence[str], label: str, digits: int = 6) -> DataFrame:
    """Binomial GLM (logit) with coefficient, std error, z and p per term."""
    data = assemble(df, features)
    m = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features",
                                    labelCol=label, maxIter=50).fit(data)
    s = m.summary
    names = list(features) + ["const"]
    coefs = list(m.coefficients) + [m.intercept]
    rows = [(n, round(float(c), digits), round(float(se), digits), round(float(z), digits), round(float(p), digits))
            for n, c, se, z, p in zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, std_err double, z double, p_value double")


def ols_summary(df: DataFrame, features: Sequence[str], label: str, digits: int = 6) -> DataFrame:
    """OLS (normal equations) with coef, std error, t, p per term, and R² / adj. R²."""
    data = assemble(df, features)
    m = LinearRegression(featuresCol="features", labelCol=label, solver="normal").fit(data)
    s = m.summary
    names = list(features) + ["const"]
    coefs = list(m.coefficients) + [m.intercept]
    rows = [(n, round(float(c), digits), round(float(se), digits), round(float(tv), digits), round(float(p), digits),
             round(float(s.r2), digits), round(float(s.r2adj), digits))
            for n, c, se, tv, p in zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(
        rows, "term string, coef double, std_err double, t double, p_value double, r2 double, adj_r2 double")


def backward_eliminate(df: DataFrame, features: Sequence[str], label: str, family: str = "gaussian",
                       p_max: float = 0.05, vif_max: float = 5.0, max_rounds: int | None = None) -> DataFrame:
    """Repeatedly drop the worst feature: first any VIF above ``vif_max`` (largest first), then any p-value above
    ``p_max`` (largest first). One row per round: (round, dropped, reason, value, n_left). Least squares are swept on
    one cross-product matrix (:mod:`casebook.operators.sweep`); a binomial model is fitted again each round."""
    feats = list(features)
    if family == "gaussian":
        rounds = eliminate(CrossProducts(df, feats, label), p_max, vif_max, max_rounds)      # one scan in all
        return df.sparkSession.createDataFrame(rounds, "round int, dropped string, reason string, value double, n_left int")
    out = []
    rnd = 0
    whole = corr_matrix(df, feats)          # one pass; every round's VIFs are of its sub-matrices
    place = {f: i for i, f in enumerate(feats)}
    while len(feats) > 1 and (max_rounds is None or rnd < max_rounds):
        rnd += 1
        some = [place[f] for f in feats]
        vifs = vif_values(whole[np.ix_(some, some)])
        worst, high = max(zip(feats, vifs), key=lambda r: math.inf if r[1] is None else r[1])
        if high is None or high > vif_max:
            feats.remove(worst)
            out.append((rnd, worst, "vif", None if high is None else round(high, 6), len(feats)))
            continue
        summ = glm_binomial_summary(df, feats, label).where("term <> 'const'").collect()
        worst_p = max(summ, key=lambda r: (r["p_value"] if r["p_value"] is not None else math.inf))
        if worst_p["p_value"] is not None and worst_p["p_value"] <= p_max:
            break
        feats.remove(worst_p["term"])
        out.append((rnd, worst_p["term"], "p_value", worst_p["p_value"], len(feats)))
    out.append((rnd + 1, None, "final", None, len(feats)))
    return df.sparkSession.createDataFrame(out, "round int, dropped string, reason string, value double, n_left int")


def rfe(df: DataFrame, features: Sequence[str], label: str, n: int, estimator: str = "linear") -> DataFrame:
    """Recursive feature elimination on standardised features: fit, drop the
    smallest |coefficient|, repeat until ``n`` remain. Rows (feature, kept, rank),
    rank 1 for the kept ones, then by elimination order (last dropped = 2).

    The linear fits are all solved from one correlation matrix, so the data is
    read once; the logistic fits read the standardised features, stored once."""
    feats = list(features)
    if estimator == "linear":
        moments = np.nan_to_num(corr_matrix(df, [*feats, label]))      # a constant feature has coefficient 0

        def weights(active):
            return np.linalg.lstsq(moments[np.ix_(active, active)], moments[active, -1], rcond=1e-12)[0]
    else:
        data = assemble(df, feats, "_raw")
        data = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True).fit(data).transform(data)
        data = cut_lineage(data.select(label, vector_to_array("_std").alias("_arr")))

        def weights(active):
            sub = data.select(label, array_to_vector(F.array(*[F.col("_arr")[i] for i in active])).alias("features"))
            return LogisticRegression(featuresCol="features", labelCol=label, maxIter=100).fit(sub).coefficients.toArray()
    order = []
    active = list(range(len(feats)))
    while len(active) > n:
        drop = active[int(np.argmin(np.abs(weights(active))))]
        order.append(drop)
        active.remove(drop)
    ranks = {i: 1 for i in active}
    for r, i in enumerate(reversed(order)):
        ranks[i] = r + 2
    rows = [(feats[i], ranks[i] == 1, ranks[i]) for i in range(len(feats))]
    return df.sparkSession.createDataFrame(rows, "feature string, kept boolean, rank int")


def fit_linear(train: DataFrame, features: Sequence[str], label: str):
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                            LinearRegression(featuresCol="features", labelCol=label, solver="normal")]).fit(train)


def logistic_balanced(train: DataFrame, features: Sequence[str], label: str, reg: float = 0.0):
    w = balanced_weights(train, label)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                            LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight",
                                               regParam=reg, maxIter=100)])
    return pipe.fit(w)


def linear_svm(train: DataFrame, features: Sequence[str], label: str, reg: float = 0.01):
    w = balanced_weights(train, label)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                            LinearSVC(featuresCol="features", labelCol=label, weightCol="weight", regParam=reg,
                                      maxIter=100)])
    return pipe.fit(w)


def grid_search(train: DataFrame, features: Sequence[str], label: str, reg_params: Sequence[float],
                elastic: Sequence[float], folds: int = 3, seed: int = 11, balanced: bool = False) -> DataFrame:
    """k-fold grid search of a scaled logistic regression; one row per grid point with the mean AUC, and ``best`` marking
    the winner. All points and folds are fitted together (:mod:`casebook.operators.grids`)."""
    grid = [Setting("logistic", reg=r, elastic=e) for r in reg_params for e in elastic]
    rows = [(float(s.reg), float(s.elastic), auc, best) for s, auc, best in search(train, features, label, grid, folds, seed, balanced)]
    return train.sparkSession.createDataFrame(rows, "reg_param double, elastic_net double, mean_auc double, best boolean")


def grid_search_kernel(train: DataFrame, features: Sequence[str], label: str, cs: Sequence[float], gammas: Sequence[float],
                       folds: int = 3, seed: int = 11, balanced: bool = True, m: int = 32) -> DataFrame:
    """The same for an RBF machine (squared hinge loss on ``m`` landmark features) over (C, gamma)."""
    grid = [Setting("hinge2", c=c, gamma=g) for c in cs for g in gammas]
    rows = [(float(s.c), float(s.gamma), auc, best) for s, auc, best in search(train, features, label, grid, folds, seed, balanced, m)]
    return train.sparkSession.createDataFrame(rows, "c double, gamma double, mean_auc double, best boolean")


def grid_search_models(train: DataFrame, features: Sequence[str], label: str, svm_reg: Sequence[float],
                       depths: Sequence[int], trees: Sequence[int], folds: int = 3, seed: int = 11,
                       parallelism: int = 2) -> DataFrame:
    """k-fold grid search of a scaled linear SVM and of a random forest; one row per
    setting with the mean AUC, ``best`` marks the winner of each model."""
    scaled = [VectorAssembler(inputCols=list(features), outputCol="raw"),
              StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]
    svm = LinearSVC(featuresCol="features", labelCol=label, maxIter=50)
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed)
    searches = [("svm", svm, ParamGridBuilder().addGrid(svm.regParam, list(svm_reg))),
                ("forest", forest, ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(trees)))]
    rows = []
    for name, model, grid in searches:
        maps = grid.build()
        cv = CrossValidator(estimator=Pipeline(stages=[*scaled, model]), estimatorParamMaps=maps, numFolds=folds, seed=seed,
                            parallelism=parallelism, evaluator=BinaryClassificationEvaluator(labelCol=label)).fit(train)
        best = int(np.argmax(cv.avgMetrics))
        for i, (params, score) in enumerate(zip(maps, cv.avgMetrics)):
            setting = ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda x: x[0].name))
            rows.append((name, setting, round(float(score), 6), i == best))
    return train.sparkSession.createDataFrame(rows, "model string, setting string, mean_auc double, best boolean")


def decision_tree_rules(train: DataFrame, features: Sequence[str], label: str, depth: int = 3) -> DataFrame:
    data = assemble(train, features)
    m = DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=depth, seed=5).fit(data)
    text = m.toDebugString
    for i, f in enumerate(features):
        text = text.replace(f"feature {i} ", f"{f} ")
    lines = [ln for ln in text.splitlines() if ln.strip()]
    return train.sparkSession.createDataFrame([(i + 1, ln) for i, ln in enumerate(lines)], "line int, rule string")


def random_forest(train: DataFrame, features: Sequence[str], label: str, n_trees: int = 50, depth: int = 6,
                  min_leaf: int = 5, subset: str = "sqrt", weighted: bool = True, seed: int = 13):
    data = assemble(balanced_weights(train, label) if weighted else train, features)
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=n_trees, maxDepth=depth,
                                minInstancesPerNode=min_leaf, featureSubsetStrategy=subset, seed=seed,
                                weightCol="weight" if weighted else None)
    return rf.fit(data)


def feature_importance(spark: SparkSession, model, names: Sequence[str], digits: int = 6) -> DataFrame:
    imp = model.featureImportances.toArray()
    rows = [(names[i], round(float(v), digits)) for i, v in enumerate(imp) if v > 0]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


# ------------------------------------------------------------------ clustering
def kmeans(df: DataFrame, vec: str, k: int, seed: int = 100, max_iter: int = 50):
    return KMeans(featuresCol=vec, k=k, seed=seed, maxIter=max_iter).fit(df)


def elbow(df: DataFrame, vec: str, ks: Sequence[int], seed: int = 100) -> DataFrame:
    """Within-cluster sum of squares per k (k = 1 is the total sum of squares)."""
    rows = []
    for k in ks:
        if k == 1:
            mean = df.select(vector_to_array(vec).alias("a")).select(
                F.array(*[F.avg(F.col("a")[i]) for i in range(_dim(df, vec))]).alias("m")).first()["m"]
            m = F.array(*[F.lit(float(x)) for x in mean])
            cost = df.select(F.aggregate(F.zip_with(vector_to_array(vec), m, lambda a, b: (a - b) * (a - b)),
                                         F.lit(0.0), lambda acc, x: acc + x).alias("d")).agg(F.sum("d")).first()[0]
        else:
            cost = kmeans(df, vec, k, seed).summary.trainingCost
        rows.append((k, round(float(cost), 4)))
    return df.sparkSession.createDataFrame(rows, "k int, cost double")


def _dim(df: DataFrame, vec: str) -> int:
    return len(df.select(vec).first()[0])


def silhouette(df: DataFrame, vec: str, ks: Sequence[int], seed: int = 100) -> DataFrame:
    ev = ClusteringEvaluator(featuresCol=vec, predictionCol="prediction")
    rows = [(k, round(float(ev.evaluate(kmeans(df, vec, k, seed).transform(df))), 6)) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def hopkins(df: DataFrame, vec: str, m: int | None = None, seed: int = 3, share: float = 0.1, most: int = 20_000) -> DataFrame:
    """Hopkins statistic H = Σu / (Σu + Σw) over two sets of probes: places drawn evenly from the bounding box, and
    rows of the data, whose own row is left out once (a copy of the row is a neighbour at distance 0).

    There are ``m`` probes of each kind, or ``share`` of the rows, at most ``most`` (a documented sample size, as the
    probes go to every task). u and w are the distances to the nearest neighbour, as in ``NearestNeighbors`` on the rows;
    of an even place that is the nearest row. Every task returns the two least distances of each probe, combined by
    group: one scan, no join of the data with itself. Without rows, or where all distances are 0, H is NULL."""
    arr = df.select(vector_to_array(vec).alias("x"))
    n = arr.count()
    d = _dim(df, vec) if n else 0
    m = min(n, most, max(1, int(n * share))) if m is None else min(m, most)
    bounds = arr.select(*[F.min(F.col("x")[i]).alias(f"lo{i}") for i in range(d)],
                        *[F.max(F.col("x")[i]).alias(f"hi{i}") for i in range(d)]).first() if n else {}
    lo = np.array([bounds[f"lo{i}"] for i in range(d)], dtype=np.float64)
    hi = np.array([bounds[f"hi{i}"] for i in range(d)], dtype=np.float64)
    probes = lo + np.random.default_rng(seed).random((m if n else 0, d)) * (hi - lo)
    # m rows in random order over the whole frame (a top-m, never a prefix)
    sample = [np.asarray(r["x"], dtype=np.float64) for r in arr.orderBy(F.rand(seed)).limit(m).collect()] if n else []
    W = np.stack(sample) if sample else np.zeros((0, d))
    P = np.vstack([probes, W])
    kinds = np.array([0] * len(probes) + [1] * len(W))

    def part(batches):
        best = np.full((len(P), 2), np.inf)
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                X = np.stack(pdf["x"].iloc[i:i + 1024].to_numpy()).astype(np.float64)
                for a in range(0, len(P), 1024):
                    own = P[a:a + 1024]
                    sq = (own ** 2).sum(axis=1)[:, None] + (X ** 2).sum(axis=1)[None, :]
                    D = sq - 2 * own @ X.T                           # squared distances without a probes x rows x columns array
                    D = np.sqrt(np.where(D < 1e-12 * (1 + sq), 0, D))
                    best[a:a + 1024] = np.sort(np.hstack([best[a:a + 1024], D]), axis=1)[:, :2]
        yield pd.DataFrame({"probe": np.arange(len(P), dtype=np.int32), "kind": kinds.astype(np.int32), "d1": best[:, 0], "d2": best[:, 1]})

    two = arr.mapInPandas(part, "probe int, kind int, d1 double, d2 double").groupBy("probe", "kind").agg(
        F.sort_array(F.flatten(F.collect_list(F.array("d1", "d2")))).alias("d")) if len(P) else \
        df.sparkSession.createDataFrame([], "probe int, kind int, d array<double>")
    mins = two.select("kind", F.when(F.col("kind") == 0, F.col("d")[0]).otherwise(F.col("d")[1]).alias("d"))
    s = mins.agg(F.sum(F.when(F.col("kind") == 0, F.col("d"))).alias("u"),
                 F.sum(F.when(F.col("kind") == 1, F.col("d"))).alias("w"))
    return s.select(F.round(F.try_divide(F.col("u"), F.col("u") + F.col("w")), 6).alias("hopkins"),
                    F.lit(len(probes)).alias("n_probes"), F.lit(len(W)).alias("n_sampled"))


def slice_pca(df: DataFrame, col: str, k: int, out: str = "features") -> DataFrame:
    return VectorSlicer(inputCol=col, outputCol=out, indices=list(range(k))).transform(df)

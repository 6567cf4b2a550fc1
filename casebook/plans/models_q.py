"""2.16 model fits. Least squares and two-column PCA have SQL (projections, closed forms); the iterative and
seeded fits are checked by rows only.

Stand-ins: regression on lineitem ⋈ part (target l_extendedprice), classification
on labels ⋈ documents (target quality, features derived from the whole text),
PCA and clustering on the 64-d embeddings.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from casebook.functions.strings import keyword_hits
from casebook.operators import aggregates as A
from casebook.operators import models as M
from casebook.operators.features import one_hot
from casebook.operators.hierarchy import cluster
from casebook.operators.incremental import IncrementalPCA
from casebook.operators.kernel import fit_kernel_svm
from casebook.operators.silhouette import euclidean_silhouette, kmeans_silhouette
from casebook.operators.splits import split_hash
from casebook.operators.sweep import CrossProducts, Sweep
from casebook.plans.registry import query
from casebook.plans.sqlfn import rnd
from casebook.plans.strings_q import KEYWORDS
from casebook.plans.tables import t
from casebook.session import cut_lineage

DOC_FEATURES = ["log_chars", "n_lines", "words_per_line", "hits_per_kchar", "digit_share", "upper_share",
                "lang_en", "lang_es", "lang_fr"]
CAR_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice",
                "type_LARGE", "type_MEDIUM", "type_PROMO", "type_SMALL", "type_STANDARD"]


def docs(spark, d):
    """labels ⋈ documents with numeric text features (whole texts), stored once: every fit makes many passes, and the
    texts are to be read in one of them only."""
    lab, dc = t(spark, d, "labels"), t(spark, d, "documents")
    j = lab.join(dc, "doc_id")
    n = F.greatest(F.col("n_chars").cast("double"), F.lit(1.0))
    lines = F.size(F.split("text", "\n")).cast("double")
    words = F.size(F.split("text", r"\s+")).cast("double")
    out = j.select("doc_id", F.col("quality").alias("label"), "lang",
                   F.log1p("n_chars").alias("log_chars"), lines.alias("n_lines"), (words / lines).alias("words_per_line"),
                   (keyword_hits("text", KEYWORDS) * 1000.0 / n).alias("hits_per_kchar"),
                   (F.length(F.regexp_replace("text", "[^0-9]", "")) / n).alias("digit_share"),
                   (F.length(F.regexp_replace("text", "[^A-Z]", "")) / n).alias("upper_share"))
    return cut_lineage(one_hot(out, ["lang"], prefix={"lang": "lang"}, drop_first=True, levels={"lang": ["de", "en", "es", "fr"]}))


def cars(spark, d):
    li, p = t(spark, d, "lineitem"), t(spark, d, "part")
    j = li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_type")
    j = j.withColumn("row_key", F.concat_ws("|", "l_orderkey", "l_linenumber", "p_retailprice", "l_quantity"))
    return one_hot(j, ["p_type"], prefix={"p_type": "type"}, drop_first=True,
                   levels={"p_type": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]})


def embeddings(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", "label", array_to_vector("embedding").alias("vec"))


@query("ml_pca_scree")
def ml_pca_scree(spark, d):
    model, _ = M.pca_fit(embeddings(spark, d), "vec", 64)
    return M.pca_scree(spark, model)


@query("ml_pca_loadings")
def ml_pca_loadings(spark, d):
    model, _ = M.pca_fit(embeddings(spark, d), "vec", 2)
    return M.pca_loadings(spark, model, [f"dim{i}" for i in range(64)], n_pc=2)


@query("ml_pca_transform")
def ml_pca_transform(spark, d):
    model, centred = M.pca_fit(embeddings(spark, d), "vec", 4)
    out = model.transform(centred).select("vec_id", vector_to_array("pca").alias("p"))
    return out.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"pc{i + 1}") for i in range(4)])


@query("ml_pca_logit_sweep")
def ml_pca_logit_sweep(spark, d):
    e = embeddings(spark, d).withColumn("y", (F.col("label") < 5).cast("double"))
    train, test = split_hash(e, "vec_id", 30)
    ks = list(range(5, 60))
    # PCA is fitted once at the largest k on train; each k takes the first k components
    model, centred_train, scaler = M.pca_fit(train, "vec", max(ks), with_scaler=True)
    tr = model.transform(centred_train)
    te = model.transform(scaler.transform(test))
    ev = BinaryClassificationEvaluator(labelCol="y")
    rows = []
    for k in ks:
        trk, tek = M.slice_pca(tr, "pca", k), M.slice_pca(te, "pca", k)
        lr = LogisticRegression(featuresCol="features", labelCol="y", maxIter=100).fit(trk)
        rows.append((k, round(ev.evaluate(lr.transform(trk)), 6), round(ev.evaluate(lr.transform(tek)), 6)))
    return spark.createDataFrame(rows, "k int, train_auc double, test_auc double")


@query("ml_logistic_balanced")
def ml_logistic_balanced(spark, d):
    dd = docs(spark, d)
    train, test = split_hash(dd, "doc_id", 30)
    model = M.logistic_balanced(train, DOC_FEATURES, "label")
    out = model.transform(test)
    return out.select("doc_id", "label", F.round(vector_to_array("probability")[1], 6).alias("p_good"),
                      F.col("prediction").cast("int").alias("prediction"))


@query("ml_glm_binomial")
def ml_glm_binomial(spark, d):
    return M.glm_binomial_summary(docs(spark, d), DOC_FEATURES, "label")


@query("ml_backward_elimination")
def ml_backward_elimination(spark, d):
    return M.backward_eliminate(cars(spark, d), CAR_FEATURES, "l_extendedprice", family="gaussian",
                                p_max=0.05, vif_max=5.0)


_THREE_SQL = """s AS (SELECT count(*) AS n, var_pop(l_quantity) AS a, var_pop(l_tax) AS b, var_pop(l_discount) AS c, covar_pop(l_quantity, l_tax) AS d,
             covar_pop(l_quantity, l_discount) AS e, covar_pop(l_tax, l_discount) AS f, covar_pop(l_quantity, l_extendedprice) AS p,
             covar_pop(l_tax, l_extendedprice) AS q, covar_pop(l_discount, l_extendedprice) AS r, var_pop(l_extendedprice) AS v FROM lineitem),
i AS (SELECT *, a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e) AS det FROM s),
j AS (SELECT *, (b * c - f * f) / det AS i11, (e * f - d * c) / det AS i12, (d * f - b * e) / det AS i13,
             (a * c - e * e) / det AS i22, (d * e - a * f) / det AS i23, (a * b - d * d) / det AS i33 FROM i),
k AS (SELECT *, i11 * p + i12 * q + i13 * r AS b1, i12 * p + i22 * q + i23 * r AS b2, i13 * p + i23 * q + i33 * r AS b3 FROM j),
u AS (SELECT *, (v - b1 * p - b2 * q - b3 * r) / (n - 4) AS mse FROM k),
w AS (SELECT 'l_quantity' AS term, b1 AS coef, sqrt(mse * i11) AS se, a * i11 AS vif FROM u
      UNION ALL SELECT 'l_tax', b2, sqrt(mse * i22), b * i22 FROM u UNION ALL SELECT 'l_discount', b3, sqrt(mse * i33), c * i33 FROM u)"""


@query("ml_sweep_three_features", f"""WITH {_THREE_SQL}
SELECT term, {rnd("coef", 3)} AS coef, {rnd("se", 3)} AS std_err, {rnd("coef / se", 3)} AS t, {rnd("vif", 6)} AS vif FROM w""")
def ml_sweep_three_features(spark, d):
    """First round of an elimination over three features, from the swept cross products."""
    products = CrossProducts(t(spark, d, "lineitem"), ["l_quantity", "l_tax", "l_discount"], "l_extendedprice")
    sweep = Sweep(products)
    sweep.add_all(range(3))
    rows = [(f, coef, se, stat, sweep.vif(products.features.index(f))) for f, coef, se, stat, _ in sweep.table() if f != "const"]
    out = spark.createDataFrame(rows, "term string, coef double, std_err double, t double, vif double")
    return out.select("term", *[F.round(c, 3).alias(c) for c in ("coef", "std_err", "t")], F.round("vif", 6).alias("vif"))


@query("ml_rfe_linear")
def ml_rfe_linear(spark, d):
    return M.rfe(cars(spark, d), CAR_FEATURES, "l_extendedprice", n=4, estimator="linear")


@query("ml_rfe_logistic")
def ml_rfe_logistic(spark, d):
    return M.rfe(docs(spark, d), DOC_FEATURES, "label", n=3, estimator="logistic")


def _car_fit(spark, d):
    c = cars(spark, d)
    train, test = split_hash(c, "row_key", 30)
    return M.fit_linear(train, CAR_FEATURES, "l_extendedprice"), test


def _least_squares_sql() -> str:
    """CTEs down to ``fit``: every row with the residual of its target under the least-squares fit on the training rows.

    One feature after the other (the constant first) is projected out of the later ones and the target, with
    weights from training rows only; what is left of the target is the residual."""
    cols = ["1.0", *[f"CAST(({c}) AS DOUBLE)" for c in [
        "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice",
        *[f"CASE WHEN p_type = '{v}' THEN 1 ELSE 0 END" for v in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")]]]]
    n = len(cols)
    key = "l_orderkey || '|' || l_linenumber || '|' || p_retailprice || '|' || l_quantity"
    ctes = [f"""s0 AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice AS y,
  {", ".join(f"{c} AS x{i}" for i, c in enumerate(cols))},
  ('0x' || substr(md5({key}), 1, 8))::BIGINT % 100 < 30 AS held FROM lineitem JOIN part ON l_partkey = p_partkey)"""]
    for j in range(n):
        later = ["y", *[f"x{i}" for i in range(j + 1, n)]]
        ctes.append(f"""c{j} AS MATERIALIZED (SELECT {", ".join(f"coalesce(sum({v} * x{j}) / nullif(sum(x{j} * x{j}), 0), 0) AS w_{v}" for v in later)}
  FROM s{j} WHERE NOT held)""")
        ctes.append(f"""{f"s{j + 1}" if j + 1 < n else "fit"} AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_extendedprice, held,
  {", ".join(f"{v} - w_{v} * x{j} AS {v}" for v in later)} FROM s{j}, c{j})""")
    return ",\n".join(ctes)


@query("ml_predict_linear", f"""WITH {_least_squares_sql()}
SELECT l_orderkey, l_linenumber, l_extendedprice, {rnd("l_extendedprice - y", 2)} AS prediction FROM fit WHERE held""")
def ml_predict_linear(spark, d):
    model, test = _car_fit(spark, d)
    return model.transform(test).select("l_orderkey", "l_linenumber", "l_extendedprice",
                                        F.round("prediction", 2).alias("prediction"))


@query("ml_residuals", f"""WITH {_least_squares_sql()},
m AS (SELECT min(y) AS lo, max(y) AS hi, (max(y) - min(y)) / 20.0 AS w FROM fit WHERE held),
b AS (SELECT CASE WHEN y = hi THEN 20 ELSE CAST(floor((y - lo) / w) AS INTEGER) + 1 END AS bin, count(*) AS n FROM fit, m WHERE held GROUP BY ALL)
SELECT CAST(i AS INTEGER) AS bin, {rnd("lo + (i - 1) * w", 2)} AS bin_lo, {rnd("lo + i * w", 2)} AS bin_hi, coalesce(n, 0) AS n
FROM range(1, 21) r(i) CROSS JOIN m LEFT JOIN b ON b.bin = i""")
def ml_residuals(spark, d):
    model, test = _car_fit(spark, d)
    res = model.transform(test).select((F.col("l_extendedprice") - F.col("prediction")).alias("residual"))
    return A.histogram(res, "residual", n_bins=20).select("bin", F.round("bin_lo", 2).alias("bin_lo"), F.round("bin_hi", 2).alias("bin_hi"), "n")


@query("ml_ols_table", f"""
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x1, p_retailprice AS x2 FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS a, var_pop(x2) AS b, covar_pop(x1, x2) AS c,
             covar_pop(x1, y) AS p, covar_pop(x2, y) AS q, var_pop(y) AS v FROM d),
f AS (SELECT *, (b * p - c * q) / (a * b - c * c) AS b1, (a * q - c * p) / (a * b - c * c) AS b2 FROM s),
e AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, 1 - (v - b1 * p - b2 * q) / v AS r2, (v - b1 * p - b2 * q) / (n - 3) AS u FROM f),
r AS (SELECT 'l_quantity' AS term, b1 AS coef, sqrt(u * b / (a * b - c * c)) AS se, r2, n FROM e
      UNION ALL SELECT 'p_retailprice', b2, sqrt(u * a / (a * b - c * c)), r2, n FROM e
      UNION ALL SELECT 'const', b0, sqrt(u * (1 + (m1 * m1 * b - 2 * m1 * m2 * c + m2 * m2 * a) / (a * b - c * c))), r2, n FROM e)
SELECT term, {rnd("coef", 4)} AS coef, {rnd("se", 4)} AS std_err, {rnd("coef / se", 4)} AS t,
       {rnd("r2", 6)} AS r2, {rnd("1 - (1 - r2) * (n - 1) / (n - 3)", 6)} AS adj_r2 FROM r""")
def ml_ols_table(spark, d):
    out = M.ols_summary(cars(spark, d), ["l_quantity", "p_retailprice"], "l_extendedprice", digits=9)
    return out.select("term", *[F.round(c, 4).alias(c) for c in ("coef", "std_err", "t")],
                      *[F.round(c, 6).alias(c) for c in ("r2", "adj_r2")])


def _two_columns(spark, d):
    li = t(spark, d, "lineitem")
    return li.select(array_to_vector(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000)).alias("vec"))


_EIGEN = """s AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_extendedprice / 1000) AS b,
             var_pop(l_extendedprice / 1000) AS c FROM lineitem),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ^ 2 + b * b) AS l1 FROM s)"""


@query("ml_pca_scree_two_columns", f"""WITH {_EIGEN}
SELECT CAST(1 AS INTEGER) AS component, {rnd("l1 / (a + c)", 6)} AS explained_ratio, {rnd("l1 / (a + c)", 6)} AS cumulative FROM e
UNION ALL SELECT 2, {rnd("1 - l1 / (a + c)", 6)}, 1.0 FROM e""")
def ml_pca_scree_two_columns(spark, d):
    return M.pca_scree(spark, M.pca_fit(_two_columns(spark, d), "vec", 2)[0])


@query("ml_pca_loadings_two_columns", f"""WITH {_EIGEN},
u AS (SELECT b / sqrt(b * b + (l1 - a) ^ 2) AS x, (l1 - a) / sqrt(b * b + (l1 - a) ^ 2) AS y FROM e),
g AS (SELECT CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS f, CASE WHEN abs(x) > abs(y) THEN sign(x) ELSE -sign(y) END AS h, x, y FROM u)
SELECT 'quantity' AS feature, {rnd("f * x", 6)} AS pc1, {rnd("h * -y", 6)} AS pc2 FROM g
UNION ALL SELECT 'price', {rnd("f * y", 6)}, {rnd("h * x", 6)} FROM g""")
def ml_pca_loadings_two_columns(spark, d):
    model, _ = M.pca_fit(_two_columns(spark, d), "vec", 2)
    return M.pca_loadings(spark, model, ["quantity", "price"], n_pc=2)


def _two_batches(spark, d):
    """Model of the two columns, fitted on one half of the lines and updated with the other."""
    li = t(spark, d, "lineitem").select("l_linenumber", F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("x"))
    return IncrementalPCA().partial_fit(li.where("l_linenumber <= 2"), "x").partial_fit(li.where("l_linenumber > 2"), "x")


@query("ml_pca_incremental_scree", f"""WITH {_EIGEN}
SELECT CAST(1 AS INTEGER) AS component, {rnd("l1 / (a + c)", 6)} AS explained_ratio, {rnd("l1 / (a + c)", 6)} AS cumulative FROM e
UNION ALL SELECT 2, {rnd("1 - l1 / (a + c)", 6)}, 1.0 FROM e""")
def ml_pca_incremental_scree(spark, d):
    return _two_batches(spark, d).scree(spark)


@query("ml_pca_incremental_transform", f"""WITH {_EIGEN},
u AS (SELECT b / sqrt(b * b + (l1 - a) ^ 2) AS x, (l1 - a) / sqrt(b * b + (l1 - a) ^ 2) AS y FROM e),
g AS (SELECT CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS s, x, y FROM u),
m AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice / 1000) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, {rnd("s * ((l_quantity - q) * x + (l_extendedprice / 1000 - p) * y)", 4)} AS pc1 FROM lineitem, g, m""")
def ml_pca_incremental_transform(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("x"))
    return _two_batches(spark, d).transform(li, "x", 1).select("l_orderkey", "l_linenumber", F.round(F.col("pca")[0], 4).alias("pc1"))


@query("ml_linear_svm")
def ml_linear_svm(spark, d):
    dd = docs(spark, d)
    train, test = split_hash(dd, "doc_id", 30)
    model = M.linear_svm(train, DOC_FEATURES, "label")
    return model.transform(test).select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"),
                                        F.round(vector_to_array("rawPrediction")[1], 6).alias("margin"))


def _kernel_machine(spark, d):
    """Machine on the scaled training rows, the scaled test rows, and the balanced weights of the classes."""
    train, test = split_hash(docs(spark, d), "doc_id", 30)
    stats = train.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(DOC_FEATURES)], *[F.stddev(f).alias(f"s{i}") for i, f in enumerate(DOC_FEATURES)]).first()
    x = F.array(*[F.coalesce(F.try_divide(F.col(f).cast("double") - stats[f"m{i}"], F.lit(stats[f"s{i}"])), F.lit(0.0)) for i, f in enumerate(DOC_FEATURES)])
    model = fit_kernel_svm(M.balanced_weights(train, "label").withColumn("x", x), "x", "label", c=1.0, gamma=0.1, m=64, weight="weight", tolerance=0.01)
    return model, test.withColumn("x", x)


@query("ml_rbf_svm_approx")
def ml_rbf_svm_approx(spark, d):
    model, test = _kernel_machine(spark, d)
    return model.margin(test, "x").select("doc_id", "label", (F.col("margin") > 0).cast("int").alias("prediction"), F.round("margin", 4).alias("margin"))


@query("ml_rbf_svm_gap")
def ml_rbf_svm_gap(spark, d):
    """How close the machine is to the optimum of its dual."""
    model, _ = _kernel_machine(spark, d)
    return spark.createDataFrame([(len(model.points), model.rounds, round(model.primal, 4), round(model.dual, 4), round(model.gap, 6))],
                                 "n_landmarks int, rounds int, primal double, dual double, relative_gap double")


@query("ml_grid_search_kernel")
def ml_grid_search_kernel(spark, d):
    train, _ = split_hash(docs(spark, d), "doc_id", 30)
    return M.grid_search_kernel(train, DOC_FEATURES, "label", [0.1, 1.0, 10.0], [0.01, 0.1, 1.0])


@query("ml_grid_search")
def ml_grid_search(spark, d):
    return M.grid_search(docs(spark, d), DOC_FEATURES, "label", [0.0, 0.01, 0.1], [0.0, 0.5], folds=3)


@query("ml_grid_search_models")
def ml_grid_search_models(spark, d):
    return M.grid_search_models(docs(spark, d), DOC_FEATURES, "label", [0.001, 0.01, 0.1], [3, 5], [10, 20])


@query("ml_decision_tree")
def ml_decision_tree(spark, d):
    return M.decision_tree_rules(docs(spark, d), DOC_FEATURES, "label", depth=3)


def _forest(spark, d):
    dd = docs(spark, d)
    train, test = split_hash(dd, "doc_id", 30)
    return M.random_forest(train, DOC_FEATURES, "label", n_trees=40, depth=5, min_leaf=3, weighted=True), test


@query("ml_random_forest")
def ml_random_forest(spark, d):
    model, test = _forest(spark, d)
    out = model.transform(M.assemble(test, DOC_FEATURES))
    return out.select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"),
                      F.round(vector_to_array("probability")[1], 6).alias("p_good"))


@query("ml_feature_importance")
def ml_feature_importance(spark, d):
    model, _ = _forest(spark, d)
    return M.feature_importance(spark, model, DOC_FEATURES)


@query("ml_kmeans")
def ml_kmeans(spark, d):
    e = embeddings(spark, d)
    m = M.kmeans(e, "vec", 10)
    return m.transform(e).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("ml_elbow")
def ml_elbow(spark, d):
    return M.elbow(embeddings(spark, d), "vec", list(range(1, 21)))


@query("ml_silhouette")
def ml_silhouette(spark, d):
    """Euclidean distances, each mean with its bound."""
    return kmeans_silhouette(t(spark, d, "embeddings"), "embedding", list(range(2, 25)))


@query("ml_silhouette_squared")
def ml_silhouette_squared(spark, d):
    """Squared distances, which need no bound."""
    return M.silhouette(embeddings(spark, d), "vec", list(range(2, 25)))


@query("ml_silhouette_by_label", f"""WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND isfinite(list_sum(CAST(embedding AS DOUBLE[])))),
size AS (SELECT label, count(*) AS n FROM p GROUP BY label),
s AS (SELECT x.vec_id, x.label AS own, y.label AS other, sum(list_distance(x.e, y.e)) AS total
      FROM p x JOIN p y ON x.vec_id <> y.vec_id GROUP BY ALL),
ab AS (SELECT vec_id, own, max(CASE WHEN own = other THEN total / (n - 1) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b
       FROM s JOIN size ON size.label = other GROUP BY vec_id, own)
SELECT {rnd("avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0.0))", 6)} AS silhouette, count(*) AS n FROM ab""")
def ml_silhouette_by_label(spark, d):
    """How well the given labels separate the vectors: all pairs, as in the SQL, in blocks of bounded memory."""
    found = euclidean_silhouette(t(spark, d, "embeddings"), "embedding", ["label"], tolerance=1e-7, exact=True)
    return found.select("silhouette", "n")


@query("ml_hopkins")
def ml_hopkins(spark, d):
    return M.hopkins(embeddings(spark, d), "vec")


@query("ml_cluster_profile")
def ml_cluster_profile(spark, d):
    e = embeddings(spark, d)
    clusters = M.kmeans(e, "vec", 5).transform(e).select("vec_id", F.col("prediction").alias("cluster"))
    raw = t(spark, d, "embeddings").select(
        "vec_id", "label", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"),
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))
    prof = raw.join(clusters, "vec_id")          # joined by key, never by position
    return A.mean_all_numeric(prof.drop("vec_id"), ["cluster"], digits=6)


@query("ml_hierarchical_clusters")
def ml_hierarchical_clusters(spark, d):
    found, _heights = cluster(t(spark, d, "embeddings"), "embedding", 8)
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))

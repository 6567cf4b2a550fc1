"""2.16 statistics and evaluation that SQL can check: correlations, splits, simple
regression, regression diagnostics, binary-classifier metrics and curves.

Scores for the classifier metrics are the deterministic stand-in of the fixtures:
``score = round(((doc_id * 37) % 101) / 100, 2)``, label = ``labels.quality``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.functions.binning import flag
from casebook.operators import evaluation as EV
from casebook.operators import stats as ST
from casebook.operators.aggregates import count_by
from casebook.operators.splits import split_stratified, tag_split
from casebook.plans.registry import query
from casebook.plans.sqlfn import cnt_if, rnd
from casebook.plans.tables import t

SCORED_SQL = """scored AS (SELECT doc_id, quality AS label, round(((doc_id * 37) % 101) / 100.0, 2) AS score FROM labels)"""


def scored(spark, d):
    lab = t(spark, d, "labels")
    return lab.select("doc_id", F.col("quality").alias("label"),
                      F.round(((F.col("doc_id") * 37) % 101) / 100.0, 2).alias("score"))


CUTOFFS = [round(0.1 * i, 1) for i in range(10)]
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(cols, table):
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, CAST(1.0 AS DOUBLE) AS corr")
            else:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'corr({a}, {b})', 6)} AS corr FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query("stat_corr_matrix", _pairs_sql(NUM, "lineitem"))
def stat_corr_matrix(spark, d):
    return ST.corr_long(t(spark, d, "lineitem"), NUM)


@query("stat_corr_offdiag_extremes", f"""
WITH m AS ({_pairs_sql(NUM, "lineitem")}), off AS (SELECT * FROM m WHERE a < b)
(SELECT a, b, corr, 'max' AS which FROM off ORDER BY corr DESC, a, b LIMIT 1)
UNION ALL (SELECT a, b, corr, 'min' AS which FROM off ORDER BY corr ASC, a, b LIMIT 1)""")
def stat_corr_offdiag_extremes(spark, d):
    return ST.offdiag_extremes(ST.corr_long(t(spark, d, "lineitem"), NUM))


CAR_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
CARS_SQL = "cars AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"


def cars(spark, d):
    li, p = t(spark, d, "lineitem"), t(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey)


@query("stat_drop_negative_corr", f"""
WITH {CARS_SQL}
{" UNION ALL ".join(f"SELECT '{f}' AS feature, {rnd(f'corr({f}, l_extendedprice)', 6)} AS corr, corr({f}, l_extendedprice) >= 0 AS kept FROM cars" for f in CAR_FEATURES)}""")
def stat_drop_negative_corr(spark, d):
    return ST.target_correlations(cars(spark, d), CAR_FEATURES, "l_extendedprice")


@query("stat_vif", f"""
SELECT * FROM (VALUES ('l_quantity', (SELECT {rnd("1.0 / (1.0 - corr(l_quantity, l_extendedprice) ^ 2)", 6)} FROM lineitem)),
                      ('l_extendedprice', (SELECT {rnd("1.0 / (1.0 - corr(l_quantity, l_extendedprice) ^ 2)", 6)} FROM lineitem)))
v(feature, vif)""")
def stat_vif(spark, d):
    return ST.vif(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], intercept=True)


@query("stat_without_negative_features", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem""")
def stat_without_negative_features(spark, d):
    """The table without the features that fall as the price rises (the sign of both is certain by construction)."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", net.alias("net"), (-net).alias("rebate"))
    return ST.drop_negative_corr(li, ["net", "rebate"], "l_extendedprice")[0]


def _vif_three_sql(form: str, r12: str, r13: str, r23: str) -> str:
    det = "(1 + 2 * p * q * r - p * p - q * q - r * r)"
    rows = ", ".join(f"('{f}', (1 - {c} * {c}) / {det})" for f, c in (("l_quantity", "r"), ("l_extendedprice", "q"), ("l_tax", "p")))
    return f"""SELECT '{form}' AS form, feature, {rnd("vif", 6)} AS vif
FROM (SELECT {r12} AS p, {r13} AS q, {r23} AS r FROM lineitem) s, LATERAL (VALUES {rows}) v(feature, vif)"""


_COS = "sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b}))"
_THREE = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax")]


@query("stat_vif_three_features", f"""{_vif_three_sql("centred", *[f"corr({a}, {b})" for a, b in _THREE])}
UNION ALL {_vif_three_sql("uncentred", *[_COS.format(a=a, b=b) for a, b in _THREE])}""")
def stat_vif_three_features(spark, d):
    """Three features, with an intercept (centred) and without."""
    li, cols = t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]
    form = lambda name, centred: ST.vif(li, cols, intercept=centred).select(F.lit(name).alias("form"), "feature", "vif")
    return form("centred", True).unionByName(form("uncentred", False))


_HASH = "('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT % 100"


@query("ml_split_random", f"""
SELECT {_HASH.format(k='o_orderkey')} < 30 AS is_test, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL""")
def ml_split_random(spark, d):
    o = tag_split(t(spark, d, "orders"), "o_orderkey", 30)
    return count_by(o, "is_test", "o_orderstatus")


@query("ml_split_stratified", f"""
WITH {SCORED_SQL},
h AS (SELECT *, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT AS hk FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hk, doc_id) AS rn,
             floor(count(*) OVER (PARTITION BY label) * 0.3) AS k FROM h)
SELECT doc_id, label, rn <= k AS is_test FROM r""")
def ml_split_stratified(spark, d):
    train, test = split_stratified(scored(spark, d), "doc_id", "label", 0.3)
    return train.select("doc_id", "label", F.lit(False).alias("is_test")) \
                .unionByName(test.select("doc_id", "label", F.lit(True).alias("is_test")))


@query("ml_ols_summary", f"""
SELECT {rnd("regr_slope(l_extendedprice, l_quantity)", 6)} AS slope,
       {rnd("regr_intercept(l_extendedprice, l_quantity)", 6)} AS intercept,
       {rnd("regr_r2(l_extendedprice, l_quantity)", 6)} AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n
FROM lineitem""")
def ml_ols_summary(spark, d):
    return EV.ols_one_feature(t(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount",
          "l_tax", "l_quantity"]


@query("ml_ols_diagnostics", f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0,
                  avg(l_extendedprice) AS ybar FROM lineitem),
e AS (SELECT l_extendedprice - (b0 + b1 * l_quantity) AS e, (b0 + b1 * l_quantity - ybar) AS dev,
             {", ".join(_ORDER)} FROM lineitem, f),
l AS (SELECT e, dev, lag(e) OVER (ORDER BY {", ".join(_ORDER)}) AS pe FROM e),
s AS (SELECT count(*) AS n, sum(e * e) AS sse, sum(dev * dev) AS ssr, sum((e - pe) ^ 2) AS dw_num, avg(e) AS m1,
             avg(e ^ 2) AS r2m, avg(e ^ 3) AS r3m, avg(e ^ 4) AS r4m FROM l),
m AS (SELECT *, r2m - m1 ^ 2 AS m2, r3m - 3 * m1 * r2m + 2 * m1 ^ 3 AS m3,
             r4m - 4 * m1 * r3m + 6 * m1 ^ 2 * r2m - 3 * m1 ^ 4 AS m4,
             -n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1) AS ll FROM s)
SELECT n, {rnd("(ssr / 1) / (sse / (n - 2))", 6)} AS f_stat, {rnd("ll", 6)} AS log_likelihood,
       {rnd("-2 * ll + 2 * 2", 6)} AS aic, {rnd("-2 * ll + 2 * ln(n)", 6)} AS bic, {rnd("dw_num / sse", 6)} AS durbin_watson,
       {rnd("n / 6.0 * ((m3 / m2 ^ 1.5) ^ 2 + ((m4 / m2 ^ 2) - 3) ^ 2 / 4.0)", 6)} AS jarque_bera,
       {rnd("m3 / m2 ^ 1.5", 6)} AS skew, {rnd("m4 / m2 ^ 2", 6)} AS kurtosis FROM m""")
def ml_ols_diagnostics(spark, d):
    li = t(spark, d, "lineitem")
    fit = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b1"),
                 F.regr_intercept("l_extendedprice", "l_quantity").alias("b0"))
    b0, b1 = fit.select("b0").scalar(), fit.select("b1").scalar()
    pred = li.select(*_ORDER, (b0 + b1 * F.col("l_quantity")).alias("yhat"))
    return EV.residual_diagnostics(pred, "l_extendedprice", "yhat", _ORDER, n_params=2)


@query("ml_r2_score", f"""
WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS yhat FROM lineitem)
SELECT {rnd("1.0 - sum((y - yhat) ^ 2) / sum((y - (SELECT avg(y) FROM p)) ^ 2)", 6)} AS r2 FROM p""")
def ml_r2_score(spark, d):
    p = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("yhat"))
    return EV.r2_score(p, "y", "yhat")


@query("ml_threshold_label", f"""
WITH {SCORED_SQL} SELECT doc_id, score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS predicted FROM scored""")
def ml_threshold_label(spark, d):
    s = scored(spark, d)
    return s.select("doc_id", "score", EV.predict_label("score", 0.5).alias("predicted"))


_CELLS = ", ".join([f"{cnt_if('label = 0 AND pred = 0')} AS tn", f"{cnt_if('label = 0 AND pred = 1')} AS fp",
                    f"{cnt_if('label = 1 AND pred = 0')} AS fn", f"{cnt_if('label = 1 AND pred = 1')} AS tp"])
_PRED_SQL = f"{SCORED_SQL}, pr AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM scored)"


def _pred(spark, d):
    return scored(spark, d).withColumn("pred", EV.predict_label("score", 0.5))


@query("ml_confusion_matrix", f"WITH {_PRED_SQL} SELECT {_CELLS} FROM pr")
def ml_confusion_matrix(spark, d):
    return EV.confusion(_pred(spark, d), "label", "pred")


def _rate(a, b):
    return rnd(f"CAST({a} AS DOUBLE) / nullif({b}, 0)", 4)


_RATES = ", ".join([f"{_rate('tp + tn', 'tp + tn + fp + fn')} AS accuracy", f"{_rate('tp', 'tp + fn')} AS sensitivity",
                    f"{_rate('tn', 'tn + fp')} AS specificity", f"{_rate('fp', 'fp + tn')} AS fpr",
                    f"{_rate('tp', 'tp + fp')} AS ppv", f"{_rate('tn', 'tn + fn')} AS npv"])


@query("ml_binary_rates", f"WITH {_PRED_SQL}, c AS (SELECT {_CELLS} FROM pr) SELECT *, {_RATES} FROM c")
def ml_binary_rates(spark, d):
    return EV.binary_rates(_pred(spark, d), "label", "pred")


@query("ml_precision_recall", f"""
WITH {_PRED_SQL}, c AS (SELECT {_CELLS} FROM pr)
SELECT {_rate('tp', 'tp + fp')} AS precision, {_rate('tp', 'tp + fn')} AS recall FROM c""")
def ml_precision_recall(spark, d):
    return EV.binary_rates(_pred(spark, d), "label", "pred").select(F.col("ppv").alias("precision"),
                                                                     F.col("sensitivity").alias("recall"))


@query("ml_classification_report", f"""
WITH {_PRED_SQL}, classes AS (SELECT label AS cls FROM pr UNION SELECT pred FROM pr),
s AS (SELECT cls, (SELECT count(*) FROM pr WHERE label = cls AND pred = cls) AS tp,
             (SELECT count(*) FROM pr WHERE label = cls) AS support, (SELECT count(*) FROM pr WHERE pred = cls) AS n_pred
      FROM classes),
m AS (SELECT cls, support, CAST(tp AS DOUBLE) / nullif(n_pred, 0) AS p, CAST(tp AS DOUBLE) / nullif(support, 0) AS r FROM s)
SELECT cls, {rnd("p", 4)} AS precision, {rnd("r", 4)} AS recall, {rnd("2 * p * r / nullif(p + r, 0)", 4)} AS f1,
       CAST(support AS BIGINT) AS support FROM m""")
def ml_classification_report(spark, d):
    return EV.classification_report(_pred(spark, d), "label", "pred")


_CUT_SQL = f"""{SCORED_SQL}, cuts AS (SELECT CAST(range AS DOUBLE) / 10.0 AS cutoff FROM range(0, 10)),
cells AS (SELECT cutoff, {cnt_if('label = 0 AND NOT score > cutoff')} AS tn, {cnt_if('label = 0 AND score > cutoff')} AS fp,
                 {cnt_if('label = 1 AND NOT score > cutoff')} AS fn, {cnt_if('label = 1 AND score > cutoff')} AS tp
          FROM cuts, scored GROUP BY cutoff),
tab AS (SELECT cutoff, tn, fp, fn, tp, {_rate('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
               {_rate('tp', 'tp + fn')} AS sensitivity, {_rate('tn', 'tn + fp')} AS specificity FROM cells)"""


@query("ml_cutoff_table", f"WITH {_CUT_SQL} SELECT * FROM tab")
def ml_cutoff_table(spark, d):
    return EV.cutoff_table(scored(spark, d), "label", "score", CUTOFFS)


@query("ml_best_cutoff", f"""
WITH {_CUT_SQL}
SELECT *, {rnd("greatest(accuracy, sensitivity, specificity) - least(accuracy, sensitivity, specificity)", 6)} AS spread
FROM tab ORDER BY spread, cutoff LIMIT 1""")
def ml_best_cutoff(spark, d):
    return EV.best_cutoff(EV.cutoff_table(scored(spark, d), "label", "score", CUTOFFS))


_CUM_SQL = f"""{SCORED_SQL}, g AS (SELECT score AS threshold, {cnt_if('label = 1')} AS pos, {cnt_if('label = 0')} AS neg
                         FROM scored GROUP BY score),
c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS pos_cum, sum(neg) OVER (ORDER BY threshold DESC) AS neg_cum,
             (SELECT {cnt_if('label = 1')} FROM scored) AS P, (SELECT {cnt_if('label = 0')} FROM scored) AS N FROM g)"""


@query("ml_roc_curve", f"""
WITH {_CUM_SQL} SELECT threshold, {rnd("neg_cum / N", 6)} AS fpr, {rnd("pos_cum / P", 6)} AS tpr FROM c""")
def ml_roc_curve(spark, d):
    return EV.roc_curve(scored(spark, d), "label", "score")


@query("ml_pr_curve", f"""
WITH {_CUM_SQL} SELECT threshold, {rnd("pos_cum / (pos_cum + neg_cum)", 6)} AS precision, {rnd("pos_cum / P", 6)} AS recall FROM c""")
def ml_pr_curve(spark, d):
    return EV.pr_curve(scored(spark, d), "label", "score")


@query("ml_auc", f"""
WITH {SCORED_SQL}, r AS (SELECT label, rank() OVER (ORDER BY score) AS lo,
                               count(*) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM scored),
s AS (SELECT sum((lo + hi) / 2.0) FILTER (WHERE label = 1) AS rs, {cnt_if('label = 1')} AS P, {cnt_if('label = 0')} AS N FROM r)
SELECT {rnd("(rs - P * (P + 1) / 2.0) / (P * N)", 6)} AS auc, P AS n_pos, N AS n_neg FROM s""")
def ml_auc(spark, d):
    return EV.auc(scored(spark, d), "label", "score")


@query("ml_model_agreement", """
WITH p AS (SELECT doc_id, quality AS actual, CASE WHEN ((doc_id * 37) % 101) > 50 THEN 1 ELSE 0 END AS pred_a,
                  CASE WHEN ((doc_id * 53) % 97) > 40 THEN 1 ELSE 0 END AS pred_b,
                  CASE WHEN ((doc_id * 29) % 89) > 60 THEN 1 ELSE 0 END AS pred_c FROM labels),
long AS (SELECT 'a' AS model, CASE WHEN pred_a = actual THEN 1 ELSE 0 END AS hit FROM p
         UNION ALL SELECT 'b', CASE WHEN pred_b = actual THEN 1 ELSE 0 END FROM p
         UNION ALL SELECT 'c', CASE WHEN pred_c = actual THEN 1 ELSE 0 END FROM p)
SELECT model, CAST(sum(hit) AS BIGINT) AS hits, CAST(round(CAST(avg(hit) AS DECIMAL(38,12)), 4) AS DOUBLE) AS hit_share
FROM long GROUP BY model""")
def ml_model_agreement(spark, d):
    from casebook.plans.joins_q import join_model_outputs
    p = join_model_outputs(spark, d)
    long = p.unpivot(["doc_id", "actual"], ["pred_a", "pred_b", "pred_c"], "model", "pred")
    long = long.select(F.substring("model", 6, 1).alias("model"), flag(F.col("pred") == F.col("actual")).alias("hit"))
    return long.groupBy("model").agg(F.sum("hit").alias("hits"), F.round(F.avg("hit"), 4).alias("hit_share"))

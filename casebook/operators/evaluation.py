"""Model evaluation as plain aggregates: confusion matrix, rates, cutoff table,
ROC / PR curves, AUC and regression diagnostics.

Curves are computed on the per-distinct-score table (one row per score value,
ties share a point) and the running sums over the score order are prefix scans
(:mod:`casebook.operators.prefix`), so no step windows raw rows.
Zero denominators give NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.compat import col_
from casebook.operators.prefix import scan


def predict_label(score, cutoff: float) -> Column:
    """Probability → class with the strict rule ``score > cutoff``."""
    return (col_(score) > F.lit(cutoff)).cast("int")


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    yy, pp = F.col(y), F.col(p)
    return df.agg(F.count_if((yy == 0) & (pp == 0)).alias("tn"), F.count_if((yy == 0) & (pp == 1)).alias("fp"),
                  F.count_if((yy == 1) & (pp == 0)).alias("fn"), F.count_if((yy == 1) & (pp == 1)).alias("tp"))


def rates_from_cells(tn, fp, fn, tp, digits: int = 4) -> list[Column]:
    tn, fp, fn, tp = (col_(x) for x in (tn, fp, fn, tp))
    r = lambda a, b: F.round(F.try_divide(a.cast("double"), b), digits)
    return [r(tp + tn, tp + tn + fp + fn).alias("accuracy"), r(tp, tp + fn).alias("sensitivity"),
            r(tn, tn + fp).alias("specificity"), r(fp, fp + tn).alias("fpr"),
            r(tp, tp + fp).alias("ppv"), r(tn, tn + fn).alias("npv")]


def binary_rates(df: DataFrame, y: str, p: str, digits: int = 4) -> DataFrame:
    c = confusion(df, y, p)
    return c.select("*", *rates_from_cells("tn", "fp", "fn", "tp", digits))


def classification_report(df: DataFrame, y: str, p: str, digits: int = 4) -> DataFrame:
    """Per class: precision, recall, f1, support (grouped counts, no pivot)."""
    yy, pp = F.col(y), F.col(p)
    classes = df.select(yy.alias("cls")).union(df.select(pp.alias("cls"))).distinct()
    # counts per (actual, predicted) — a handful of rows
    cells = df.groupBy(yy.alias("a"), pp.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    tp = cells.where(F.col("a") == F.col("b")).select(F.col("a").alias("cls"), F.col("n").alias("tp"))
    sup = cells.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("support"))
    pred = cells.groupBy(F.col("b").alias("cls")).agg(F.sum("n").alias("n_pred"))
    j = classes.join(tp, "cls", "left").join(sup, "cls", "left").join(pred, "cls", "left").na.fill(0)
    prec = F.try_divide(F.col("tp").cast("double"), F.col("n_pred"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("support"))
    f1 = F.try_divide(2 * prec * rec, prec + rec)
    return j.select("cls", F.round(prec, digits).alias("precision"), F.round(rec, digits).alias("recall"),
                    F.round(f1, digits).alias("f1"), F.col("support").cast("long").alias("support"))


def cutoff_table(df: DataFrame, y: str, score: str, cutoffs: Sequence[float], digits: int = 4) -> DataFrame:
    """accuracy / sensitivity / specificity at each cutoff (strict ``score > c``).

    One aggregate with four counts per cutoff (the cutoff list is a parameter),
    then unpivoted: no join of the data with the cutoff list.
    """
    yy, s = F.col(y), F.col(score)
    aggs = []
    for i, c in enumerate(cutoffs):
        pred = s > F.lit(c)
        aggs += [F.count_if((yy == 0) & ~pred).alias(f"tn{i}"), F.count_if((yy == 0) & pred).alias(f"fp{i}"),
                 F.count_if((yy == 1) & ~pred).alias(f"fn{i}"), F.count_if((yy == 1) & pred).alias(f"tp{i}")]
    one = df.agg(*aggs)
    stack = ", ".join(f"CAST({float(c)} AS DOUBLE), tn{i}, fp{i}, fn{i}, tp{i}" for i, c in enumerate(cutoffs))
    long = one.selectExpr(f"stack({len(cutoffs)}, {stack}) as (cutoff, tn, fp, fn, tp)")
    rates = rates_from_cells("tn", "fp", "fn", "tp", digits)
    return long.select("cutoff", "tn", "fp", "fn", "tp", rates[0], rates[1], rates[2])


def best_cutoff(table: DataFrame) -> DataFrame:
    """Cutoff where accuracy, sensitivity and specificity are closest
    (smallest max − min; ties → lower cutoff)."""
    spread = F.greatest("accuracy", "sensitivity", "specificity") - F.least("accuracy", "sensitivity", "specificity")
    return table.withColumn("spread", F.round(spread, 6)).orderBy("spread", "cutoff").limit(1)


def _score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def _cumulative_desc(df: DataFrame, y: str, score: str, parts: int | None) -> DataFrame:
    """Per distinct score: counts at scores >= threshold (descending order)."""
    return scan(_score_counts(df, y, score), [F.col("threshold").desc()], {"pos": "pos_cum", "neg": "neg_cum"}, parts=parts)


def roc_curve(df: DataFrame, y: str, score: str, parts: int | None = None, digits: int = 6) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first."""
    c = _cumulative_desc(df, y, score, parts)
    P = df.select(F.count_if(F.col(y) == 1)).scalar()
    N = df.select(F.count_if(F.col(y) == 0)).scalar()
    return c.select("threshold", F.round(F.try_divide(F.col("neg_cum").cast("double"), N), digits).alias("fpr"),
                    F.round(F.try_divide(F.col("pos_cum").cast("double"), P), digits).alias("tpr"))


def pr_curve(df: DataFrame, y: str, score: str, parts: int | None = None, digits: int = 6) -> DataFrame:
    """(threshold, precision, recall) for every distinct score."""
    c = _cumulative_desc(df, y, score, parts)
    P = df.select(F.count_if(F.col(y) == 1)).scalar()
    return c.select("threshold",
                    F.round(F.try_divide(F.col("pos_cum").cast("double"), F.col("pos_cum") + F.col("neg_cum")), digits)
                    .alias("precision"),
                    F.round(F.try_divide(F.col("pos_cum").cast("double"), P), digits).alias("recall"))


def auc(df: DataFrame, y: str, score: str, parts: int | None = None, digits: int = 6) -> DataFrame:
    """Area under ROC by the rank-sum (Mann-Whitney) form with average ranks for ties."""
    sc = _score_counts(df, y, score).withColumn("n", F.col("pos") + F.col("neg"))
    cum = scan(sc, [F.col("threshold")], {"n": "n_cum"}, parts=parts)          # rows with score <= s
    avg_rank = (F.col("n_cum") - F.col("n") + 1 + F.col("n_cum")) / 2.0
    one = cum.agg(F.sum(F.col("pos") * avg_rank).alias("r"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    u = F.col("r") - F.col("P") * (F.col("P") + 1) / 2.0
    return one.select(F.round(F.try_divide(u, F.col("P") * F.col("N")), digits).alias("auc"),
                      F.col("P").alias("n_pos"), F.col("N").alias("n_neg"))


def r2_score(df: DataFrame, y: str, yhat: str, digits: int = 6) -> DataFrame:
    """1 − Σ(y−ŷ)² / Σ(y−ȳ)² (ȳ from a scalar subquery); NULL for a constant y."""
    ybar = df.select(F.avg(y)).scalar()
    return df.agg(F.round(F.lit(1.0) - F.try_divide(F.sum((F.col(y) - F.col(yhat)) ** 2), F.sum((F.col(y) - ybar) ** 2)), digits)
                  .alias("r2"))


def ols_one_feature(df: DataFrame, y: str, x: str, digits: int = 6) -> DataFrame:
    """Closed-form simple regression: slope, intercept, R², n (SQL ``regr_*``)."""
    return df.agg(F.round(F.regr_slope(y, x), digits).alias("slope"),
                  F.round(F.regr_intercept(y, x), digits).alias("intercept"),
                  F.round(F.regr_r2(y, x), digits).alias("r2"), F.regr_count(y, x).alias("n"))


def residual_diagnostics(df: DataFrame, y: str, yhat: str, order: Sequence[str], n_params: int,
                         parts: int | None = None, digits: int = 6) -> DataFrame:
    """F statistic, log-likelihood, AIC, BIC, Durbin-Watson, Jarque-Bera, residual skew
    and kurtosis from (y, ŷ) pairs.

    ``n_params`` counts the fitted coefficients including the intercept. Skew and
    kurtosis are the population (biased) moments, as in the OLS summary tables.
    Durbin-Watson needs the previous residual in ``order``, which a prefix scan carries.
    """
    e = df.select(*dict.fromkeys([*order, y, yhat]), (F.col(y) - F.col(yhat)).alias("_e"))
    lagged = scan(e, order, previous={"_e": "_pe"}, parts=parts, keep=[yhat, "_e"])
    ybar = df.select(F.avg(y)).scalar()
    one = lagged.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_e") ** 2).alias("sse"),
                     F.sum((F.col(yhat) - ybar) ** 2).alias("ssr"),
                     F.sum((F.col("_e") - F.col("_pe")) ** 2).alias("dw_num"),
                     F.avg("_e").alias("m1"), F.avg(F.col("_e") ** 2).alias("r2m"),
                     F.avg(F.col("_e") ** 3).alias("r3m"), F.avg(F.col("_e") ** 4).alias("r4m"))
    k = n_params - 1
    n, sse = F.col("n"), F.col("sse")
    m2 = F.col("r2m") - F.col("m1") ** 2
    m3 = F.col("r3m") - 3 * F.col("m1") * F.col("r2m") + 2 * F.col("m1") ** 3
    m4 = F.col("r4m") - 4 * F.col("m1") * F.col("r3m") + 6 * F.col("m1") ** 2 * F.col("r2m") - 3 * F.col("m1") ** 4
    skew = F.try_divide(m3, F.pow(m2, 1.5))
    kurt = F.try_divide(m4, m2 ** 2)
    ll = -n / 2.0 * (F.lit(math.log(2 * math.pi)) + F.log(sse / n) + 1)
    rd = lambda c: F.round(c, digits)
    return one.select(
        n.alias("n"), rd(F.try_divide(F.col("ssr") / k, F.try_divide(sse, n - k - 1))).alias("f_stat"), rd(ll).alias("log_likelihood"),
        rd(-2 * ll + 2 * n_params).alias("aic"), rd(-2 * ll + n_params * F.log(n)).alias("bic"),
        rd(F.try_divide(F.col("dw_num"), sse)).alias("durbin_watson"),
        rd(n / 6.0 * (skew ** 2 + (kurt - 3) ** 2 / 4.0)).alias("jarque_bera"),
        rd(skew).alias("skew"), rd(kurt).alias("kurtosis"))

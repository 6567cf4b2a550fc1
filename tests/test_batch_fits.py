"""Grid searches and the kernel machine against single fits and a brute-force dual."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from casebook.operators import grids as G
from casebook.operators import kernel as K
from casebook.operators import models as M

NAMES = ["a", "b", "c", "one"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.2]
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=240) > 0.8).astype(int)
    return spark.createDataFrame([(*map(float, r), 2.0, int(v)) for r, v in zip(x, y)], [*NAMES, "y"]).repartition(4)


def test_grid_rows_equal_single_fits(spark, rows):
    grid = [G.Setting("logistic", reg=r, elastic=e) for r in (0.0, 0.02, 0.2) for e in (0.0, 0.5)]
    batch = G.Batch(rows, NAMES, "y", grid, folds=3).fit()
    assert batch.passes < 25
    auc = batch.auc()
    data = VectorAssembler(inputCols=NAMES, outputCol="features").transform(batch.rows.select("y", "fold", *[F.col("x")[i].alias(n) for i, n in enumerate(NAMES)]))
    data = data.cache()
    for s, v in ((s, v) for s, v in enumerate(grid) if s in (0, 2, 3, 5)):
        scores = []
        for f in range(3):
            one = LogisticRegression(labelCol="y", regParam=v.reg, elasticNetParam=v.elastic, maxIter=300, tol=1e-10).fit(data.where(f"fold != {f}"))
            w = batch.w[s, f]
            raw = np.where(np.isfinite(batch.std[f]), w[:-1] / batch.std[f], 0.0)
            assert raw == pytest.approx(one.coefficients.toArray(), abs=2e-4)
            assert w[-1] - raw @ batch.mean[f] == pytest.approx(one.intercept, abs=2e-4)
            scores.append(BinaryClassificationEvaluator(labelCol="y").evaluate(one.transform(data.where(f"fold = {f}"))))
        assert auc[s] == pytest.approx(np.mean(scores), abs=1e-3)
    few = G.Batch(rows, NAMES, "y", grid[2:3], folds=3).fit()
    assert few.w[0, 1] == pytest.approx(batch.w[2, 1], abs=1e-6) and batch.passes <= few.passes + 15
    table = M.grid_search(rows, NAMES, "y", [0.0, 0.02], [0.0, 0.5], folds=3).collect()
    assert len(table) == 4 and sum(r["best"] for r in table) == 1


def test_kernel_grid_finds_a_ring(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = ((x ** 2).sum(axis=1) < 1.2).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], ["a", "b", "y"])
    got = {(r["c"], r["gamma"]): r["mean_auc"] for r in M.grid_search_kernel(df, ["a", "b"], "y", [1.0, 10.0], [0.0001, 0.5], m=40).collect()}
    assert len(got) == 4 and got[10.0, 0.5] > 0.97 > got[1.0, 0.0001] + 0.1


def _dual(kernel, y, c):
    """Coordinate ascent on the whole dual of the kernel with a constant 1 added, to high precision."""
    q = (kernel + 1) * np.outer(y, y)
    alpha = np.zeros(len(y))
    for _ in range(4000):
        for i in range(len(y)):
            alpha[i] = min(max(alpha[i] + (1 - q[i] @ alpha) / q[i, i], 0), c)
    return alpha, alpha.sum() - alpha @ q @ alpha / 2


@pytest.mark.parametrize("block_rows, tolerance", [(1000, 2e-3), (12, 2e-2)])
def test_kernel_machine_equals_the_dual(spark, block_rows, tolerance):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    y = np.where((x ** 2).sum(axis=1) + 0.5 * rng.normal(size=40) < 1.5, 1, -1)
    df = spark.createDataFrame([(i, [float(a) for a in r], int(v > 0)) for i, (r, v) in enumerate(zip(x, y))] + [(99, None, 1)], "id int, v array<double>, y int").repartition(2)
    alpha, best = _dual(K.rbf(x, x, 0.7), y, 1.5)
    model = K.fit_kernel_svm(df, "v", "y", c=1.5, gamma=0.7, m=100, tolerance=tolerance, max_rounds=40, block_rows=block_rows)
    assert len(model.points) == 40 and model.gap <= tolerance
    # the model's objectives are the dual's divided by c: the gap holds the true optimum
    assert model.dual - 1e-9 <= best / 1.5 <= model.primal + 1e-9
    want = (K.rbf(x, x, 0.7) + 1) @ (alpha * y)
    got = {r["id"]: r["margin"] for r in model.margin(df.where("v IS NOT NULL"), "v").collect()}
    assert all(np.sign(got[i]) == np.sign(want[i]) for i in range(40) if abs(want[i]) > 0.3)
    assert max(abs(got[i] - want[i]) for i in range(40)) < 0.4
    with pytest.raises(ValueError, match="no rows"):
        K.fit_kernel_svm(df.where("id < 0"), "v", "y")

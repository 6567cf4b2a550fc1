"""Least squares and feature elimination by the sweep operator on one cross-product matrix.

One aggregate over the data gives the centred cross products of all features and the target. Sweeping a feature into
the matrix adds it to the regression, sweeping it out again takes it away: after each step the matrix holds the
coefficients, the inverse cross products (hence standard errors and variance inflation factors) and the residual sum of
squares of the current model. Rounds of an elimination cost k^2 on the driver and no pass over the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + (b * math.log1p(-x) if x < 1 else -math.inf)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of I_x(a, b)."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


class CrossProducts:
    """``n``, the means and the centred cross products of ``features`` and ``label``, over rows without a NULL or NaN."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str) -> None:
        self.features = list(features)
        names = [*self.features, label]
        cols = [F.col(c).cast("double") for c in names]
        whole = F.lit(True)
        for c in cols:
            whole = whole & c.isNotNull() & ~F.isnan(c)
        rows = df.where(whole)
        one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                       *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]).first()
        self.n, k = one["n"], len(cols)
        self.means = np.array([np.nan if one[f"m{i}"] is None else one[f"m{i}"] for i in range(k)])
        self.matrix = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                self.matrix[i, j] = self.matrix[j, i] = (one[f"c{i}_{j}"] or 0.0) * self.n
        self.diagonal = np.diag(self.matrix).copy()


class Sweep:
    """The regression of the target on the features swept in so far."""

    def __init__(self, products: CrossProducts, tolerance: float = 1e-10) -> None:
        self.of, self.tolerance = products, tolerance
        self.m = products.matrix.copy()
        self.inside: list[int] = []

    def toggle(self, i: int) -> bool:
        """Sweep a feature in, or out if it is in. A feature that the others explain, or a constant one, stays out."""
        out = i in self.inside
        pivot = self.m[i, i]
        if not out and pivot <= self.tolerance * max(self.of.diagonal[i], 0.0):
            return False
        row, column = self.m[i].copy(), self.m[:, i].copy()
        self.m -= np.outer(column, row) / pivot
        sign = -1.0 if out else 1.0
        self.m[i], self.m[:, i] = sign * row / pivot, sign * column / pivot
        self.m[i, i] = -1.0 / pivot
        (self.inside.remove if out else self.inside.append)(i)
        return True

    def add_all(self, which: Sequence[int]) -> list[int]:
        """Sweep features in, by the largest share left unexplained; returns those that stay out."""
        left = list(which)
        while left:
            share = [self.m[i, i] / self.of.diagonal[i] if self.of.diagonal[i] > 0 else 0.0 for i in left]
            best = left[int(np.argmax(share))]
            if not self.toggle(best):
                return left
            left.remove(best)
        return left

    def table(self) -> list[tuple[str, float, float, float, float]]:
        """(term, coefficient, standard error, t, p) of every feature that is in, and of the intercept."""
        p, n, rest = self.of, self.of.n, n_left(self)
        sse = max(self.m[-1, -1], 0.0)
        variance = sse / rest if rest > 0 else math.nan
        idx = sorted(self.inside)
        beta = self.m[idx, -1]
        inverse = -self.m[np.ix_(idx, idx)]
        means = p.means[idx]
        rows = [(p.features[i], b, math.sqrt(max(variance * inverse[k, k], 0.0))) for k, (i, b) in enumerate(zip(idx, beta, strict=True))]
        rows.append(("const", p.means[-1] - float(beta @ means), math.sqrt(max(variance * (1 / n + means @ inverse @ means), 0.0)) if n else math.nan))
        ratio = lambda b, s: b / s if s > 0 else math.copysign(math.inf, b) if b else math.nan
        return [(f, float(b), s, float(ratio(b, s)), t_two_sided(float(ratio(b, s)), rest)) for f, b, s in rows]

    def r2(self) -> float | None:
        total = self.of.diagonal[-1]
        return 1 - max(self.m[-1, -1], 0.0) / total if total > 0 else None

    def vif(self, i: int) -> float:
        return float(-self.m[i, i] * self.of.diagonal[i])


def n_left(s: Sweep) -> int:
    """Degrees of freedom of the residuals."""
    return s.of.n - len(s.inside) - 1


def eliminate(products: CrossProducts, p_max: float, vif_max: float, max_rounds: int | None = None):
    """Rounds (round, dropped, reason, value, left) of a backward elimination: the largest variance inflation factor
    above ``vif_max`` goes first (infinite for a feature that the others explain, none for a constant one), then the
    largest p-value above ``p_max``. Ties go to the feature named first."""
    sweep, out, left, rnd = Sweep(products), [], list(range(len(products.features))), 0
    sweep.add_all(left)
    while len(left) > 1 and (max_rounds is None or rnd < max_rounds):
        rnd += 1
        shut = [i for i in left if i not in sweep.inside]
        flat = [i for i in shut if products.diagonal[i] <= 0]
        if flat:
            worst, value, reason = flat[0], None, "vif"
        elif shut:
            tied = [i for i in left if i in shut or sweep.vif(i) * sweep.tolerance > 1 or _explained(sweep, i, shut)]
            worst, value, reason = tied[0], math.inf, "vif"
        else:
            worst = max(left, key=lambda i: (sweep.vif(i), -left.index(i)))
            value, reason = sweep.vif(worst), "vif"
            if value <= vif_max:
                p = {f: v for f, _, _, _, v in sweep.table()}
                worst = max(left, key=lambda i: (p[products.features[i]] if not math.isnan(p[products.features[i]]) else math.inf, -left.index(i)))
                value, reason = p[products.features[worst]], "p_value"
                if value <= p_max:
                    break
        left.remove(worst)
        if worst in sweep.inside:
            sweep.toggle(worst)
        sweep.add_all([i for i in left if i not in sweep.inside])
        out.append((rnd, products.features[worst], reason, None if value is None or math.isnan(value) else round(value, 6), len(left)))
    return [*out, (rnd + 1 if not out or out[-1][0] == rnd else rnd, None, "final", None, len(left))]


def _explained(s: Sweep, i: int, shut: Sequence[int]) -> bool:
    """Whether a feature that is out depends on feature ``i`` (then ``i`` is explained by the others as well)."""
    return any(abs(s.m[i, j]) * math.sqrt(s.of.diagonal[i]) > 1e-6 * math.sqrt(s.of.diagonal[j]) for j in shut if s.of.diagonal[j] > 0)

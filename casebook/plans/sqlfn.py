"""SQL-text helpers for the oracle queries.

Spark's ``round`` on a DOUBLE rounds the shortest decimal form of the value
half-up; DuckDB's multiplies by 10^n first, so exact ties (0.07125 → 0.0713 in
Spark, 0.0712 in DuckDB) can differ. Rounding through a DECIMAL cast reproduces
Spark's rule exactly, so every oracle rounds with these helpers.
"""


def rnd(expr: str, n: int) -> str:
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,12)), {n}) AS DOUBLE)"


def rnd_even(expr: str, n: int) -> str:
    return f"CAST(round_even(CAST(({expr}) AS DECIMAL(38,12)), {n}) AS DOUBLE)"


def cnt_if(pred: str) -> str:
    """count of rows where ``pred`` is TRUE, as BIGINT (DuckDB's count_if is HUGEINT)."""
    return f"count(*) FILTER (WHERE {pred})"

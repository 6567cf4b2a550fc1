"""Registered queries against their DuckDB oracle on the smallest tables (sf0.001),
plus the driver contract: entry(), queries() and oracle_sql() agree."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from casebook.plans import registry
from tests.conftest import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 9)
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_contract_keys():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 200


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and "n_faulty" in df.columns


@pytest.mark.parametrize("qid", sorted(q for q in ORACLES if q in registry.ORACLES))
def test_query_matches_oracle(spark, con, qid):
    sdf = QUERIES[qid](spark, SF_SMALL)
    st = sdf.toArrow()
    dt = con.sql(ORACLES[qid]).to_arrow_table()
    assert sorted(st.column_names) == sorted(dt.column_names)
    cols = sorted(st.column_names)
    s, d = st.to_pydict(), dt.to_pydict()
    rs = Counter(tuple(_norm(s[c][i]) for c in cols) for i in range(st.num_rows))
    rd = Counter(tuple(_norm(d[c][i]) for c in cols) for i in range(dt.num_rows))
    assert rs == rd

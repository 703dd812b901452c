"""Every registered query that has SQL gives the SQL's rows."""

import duckdb
import numpy as np
import pytest

from codelode import catalog_queries as Q

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "~"
    if isinstance(v, (float, np.floating)):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_rows(spark, sql, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    r = sql.sql(Q.ORACLES[name])
    at = [r.columns.index(c) for c in columns]
    assert sorted(r.columns) == columns
    assert sorted(tuple(plain(x[c]) for c in columns) for x in df.collect()) == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())

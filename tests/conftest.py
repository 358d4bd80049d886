import os

import pytest

from corvidex.session import session

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = session(f"local[{os.environ.get('TEST_CPUS', '4')}]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    """DuckDB with the smallest tables as views, and a function that reads one in Spark."""
    duckdb = pytest.importorskip("duckdb")
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for name in os.listdir(path):
        db.execute(f"create view {name.split('.')[0]} as select * from '{path}/{name}'")
    return db, path


@pytest.fixture(scope="session")
def same(spark, tables):
    """Compare a query with its SQL: equal bags of rows, floats to 6 decimals."""
    from collections import Counter

    db, path = tables

    def norm(v):
        return f"{v + 0.0:.6f}" if isinstance(v, float) else repr(v)

    def check(query, sql):
        df = query(spark, path)
        columns = sorted(df.columns)
        cursor = db.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = Counter(tuple(norm(r[i]) for i in at) for r in cursor.fetchall())
        got = Counter(tuple(norm(v) for v in r) for r in df.select(*columns).collect())
        assert got == want

    return check

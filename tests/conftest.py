import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestow.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL, columns by name and rows in any order."""

    def plain(v):
        return None if v is None or v != v else v.item() if hasattr(v, "item") else v

    def check(df, sql):
        found = duck.execute(sql)
        names, rows = [d[0] for d in found.description], found.fetchall()
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        mine = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
        theirs = sorted(str([plain(r[names.index(c)]) for c in order]) for r in rows)
        assert mine == theirs

    return check

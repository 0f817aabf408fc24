import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rankspark.session import local_session

    session = local_session("local[4]", 4, "4g")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("the test tables are not here")
    return SMALL


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def same_as_oracle(spark, folder, query, sql):
    """Compare a query with its SQL on DuckDB, columns by name, rows in any order."""
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in os.listdir(folder):
        connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == expected

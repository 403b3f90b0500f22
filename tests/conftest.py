import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import local_session

    session = local_session(4, "tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(small):
        name = f.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{small}/{f}'")
    return con

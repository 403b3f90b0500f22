"""Every query of the core against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

CORE = {n: (q, m.SQL.get(n)) for m in entry._modules() if ".llm." not in m.__name__ for n, q in m.QUERIES.items()}


def canonical(df: pd.DataFrame) -> list[tuple]:
    def show(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(name, spark, small, duck):
    build, statement = CORE[name]
    got = build(spark, small).toPandas()
    if statement is None:
        assert len(got.columns) > 0
        return
    want = duck.execute(statement).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_novelty_of_records_that_differ_elsewhere(spark, small, tmp_path):
    """A record that comes again with another polarity, time of extraction or spelling of its asset is one record."""
    name, con = "M1_M2_novelty", duckdb.connect()
    con.execute("set timezone = 'UTC'")
    again = "replace (0.125 as polarity, extracted_at + interval 1 hour as extracted_at, ' $' || lower(asset) as asset)"
    con.execute(f"create table event_records as select * from '{small}/event_records.parquet' union all select * {again} from '{small}/event_records.parquet' where record_id % 3 = 0")
    con.execute(f"create table raw_news as select * from '{small}/raw_news.parquet'")
    for t in ("event_records", "raw_news"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    build, statement = CORE[name]
    assert canonical(build(spark, str(tmp_path)).toPandas()) == canonical(con.execute(statement).df())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_all_statements_have_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_text_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "tidewell"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "tidewell.llm" not in f.read_text() and "from tidewell import llm" not in f.read_text()

"""Every query with SQL gives what DuckDB gives for it on the small tables; every other one gives rows."""

from pathlib import Path

import duckdb
import pytest

from cadenza.plans import motion_queries, run_queries, selection_queries, table_queries

SF = Path("/root/testdata/sf0.001")
QUERIES = motion_queries.QUERIES | table_queries.QUERIES | selection_queries.QUERIES | run_queries.QUERIES
SQL = motion_queries.ORACLE_SQL | table_queries.ORACLE_SQL | selection_queries.ORACLE_SQL | run_queries.ORACLE_SQL

pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the small tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, tmp_path, name):
    df = QUERIES[name](spark, str(SF))
    df.write.parquet(str(tmp_path / "out"))
    got = f"'{tmp_path}/out/*.parquet'"
    if name not in SQL:
        assert db.execute(f"SELECT count(*) FROM {got}").fetchall()[0][0] > 0
        return
    db.execute(f"CREATE OR REPLACE TABLE o AS {SQL[name]}")
    columns = sorted(df.columns)
    assert columns == sorted(r[0] for r in db.execute("DESCRIBE o").fetchall())
    c = ", ".join(f'"{x}"' for x in columns)
    assert db.execute(f"SELECT {c} FROM o EXCEPT ALL SELECT {c} FROM {got}").fetchall() == []
    assert db.execute(f"SELECT {c} FROM {got} EXCEPT ALL SELECT {c} FROM o").fetchall() == []

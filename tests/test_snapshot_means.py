"""Means that end in a five after the digits that are kept."""

from pathlib import Path

import duckdb
import pytest

from cadenza.plans import run_queries

SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="needs the small tables")
def test_means_round_as_in_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(f"SELECT run, score FROM ({run_queries.ORACLE_SQL['snapshot_view']})").fetchall()
    got = [(r["run"], r["score"]) for r in run_queries.snapshot_view(spark, str(SF)).collect()]
    assert dict(want)["src12"] == 2.5762 and dict(want)["src8"] == 2.8382  # 2.57625 and 2.83825
    assert sorted(got) == sorted(want)

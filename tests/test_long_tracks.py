"""Queries against a reference track: none has a frame to the end of a series, and their rows are their SQL's where the reference has gaps of every length."""

import duckdb
import numpy as np
import pytest

from cadenza.plans import motion_queries

NAMES = [
    "deviation_csv_rows",
    "worst_moments",
    "coaching_summary",
    "deviation_joint",
    "limb_angle_deviation",
    "dancer_summary",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tracks of 300 frames. The reference's joints are away for 1 to 12 frames, at both ends too; joint 3 is never seen, joint 4 once."""
    r = np.random.default_rng(7)
    e = r.uniform(0.5, 1.0, (3, 300, 64)).astype("float32") * r.choice([-1, 1], (3, 300, 64))
    for j in range(17):
        at = j % 3
        while at < 300:
            gap = int(r.integers(1, 13))
            e[0, at : at + gap, 3 * j + 2] = 0
            at += gap + int(r.integers(1, 9))
        e[0, 300 - j % 4 :, 3 * j + 2] = 0
    e[0, :, [3 * 3 + 2, 3 * 4 + 2]] = 0
    e[0, 150, 3 * 4 + 2] = 1
    rows = [(3 * f + t, e[t, f].tolist(), t) for t in range(3) for f in range(300)] + [(900 + f, e[1, f].tolist(), 1) for f in range(20)]
    out = tmp_path_factory.mktemp("tracks")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_no_frame_to_the_end(spark, tables, name):
    frames = motion_queries.QUERIES[name](spark, tables)._jdf.queryExecution().analyzed().toString().lower()
    assert "currentrow$(), unboundedfollowing" not in frames and "0, unboundedfollowing" not in frames
    assert "unboundedpreceding" in frames


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_the_sql(spark, tables, tmp_path, name):
    df = motion_queries.QUERIES[name](spark, tables)
    df.write.parquet(f"{tmp_path}/out")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tables}/embeddings.parquet/*.parquet'")
    db.execute(f"CREATE TABLE o AS {motion_queries.ORACLE_SQL[name]}")
    c, got = ", ".join(f'"{x}"' for x in df.columns), f"'{tmp_path}/out/*.parquet'"
    assert db.execute("SELECT count(*) FROM o").fetchone()[0] > 0
    assert db.execute(f"SELECT {c} FROM o EXCEPT ALL SELECT {c} FROM {got}").fetchall() == []
    assert db.execute(f"SELECT {c} FROM {got} EXCEPT ALL SELECT {c} FROM o").fetchall() == []

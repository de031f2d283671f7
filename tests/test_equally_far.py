"""Which of several vertices that are equally far splits a line: as the SQL orders them."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tilespark.functions import kernels as k
from tilespark.plans.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"


def test_nearest_to_the_middle_splits():
    x, y = np.array([0.0, 1, 2, 3, 4, 5, 6]), np.array([0.0, 0.5, 1, 2, 2, 0, 0])
    r = k.Rings(x, y, np.array([0, 7]), np.zeros(1, int), np.ones(1, bool))
    assert k.importance(r)[3] < 4 == k.importance(r)[4]  # the scan goes on to the second
    assert k.importance(r, "nearest")[3] == 4 > k.importance(r, "nearest")[4]


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables here")
@pytest.mark.parametrize("z", [2, 6, 8])
def test_repeated_events(spark, tmp_path, z):
    """Events that come several times over make level stretches, whose vertices are equally far."""
    t = pq.read_table(f"{D}/events.parquet")
    n = t.num_rows
    ids = t.schema.get_field_index("event_id")
    many = pa.concat_tables([t.set_column(ids, "event_id", pa.array(t.column("event_id").to_numpy() + i * n)) for i in range(6)])
    pq.write_table(many, tmp_path / "events.parquet")
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, QUERIES[f"simplify_lines_z{z}"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLE[f"simplify_lines_z{z}"]).fetchall())

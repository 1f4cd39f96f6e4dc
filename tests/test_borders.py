"""Queries and their twins agree where a status hangs on the last digit of a distance."""

import duckdb
import pytest

from framegate.plans import registry

#: (k, value) whose distances from the centre are exactly 0.8, 0.9 and 0.65 of the limit.
BORDERS = [(26, 88.8), (32, 21.6), (23, 27.6), (71, 40.2), (50, 12.0)]


@pytest.mark.parametrize("name", ["centering_score", "feedback_priority", "score_gate"])
def test_borders_of_centering(spark, tmp_path, name):
    con = duckdb.connect()
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01', 1, 'view', {v}::DOUBLE, '{{\"k\": {k}}}')" for i, (k, v) in enumerate(BORDERS))
    con.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    ours = registry.QUERIES[name](spark, str(tmp_path))
    twin = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(twin)

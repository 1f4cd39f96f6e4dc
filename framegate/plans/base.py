"""How a query and its DuckDB twin are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000

#: events with us and k, as the Spark side has them.
EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) AS us, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def query(sql: str | None = None):
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep

"""The registered queries: all are there, and those that SQL expresses give what SQL gives."""

import pytest

import __spark_entry__
from framegate.llm import queries
from tests.test_oracles import SF, duck, told  # noqa: F401  a fixture

NAMES = "minhash quality top_k packing simhash line_dedup sharding toxicity chat mixing compression alignment resampling".split()


def test_all_are_registered():
    want = {f"op{k}_{name}" for k, name in enumerate(NAMES, 1)}
    assert set(queries.QUERIES) == want
    assert want | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, duck, name):  # noqa: F811
    ours, twin = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(twin.columns)
    assert len(ours) and told(ours) == told(twin)

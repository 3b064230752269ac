"""Each registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__
from checks.run import compare


@pytest.mark.parametrize("name", list(__spark_entry__.queries()))
def test_query(spark, small, name):
    outcome, _, _ = compare(spark, name, small)
    assert outcome in ("ok", "rows only")


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["item_id", "closest_category_id", "cosine_distance"]
    assert found.count() == 500


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

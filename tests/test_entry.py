"""The driver contract."""

import __spark_entry__ as contract


def test_entry_gives_one_row(spark):
    assert contract.entry(spark).count() == 1


def test_every_sql_counterpart_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())

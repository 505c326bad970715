import pytest
from oracle import held_against_sql

from loamlens.plans import core, index, questions

ALL = core.QUERIES | index.QUERIES | questions.QUERIES
SQL = core.SQL | index.SQL | questions.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_sql_gives(spark, sf, name):
    held_against_sql(spark, sf, ALL[name], SQL[name])


def test_every_query_without_sql_runs(spark, sf):
    for name in sorted(set(ALL) - set(SQL)):
        assert ALL[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query of the library on the smallest tables, against its SQL where it has one."""

import os

import pytest

from cohortalign import registry
from compare import DATA, NUMPY, duck_rows, spark_rows

Q, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert spark_rows(Q[name](spark, DATA)) == duck_rows(SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL) - NUMPY))
def test_runs(spark, name):
    assert Q[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())

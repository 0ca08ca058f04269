import os

import pytest

from mdspark.plans.queries import ORACLE, QUERIES

from .compare import connect, rows
from .conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = connect(DATA).execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_labels_agree_with_formulas(spark):
    got = QUERIES["molecule_label"](spark, DATA).toPandas()
    assert (got.groupby("label").formula.nunique() == 1).all()
    assert got.label.nunique() >= got.formula.nunique()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

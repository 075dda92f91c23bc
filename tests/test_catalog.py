"""Every query against its SQL, on the smallest tables."""

import math

import pytest

from tidemark.plans.catalog import ORACLES, QUERIES

from .conftest import DATA


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 3) if isinstance(x, float) else str(x) if not isinstance(x, (int, str)) else x


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(repr([plain(x) for x in r]) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

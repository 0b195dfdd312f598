"""Every registered count-table query against its SQL on the smallest tables."""

import pytest

from tallyloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def table(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    shown = plain.map(lambda v: v if v is None or isinstance(v, (str, bool)) else f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v))
    return columns, sorted(map(tuple, shown.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    assert table(QUERIES[name](spark, sf).toPandas()) == table(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

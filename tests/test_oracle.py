"""Every registered query on the smallest tables, against its SQL."""

import pytest

import oracle
from lanternfold import catalog

SF = "sf0.001"
PLANS, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, con, name):
    frame = PLANS[name](spark, f"{oracle.DATA}/{SF}").toPandas()
    if name in SQL:
        assert oracle.difference(frame, con.execute(SQL[name]).df()) == ""
    else:
        assert len(frame) > 0 and len(frame.columns) > 1 and frame.notna().any().all()

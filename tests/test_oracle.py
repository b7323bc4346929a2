"""Every registered report query against its DuckDB oracle on sf0.001 (values to 9 significant places)."""
import math

import pytest

import __spark_entry__ as E
from conftest import SF
from tillpoint.catalog import registry

ORACLE = E.oracle_sql()
NAMES = sorted(registry())


def _norm(v):
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2**53:
            return int(v)
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(sdf.columns) > 0
        return
    odf = duck.execute(ORACLE[name]).df()
    sc, sr = _rows(sdf)
    oc, orr = _rows(odf)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr

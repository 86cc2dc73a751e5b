import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 6))
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in catalog.TABLES:
        out.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want

import pytest
from oracle import compare

from loomwork.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        compare(df, ORACLES[name], data)
    else:
        rows = df.collect()
        assert rows and all(any(v is not None for v in r) for r in rows)


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

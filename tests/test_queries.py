"""Every registered graph query against its SQL, and the driver contract."""

import pandas as pd
import pytest

from graphloom.plans.catalogue import CATALOGUE


def canon(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    return df[columns].sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CATALOGUE.items() if sql))
def test_against_sql(spark, sf, duck, name):
    query, sql = CATALOGUE[name]
    pd.testing.assert_frame_equal(canon(query(spark, sf).toPandas()), canon(duck.execute(sql).df()), check_dtype=False, atol=1.1e-6, rtol=0)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CATALOGUE.items() if not sql))
def test_rows(spark, sf, name):
    assert CATALOGUE[name][0](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query with an oracle gives the rows that SQL gives on the same tables."""

import math

import duckdb
import pytest

from citemill.plans import catalog
from citemill.plans.views import TABLES

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_equal_the_oracle(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    result = duck.execute(catalog.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(kinds) == columns
    assert {c: KINDS[k] for c, k in kinds.items()} == dict(df.dtypes)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    order = [list(kinds).index(c) for c in columns]
    other = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
    assert own == other


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_give_rows(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "headline" in df.columns


def test_contract_covers_oracles():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

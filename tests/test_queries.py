import duckdb
import pandas as pd
import pytest

from verdant.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def rows_of(df: pd.DataFrame) -> list[str]:
    own = df[sorted(df)].astype(object).where(df[sorted(df)].notna(), None)
    return sorted(repr([float(v) if isinstance(v, (int, float)) else v for v in r]) for r in own.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows_of(registry.QUERIES[name](spark, SF).toPandas()) == rows_of(con.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0

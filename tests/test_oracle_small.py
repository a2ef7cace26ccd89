"""Every registered query with an oracle equals DuckDB on the sf0.001 tables."""
import os
import sys

import duckdb
import pytest

from tests.conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, digest, norm  # noqa: E402

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL).toPandas()
    odf = con.execute(ORACLES[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert len(sdf) == len(odf)
    assert digest(norm(sdf)) == digest(norm(odf))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["__timestamp", "__id", "__label"]


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "boolean": "BOOLEAN",
                 "array<double>": "DOUBLE[]", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_types_match_oracle(spark, con, name):
    """Column types agree too (the gate compares schemas, not only values)."""
    st = {f.name: f.dataType.simpleString() for f in QUERIES[name](spark, SF_SMALL).schema.fields}
    rel = con.sql(ORACLES[name])
    for col, dtype in zip(rel.columns, rel.types):
        assert SPARK_TO_DUCK.get(st[col], st[col]) == str(dtype), (col, st[col], str(dtype))

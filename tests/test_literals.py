"""Operators over small tables and files given in literal_tables.py, against SQL on the same."""

import duckdb
import literal_tables
import pytest
from test_queries import plain

from corpuscle.cluster import ship_code


@pytest.mark.parametrize("name", sorted(literal_tables.QUERIES))
def test_operator_equals_sql(spark, sf_dir, name):
    ship_code(spark)
    df = literal_tables.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duckdb.connect().execute(literal_tables.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert ours == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())

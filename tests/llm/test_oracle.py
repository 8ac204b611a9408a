import duckdb
import pytest

from evenhand.llm.oracle import ORACLE
from evenhand.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same_rows(spark, base, name):
    with duckdb.connect() as db:
        for table in ("documents", "pages", "conversations"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{base}/{table}.parquet'")
        got = QUERIES[name](spark, base)
        expected = db.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)

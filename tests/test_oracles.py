"""Grid queries against DuckDB on the smallest driver tables that fill the grids."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.01"
TABLES = "lineitem events embeddings orders documents labels benchmark".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def names():
    from quiltra.plans import registry

    return list(registry.queries())


def normal(rows, columns):
    def value(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            x = float(x)
            return "nan" if math.isnan(x) else f"{x + 0.0:.6f}"
        return str(x)

    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, name):
    from quiltra.plans import registry

    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [r.asDict() for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:  # what depends on the time of files has no SQL
        assert name == "s21_newest_file" and len(got) == 1 and got[0]["path"].endswith(".parquet")
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(sql)
    there = [d[0] for d in r.description]
    assert sorted(there) == columns
    want = [dict(zip(there, row)) for row in r.fetchall()]
    assert normal(got, columns) == normal(want, columns)

"""Every query of the library that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from tallywright.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations labels".split()


def rounded(rows):
    return sorted(str([round(v, 4) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    df = registry.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert rounded(got) == rounded(want.fetchall())

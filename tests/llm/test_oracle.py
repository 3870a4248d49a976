import math

import duckdb
import pytest
from quillstream.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    df = QUERIES[name](spark, sf)
    assert df.columns == columns
    clean = lambda rows: sorted([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows], key=repr)
    assert clean(map(tuple, df.collect())) == clean(got.fetchall())

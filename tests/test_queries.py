"""Every query against its SQL in DuckDB, on the driver's smallest tables."""

import math

import duckdb
import pytest
from quillstream.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if not isinstance(v, (int, bool, str, type(None))) else v


def same(spark_rows, columns, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(columns)
    order = sorted(names)
    want = sorted(([plain(r[names.index(c)]) for c in order] for r in got.fetchall()), key=repr)
    have = sorted(([plain(r[c]) for c in order] for r in spark_rows), key=repr)
    assert len(have) == len(want)
    assert have == want


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    same(df.collect(), df.columns, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_pairs_of_equal_shares_match_sql(spark, tmp_path):
    """Equal shares of sets of 5 and of 7 words differ in the SQL's last bit, 55 of 64 words are rounded up, and lines without an id meet none."""
    w = [f"w{i}" for i in range(73)]
    shares = [w[0:5], w[6::-1], w[0:7:2] + w[1:7:2]]
    rounded = [w[:64], w[54:0:-2] + w[53:0:-2] + w[0:1] + w[64:73]]
    texts = {1: shares, 2: rounded, None: [w[:5], w[4::-1]]}
    rows = [(k, "\n".join(" ".join(x) for x in ls)) for k, ls in texts.items()] + [(4, None), (5, "")]
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    con.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    df = registry.QUERIES["repetition_pairs_native"](spark, str(tmp_path))
    got = df.collect()
    same(got, df.columns, registry.ORACLE_SQL["repetition_pairs_native"], tmp_path)
    assert sorted((r.doc_id, r.right_line, r.left_line, r.similarity) for r in got) == [(1, 1, 0, 0.82), (1, 2, 1, 0.82), (2, 1, 0, 0.704688)]

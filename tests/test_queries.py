"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from recollect.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = duck.execute(Q.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


#: Folds over texts, walks of several hops, Python's regular expressions: test_graph.py holds these against models.
NO_SQL = {"ner_entities", "walk_strict_many", "retrieve_smoke", "retrieve_burn", "retrieve_inferno", "retrieve_burn_text", "consolidate_strict"}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_rows_are_there_and_do_not_depend_on_partitions(spark, name):
    assert name in NO_SQL
    rows = lambda: sorted(map(str, Q.QUERIES[name](spark, SF).collect()))
    once = rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert once and rows() == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

"""Every registered query with SQL gives that SQL's rows, on the smallest tables."""

import duckdb
import pytest

from tessella.plans import advanced, extras, library, recipes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = {**library.QUERIES, **recipes.PLANS, **extras.QUERIES, **advanced.QUERIES}
SQL = {name: q.sql for name, q in (library.QUERIES | recipes.PLANS).items()} | extras.SQL | advanced.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = ALL[name](spark, SF)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_similarity_finds_itself(spark):
    best = [r for r in extras.text_similarity(spark, SF).collect() if r["rank"] == 1]
    assert best and all(r.l_id == r.r_id and r.score == 1 for r in best)

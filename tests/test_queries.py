"""Every registered query against its SQL on the smallest tables."""

import datetime
import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return float(v) if v.__class__.__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, cols = df.collect(), df.columns
    if name not in ORACLES:
        # the training-data operators are held against brute force in their own tests
        assert rows and re.match(r"op\d+_|pipeline$", name), f"{name} has no SQL"
        return
    res = duck.execute(ORACLES[name])
    theirs = [d[0] for d in res.description]
    assert sorted(cols) == sorted(theirs)
    pick = lambda r, names: tuple(canon(r[names.index(c)]) for c in sorted(cols))
    assert sorted((pick(r, cols) for r in rows), key=repr) == sorted((pick(r, theirs) for r in res.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_inventory_is_there():
    areas = {
        "src": 7, "flt": 8, "prj": 4, "jn": 18, "agg": 18, "win": 9, "top": 8, "set": 5, "txt": 25, "arr": 2, "jsn": 1, "dat": 1, "mth": 1, "dq": 6, "swp": 2,
    }
    have = {q.split("_")[0] for q in QUERIES}
    assert [f"{a}{i}" for a, n in areas.items() for i in range(1, n + 1) if f"{a}{i}" not in have] == []

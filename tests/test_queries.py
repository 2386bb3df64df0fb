"""Every query beside its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sparkpact.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got[1]
        return
    cursor = duck.execute(SQL[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


#: What every row breaks, or none does, would prove little.
@pytest.mark.parametrize("name", sorted(n for n in SQL if n.startswith("kw_")))
def test_keyword_queries_separate_rows(duck, name):
    source = next(t for t, key in (("lineitem", "l_linenumber"), ("events", "event_id"), ("embeddings", "vec_id"), ("customer", "c_custkey"), ("documents", "doc_id"), ("pages", "page_id"), ("part", "p_partkey"), ("orders", "o_orderkey")) if key in SQL[name])
    key = {"lineitem": "l_orderkey, l_linenumber", "events": "event_id", "embeddings": "vec_id", "customer": "c_custkey", "documents": "doc_id", "pages": "page_id", "part": "p_partkey", "orders": "o_orderkey"}[source]
    bad = duck.execute(f"SELECT count(*) FROM (SELECT DISTINCT {key} FROM ({SQL[name]}))").fetchone()[0]
    assert bad > 0
    if name != "kw_root_properties":  # few rows meet so many rules
        assert bad < duck.execute(f"SELECT count(*) FROM {source}").fetchone()[0]

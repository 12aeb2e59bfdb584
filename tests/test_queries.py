import importlib
import os
import sys

import duckdb
import pytest

import __spark_entry__
from mooreflow.table_queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain(tuple(r[c] for c in cols) for r in df.collect())
    if name in SQL:
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})")
        assert got == plain(want.fetchall())
    else:
        assert got


def test_parse_errors_of_large_keys(spark, tmp_path):
    path = f"{tmp_path}/supplier.parquet"
    spark.range(9_990, 10_020).unionAll(spark.range(10**9, 10**9 + 18)).withColumnRenamed("id", "s_suppkey").write.parquet(path)
    got = __spark_entry__.queries()["parse_errors"](spark, str(tmp_path)).select("supplier", "line", "col", "message").collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert plain(got) == plain(c.execute(SQL["parse_errors"]).fetchall()) and len(got) == 48


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_it_stands_without_the_corpus_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("mooreflow.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "mooreflow.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(importlib.reload(__spark_entry__).queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)

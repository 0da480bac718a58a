"""Mixing against the query's DuckDB SQL and by its rules."""

from collections import defaultdict

import duckdb
import pandas as pd

from tidemark.llm import mixing as m


def against_sql(rows, documents: pd.DataFrame):  # DuckDB reads documents by its name
    want = duckdb.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({m.ORACLE_SQL})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows), key=key)
    assert got == sorted((tuple(r) for r in want), key=key)


def rules(rows):
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for group in by.values():
        assert sum(r.taken for r in group) == int(group[0].target)
        assert group[0].target <= 2 * group[0].source_size


def test_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = m.mix(table).collect()
    against_sql(rows, table.toPandas())
    rules(rows)
    again = sorted((r.doc_id, r.taken) for r in m.mix(table.repartition(7)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in rows)


def test_odd_rows(spark):
    data = [(1, "a b c", None, 1), (1, "a b c", None, 1), (2, None, "x", 1), (None, "d e " * 500, "x", 1), (4, "", "empty", 1), (5, "one", "é", 1), (6, "q " * 40, "b", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, key int")
    rows = m.mix(df).collect()
    rules(rows)
    documents = pd.DataFrame(data, columns=["doc_id", "text", "source", "key"]).astype({"doc_id": "Int64"})
    against_sql(rows, documents)
    assert m.mix(df.limit(0)).count() == 0

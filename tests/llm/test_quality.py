"""Quality rules against a plain count, and against the query's DuckDB SQL."""

import re
from collections import Counter

import duckdb

from tidemark.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    hit = {p for i, g in enumerate(windows) if often[g] > 1 for p in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


TEXTS = [
    None, "", "a " * 7, "a " * 8, "a " * 9, "the of é\n\nthe of é\n \t\nthe of é", "x y z " * 40, "the and " + " ".join(f"word{i}" for i in range(40)),
    "# * $ %% &|<>", "\x1fa\x0bb\x85c d", "long " + "z" * 100_000 + " end", " ".join(f"w{i}" for i in range(30)) + " q " + " ".join(f"w{i}" for i in range(30)),
]


def test_metrics(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, kept string")
    rows = q.judge(df).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        m = r.quality_metrics
        got = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, bool({*q.BASE} & {*r.failed_rules}))
        assert got == brute(r.text), r.text
        assert r.kept == (not r.failed_rules)
    kept = q.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert q.keep_good(df.limit(0)).count() == 0


def test_query_and_labels(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(q.ORACLE_SQL).fetchall())
    cols = [x[0] for x in con.sql(q.ORACLE_SQL).description]
    assert sorted(tuple(r[c] for c in cols) for r in q.query(spark, sf_dir).collect()) == want
    kept = {r.doc_id: r.kept for r in q.query(spark, sf_dir).collect()}
    rows = con.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall()
    good = [kept[i] for i, x in rows if x == 1]
    bad = [kept[i] for i, x in rows if x == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.1 * len(bad)

"""The pipeline against plain versions of its stages, one after another."""

import random

import duckdb
import pandas as pd
from test_near_dedup import brute as near
from test_secret_scan import brute as secret
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, mixing, quality

WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def redacted(text):
    out, at = "", 0
    for a, _, b, _ in secret(text)[1]:
        if b <= at:
            continue
        out += "" if a < at else text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark, sf_dir):
    sf = sf_dir
    table = spark.read.parquet(f"{sf}/documents.parquet")
    documents = table.toPandas()  # noqa: F841  read by DuckDB
    good = duckdb.sql(f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept").df()["doc_id"]
    kept = documents[documents["doc_id"].isin(good)]
    df = corpus_pipeline.quality_rules(spark, table, sf)
    assert sorted(df.toPandas()["doc_id"]) == sorted(kept["doc_id"]) and df.columns == table.columns

    rows = list(zip(kept["doc_id"].tolist(), kept["text"].tolist()))
    of = near(rows)
    kept = kept[[of[i] == i for i in kept["doc_id"]]]
    kept = kept.assign(text=[redacted(t) for t in kept["text"]])

    documents = kept  # noqa: F841
    taken = dict(duckdb.sql(f"SELECT doc_id, taken FROM ({mixing.ORACLE_SQL})").fetchall())
    tok = Tokenizer.from_file(bpe.default_path())
    import re

    want = []
    for i, t in zip(kept["doc_id"], kept["text"]):
        pieces = re.findall(WORD, t)
        n = taken[i]
        while n >= len(pieces) > 0:
            want.append((i, tok.encode(t, add_special_tokens=False).ids))
            n -= len(pieces)
        if n:
            want.append((i, tok.encode("".join(pieces[:n]), add_special_tokens=False).ids))
    got = [(r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50


def test_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string, range int"
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    random.seed(2)
    good = " ".join(["the", "of", *[word() for _ in range(60)]])
    rows = [(1, good, None, None, 5, 1, "x", 2), (1, good, None, None, 5, 1, "x", 2), (2, None, "en", "a", None, None, None, None), (3, "", "en", "b", 0, 0, "", 0), (None, " ".join(["the", *[word() for _ in range(50)]]) + " token=abcdefgh", "en", "a", 9, 9, "y", 9)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
    out = docs.collect()
    assert {r.doc_id for r in out} == {1, None}
    assert all(r.n_chars == len(r.text) for r in out) and any("[SECRET]" in r.text for r in out)
    assert corpus_pipeline.encoding(spark, docs, sf_dir).count() == len(out)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_mixed_rows_follow_mix(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.taken for r in mixing.mix(table).collect() if r.taken}
    got = pd.Series(0, index=list(want))
    for r in mixing.mixed(table).collect():
        got[r.doc_id] += len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got.to_dict() == want

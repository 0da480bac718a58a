"""BPE against the tokenizers library."""

import hashlib
import random

import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import bpe

TEXTS = [
    None, "", " \n\t ", "Hello WORLD don't we've I'll", "ΑΣ ΣΑΣ İI K ſ \x85　x a\x1cb \x1f", "áe ẛ̣ ﬁ é", "a" * 5000, "1234567 ²½Ⅷ _-_ !!!???",
    "a b<|endoftext|>c <|startoftext|> d<|endoftext|>", "字漢 한글 🎉🎉", "pre prefix prefixes prefixed pref",
]


def texts():
    random.seed(8)
    pools = ["ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "aà éñ", "字漢한글🎉", "0123", "!?.-_'"]
    words = ["".join(random.choice(random.choice(pools)) for _ in range(random.randint(1, 14))) for _ in range(4000)]
    return TEXTS + [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]


def test_ids_and_round_trip(spark):
    tok = Tokenizer.from_file(bpe.default_path())
    data = texts()
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(data)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.encode(df).collect()}
    short = {r.doc_id: r for r in bpe.digests(df).collect()}
    assert len(rows) == len(data)
    for i, t in enumerate(data):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert list(rows[i].ids) == ids, t
        text = tok.decode(ids, skip_special_tokens=False)
        assert rows[i].decoded == text and rows[i].n_tokens == len(ids) == short[i].n_tokens
        assert short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {i: rows[i].decoded for i in rows}
    assert bpe.encode(df.limit(0)).count() == bpe.decode(bpe.encode(df.limit(0))).count() == 0


def test_table(spark, sf_dir):
    tok = Tokenizer.from_file(bpe.default_path())
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.query(spark, sf_dir).collect():
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_batches_that_leave_a_task_are_small():
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array(["some words " * 30_000] * 8)], names=["doc_id", "text"])
    out = list(bpe.encoder(bpe.default_path(), with_ids=True)(iter([batch])))
    assert sum(b.num_rows for b in out) == 8 and max(b.num_rows for b in out) <= 3

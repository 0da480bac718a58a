"""Repeat removal against a dictionary of all strings of the length."""

import hashlib
import random

import numpy as np

from tidemark.llm import repeat_removal as s


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            k = t[i : i + length]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def compare(spark, texts, length, gram, most=s.MOST_BYTES):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: tuple(r)[1:] for r in s.digests(df, length, gram, most).collect()}
    want = brute(texts, length)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i][:80] if texts[i] else None)
    return want


def test_random_texts(spark):
    random.seed(5)
    block = "".join(random.choice("abcdé ") for _ in range(300))
    texts = [None, "", "x" * 200, "x" * 30, "ab" * 40, "short", "copy " * 3, "copy " * 3, block, block, block[20:200] + "q" + block[210:]]
    for _ in range(40):
        t = "".join(random.choice("abcdefg é") for _ in range(random.randint(0, 120)))
        for _ in range(random.randint(0, 3)):
            a = random.randint(0, 250)
            t += block[a : a + random.randint(5, 90)] + random.choice("xyz")
        texts.append(t)
    want = compare(spark, texts, 40, 24)
    assert compare(spark, texts, 40, 24, most=200) == want  # most anchors are too large for one task
    assert sum(w[1] for w in want) > 1000
    assert s.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_table(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = compare(spark, texts, s.LENGTH, s.GRAM)
    assert sum(w[1] for w in want) > 0


def test_remove_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 500, "a"), (2, None, "b"), (3, "clean", "c")], "doc_id long, text string, copy string")
    out = {r.doc_id: (r.text, r.copy) for r in s.remove(docs).collect()}
    assert out[1] == ("", "a") and out[3] == ("clean", "c") and out[2][1] == "b"


def test_suffix_order():
    rng = np.random.default_rng(4)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 20, 61, 100, 301]:
        for letters in (1, 2, 5):
            x = rng.integers(1, letters + 1, n)
            assert s.suffix_order(x.astype(np.int64)).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_repeats_of_one_text(spark):
    rows = [(1, "q" * 2000), (2, "q" * 2000), (3, ("ab" * 300) + "x"), (3, ("ab" * 300) + "x"), (4, "unlike " + "".join(chr(97 + i * i % 23) for i in range(350)))]
    compare(spark, [t for _, t in rows], s.LENGTH, s.GRAM)
    out = s.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(len(r.text) for r in out)[:4] == [0, 0, 0, 0] and len(out) == 5
    assert s.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0

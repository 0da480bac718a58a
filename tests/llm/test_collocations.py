"""Collocations against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations as s
from tidemark.llm import tokens as T


def brute(docs, least, top=s.TOP):
    counts = {}
    for lang, text in docs:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall("[^ \t]+", piece)
            f.update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, b in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= 80 * f[p[i : i + m]]}
        rows = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -score) for i, (score, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(rng, n):
    words = ["The", "of", "New", "York", "é", "'s", "a-b", "z"] + [f"r{i}" for i in range(30)]
    docs = []
    for i in range(n):
        w = rng.choices(words, [30, 20, 5, 5, 3, 3, 2, 2] + [1] * 30, k=rng.randint(0, 60))
        text = " ".join(x + rng.choice(["", "", "", ".", ",\n", "\t"]) for x in w) + " new york times square" * rng.randint(0, 2)
        docs.append((rng.choice(["en", "en", "de", None, ""]), text))
    return docs + [("en", None), ("en", ""), (None, " .,; "), ("fr", "once only")] + [("en", "the new york times square " * 400)] * 2


@pytest.mark.parametrize("ranges", [200_000, 20])
def test_against_counting(spark, monkeypatch, ranges):
    monkeypatch.setattr(s, "RANGE_ROWS", ranges)
    docs = texts(random.Random(ranges), 150)
    df = spark.createDataFrame([(*d, 7, 1.0) for d in docs], "lang string, text string, h1 long, f double").repartition(3)
    assert rows(s.collocations(df, least=4)) == brute(docs, 4)
    assert len({r[0] for r in brute(docs, 4)}) >= 4


def test_top_and_empty(spark):
    docs = texts(random.Random(3), 60)
    df = spark.createDataFrame(docs, "lang string, text string")
    assert rows(s.collocations(df, top=5, least=4)) == brute(docs, 4, 5)
    assert s.collocations(df.limit(0)).count() == 0


def test_a_clash_of_hashes_takes_another_hash(spark, monkeypatch):
    docs = texts(random.Random(5), 60)
    real = s._table
    # under salt 0 all letters look alike, so words clash
    monkeypatch.setattr(s, "_table", lambda salt: real(salt) if salt else np.where(np.arange(256) > 96, 97, np.arange(256)).astype(np.uint8))
    assert rows(s.collocations(spark.createDataFrame(docs, "lang string, text string"), least=4)) == brute(docs, 4)


def test_products_beyond_64_bits(spark):
    big = 3 * 10**18
    lane = lambda *w: [*w, *[s.PAD] * (4 - len(w))]
    data = [(1, *lane(5), 2 * big), (1, *lane(9), big + 7), (2, *lane(5, 9), big - 1)]
    out = s.scored(spark.createDataFrame(data, "n int, h1 long, h2 long, h3 long, h4 long, f long")).collect()
    assert [(r.a, r.l, r.r, r.score) for r in out] == [(big - 1, 2 * big, big + 7, 2_000_000 * (big - 1) // (3 * big + 7))]


def test_slices_do_not_join_texts():
    import pyarrow as pa

    _, words, h, doc, piece = s.words_in(pa.array(["a", "a", "b"]), pa.array(["x y", "x. Y", None]), 0)
    assert list(doc) == [0, 0, 1, 1] and len(set(piece)) == 3 and h[0] == h[2] and h[1] == h[3] and isinstance(words, T.Words)


def test_query(spark, sf_dir):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows(s.query(spark, sf_dir)) == brute(docs, s.LEAST)

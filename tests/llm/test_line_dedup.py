"""Unit dedup against a plain dictionary of normalised units."""

import re

import pytest

from tidemark.llm import line_dedup as s


def units(text, unit):
    low = (text or "").encode().lower().decode()
    cut = {"line": r"[^\n\r]*[\n\r]?", "sentence": r"(?s)(?:[^\n\r.!?]|[.!?](?![ \t\x0b\x0c\n\r]|\Z))*(?:[\n\r]|[.!?]|\Z)", "paragraph": None}[unit]
    if unit == "paragraph":
        bounds = [0, *(m.end() for m in re.finditer(r"(?<=[\n\r])[\n\r]", low)), len(low)]
        pieces = list(zip(bounds, bounds[1:]))
    else:
        pieces = [m.span() for m in re.finditer(cut, low) if m.group()]
    for a, b in pieces:
        words = list(re.finditer(r"[0-9a-z\x80-\U0010ffff]+", low[a:b]))
        if len(words) >= s.MIN_WORDS:
            end = a + len(low[a:b]) - (low[b - 1] in "\n\r")
            yield a + words[0].start(), max(end, a + words[-1].end()), tuple(w.group() for w in words)


def brute(docs, unit):
    first, out = {}, []
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        for a, b, key in units(t, unit):
            if key in first:
                out.append((i, a, b, len(key), first[key]))
            else:
                first[key] = i
    return sorted(out, key=str)


@pytest.mark.parametrize("unit", s.UNITS)
def test_against_dictionary(spark, unit):
    docs = [
        (5, "One two three four five. One two three four five!\nsix"), (2, None), (3, ""), (1, "é ONE, two - three four five\n\n\na b c d e f"),
        (9, "a b c d e f\na b c d e f.g h"), (None, "A B C D E F\n\nshort line"), (7, "x " * 2000 + "."), (8, "x " * 2000), (11, "\n\n.. \n"),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, start int")
    got = sorted((tuple(r) for r in s.removals(df, unit).collect()), key=str)
    assert got == brute(docs, unit)
    clean = {r.doc_id: r for r in s.deduplicate(df, unit).collect()}
    assert len(clean) == len(docs) and clean[2].text is None
    for i, t in docs:
        cut = sorted(x[1:3] for x in got if x[0] == i)
        left = t
        for a, b in reversed(cut):
            left = left[:a] + left[b:]
        assert clean[i].text == left
    assert s.removals(df.limit(0), unit).count() == 0


def test_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in s.query(spark, sf_dir).collect()), key=str)
    assert got == brute(docs, "sentence") and got


def brute_levels(docs, monkeypatch):
    every = []
    for i, t in docs:
        with monkeypatch.context() as m:
            m.setattr(s, "MIN_WORDS", 1)
            lines = list(units(t, "line"))
        every += [(i, a, b, key, None) for a, b, key in lines]
        for a, b, key in units(t, "sentence"):
            line = next(x[:2] for x in reversed(lines) if x[0] <= a)
            if line != (a, b):
                every.append((i, a, b, key, line))
    first = {}
    for i, a, _, key, _ in sorted(every, key=lambda x: x[:2]):
        first.setdefault(key, (i, a))
    gone = {x[:3] for x in every if first[x[3]] != x[:2]}
    return sorted((i, a, b, len(key), first[key][0]) for i, a, b, key, line in every if (i, a, b) in gone and (i, *(line or (0, -1))) not in gone)


def test_short_lines_go_and_short_sentences_stay(spark, monkeypatch):
    docs = [
        (1, "Sign up. Read more. Share it.\nMr. Smith came home to us today. He left."), (2, "Sign up. Read more. Share it.\nMr. Jones left."),
        (3, "Home\nWe say: he came home to us today. Mr. Smith came home to us today.\nHome\nx"), (4, "\nHome\n\nSmith came home to us today!"),
    ]
    got = sorted(tuple(r) for r in s.level_removals(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute_levels(docs, monkeypatch)
    assert (2, 0, 29, 6, 1) in got and (4, 1, 5, 1, 3) in got and all(r[:2] != (3, 39) for r in got)


def test_registered_query(spark, sf_dir, monkeypatch):
    from tidemark.llm import registry

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in registry.QUERIES["op9_line_dedup"](spark, sf_dir).collect())
    assert got == brute_levels(docs, monkeypatch) and any(r[3] < s.MIN_WORDS for r in got)

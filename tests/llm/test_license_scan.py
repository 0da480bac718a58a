"""License scans against a plain search for the base phrases and a plain edit distance for the notices."""

from tidemark.llm import license_scan as s


def brute(text):
    words, at = [], ""
    for c in (text or "").encode().lower().decode() + " ":
        if c > "\x7f" or "0" <= c <= "9" or "a" <= c <= "z":
            at += c
        elif at:
            words.append(at)
            at = ""
    places = []
    for phrase, label in s.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), places


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


TEXTS = [
    None, "", "MIT License", "mit license mit license apache license", "the MIT-Licence text", "CC BY 4.0, cc\nby",
    "under the GNU\n * General Publc Licens, v3", "é Apache  License é", "Redistribution and use in sourze and binary form",
    "x " * 3000 + "Permission is hereby granted, free of charge, to any person obtaining a copy", "mitlicense ccby",
]


def check(r, text):
    n, places = brute(text)
    labels = sorted({x for _, x in places})
    assert (r.n_words, r.n_base) == (n, len(places))
    assert r.first_word == min((p for p, _ in places), default=None)
    assert r.last_word == max((p for p, _ in places), default=None)
    assert r.base_labels == ",".join(labels)
    assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_base_and_spans(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, label int")
    rows = {r.doc_id: r for r in s.scan(docs).collect()}
    for i, t in enumerate(TEXTS):
        check(rows[i], t)
        for x in rows[i].spans:
            piece = " ".join(s.WORD.findall(t[x.start : x.end].lower()))
            assert min(distance(piece, n.words) for n in s.NOTICES if n.label == x.label) <= x.edits
    assert rows[4].labels == "mit" and rows[4].base_labels == ""
    assert rows[6].labels == "gpl" and rows[8].labels == "bsd" and "mit" in rows[9].labels
    assert rows[10].labels == "mit"  # one edit: the space


def test_query(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = s.query(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        check(r, text[r.doc_id])

"""Stems, ranked search and profiles against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking as R
from tidemark.operators.stemming import porter, stemmed

# word and stem of the examples in the paper, at the end of all its steps
STEMS = """caresses caress|ponies poni|ties ti|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing
conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file
happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|digitizer digit|vietnamization vietnam
operator oper|feudalism feudal|decisiveness decis|hopefulness hope|formaliti formal|sensibiliti sensibl|triplicate triplic
formative form|formalize formal|electrical electr|goodness good|revival reviv|allowance allow|inference infer|airliner airlin
adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt
communism commun|activate activ|effective effect|probate probat|rate rate|cease ceas|controll control|roll roll|running run|is is"""


def test_stems():
    for pair in STEMS.replace("\n", "|").split("|"):
        word, want = pair.split()
        assert porter(word) == want, word
    assert [porter(w) for w in ("", "a", "été", "x9s", "yes", "sss")] == ["", "a", "été", "x9s", "ye", "sss"]


def test_stemmed_words_of_a_table(spark):
    df = spark.createDataFrame([(1, "running"), (2, "runs"), (3, None), (4, "running")], "id int, term string")
    assert sorted((r.id, r.term) for r in stemmed(df, "term").collect()) == [(1, "run"), (2, "run"), (3, None), (4, "run")]


DOCS = [(1, "Running dogs run; a dog runs.", 1.0, "x"), (2, "The cat sleeps", 2.0, "x"), (3, "dogs and cats, dogs", None, "y"), (4, None, 1.0, "y"), (5, "", 1.0, "x"), (6, "été bleu", 1.0, "x"), (7, "a runner", 1.0, "y"), (8, "été bleu", 1.0, "z")]
QUERIES = [(1, "run dog"), (2, "dog dog cat"), (3, "ab"), (4, None), (5, "nothing here"), (6, "ÉTÉ"), (7, "z z z z z z z z dog")]


def brute(stem, k, kept):
    words = {d: [stem(w) for w in re.findall(r"\w+", (t or "").lower())] for d, t, _, _ in DOCS}
    df = Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for q, text in QUERIES:
        terms = [stem(w) for w in re.findall(r"\w+", (text or "").lower())][:8] if len((text or "").strip()) >= 3 else []
        scores = []
        for d, _, weight, source in DOCS:
            s = 0.0
            for t in terms:
                tf = words[d].count(t)
                idf = math.log((len(words) - df[t] + 0.5) / (df[t] + 0.5))
                s += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[d]) / mean))
            if source in kept and set(terms) & set(words[d]):
                scores.append((-round((1.0 if weight is None else weight) * s, 9), d))
        out |= {(q, i + 1): (d, pytest.approx(-s)) for i, (s, d) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("stem", [True, False])
def test_search(spark, stem):
    docs = spark.createDataFrame(DOCS, "doc int, text string, weight double, source string")
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    ix = R.index(docs, "doc", F.col("text"), F.col("weight"), ["source"], stem)
    plain = porter if stem else (lambda w: w)
    got = {(r.query_id, r.place): (r.doc, r.score) for r in R.search(ix, "doc", queries, 2, stem=stem).collect()}
    assert got == brute(plain, 2, "xyz")
    assert got[1, 1][0] == 1 and (3, 1) not in got and (7, 1) not in got
    some = R.search(ix, "doc", queries, 5, F.col("source") == "x", stem).collect()
    assert {(r.query_id, r.place): (r.doc, r.score) for r in some} == brute(plain, 5, "x")
    empty = R.index(docs.where("false"), "doc", F.col("text"), stem=stem)
    assert R.search(empty, "doc", queries, stem=stem).count() == 0


def test_profiles_of_all_owners(spark):
    texts = {i: " ".join(["the", "market", f"word{i % 3}", f"deep{i}", "market" if i % 2 else "The a", f"word{i % 3}"]) for i in range(9)} | {9: None, 10: ""}
    read = [(o, i) for o in (1, 2, 3) for i in range(11) if (i + o) % o == 0 and (o < 3 or i < 7)] + [(2, 4), (1, 99), (4, 1)]
    items = spark.createDataFrame(list(texts.items()), "item int, text string")
    got = defaultdict(dict)
    for r in R.owner_profiles(spark.createDataFrame(read, "owner int, item int"), items, ["the"], features=7, top=5, least=5).collect():
        got[r.owner][r.place] = (r.term, r.w)
    want = {}
    for o in {o for o, _ in read}:
        mine = sorted({i for a, i in read if a == o and i in texts})
        if len(mine) < 5:
            continue
        counts = []
        for i in mine:
            w = [x for x in re.findall(r"\w\w+", (texts[i] or "").lower()) if x != "the"]
            counts.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
        total = sum(counts, Counter())
        chosen = sorted(total, key=lambda t: (-total[t], t))[:7]
        n, mean = len(mine), Counter()
        for c in counts:
            x = {t: (1 + math.log(c[t])) * (math.log((1 + n) / (1 + sum(t in d for d in counts))) + 1) for t in chosen if c[t]}
            size = math.sqrt(sum(v * v for v in x.values()))
            for t, v in x.items():
                mean[t] += v / size / n
        best = sorted(mean, key=lambda t: (-round(mean[t], 9), t))[:5]
        want[o] = {p + 1: (t, pytest.approx(mean[t], abs=1e-8)) for p, t in enumerate(best)}
    assert dict(got) == want and set(want) == {1, 2}


def test_newest_items(spark):
    rows = [(1, 5, "view", 1), (1, 5, "view", 9), (1, 6, "view", 8), (1, 7, "click", 8), (1, 8, "error", 99), (2, None, "view", 1), (None, 1, "view", 1)]
    df = spark.createDataFrame(rows, "owner int, item int, action string, ts int")
    assert sorted(map(tuple, R.recent_items(df, ["view", "click"], 2).collect())) == [(1, 5), (1, 6)]

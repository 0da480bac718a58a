"""The trie against one built node by node in a dictionary."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import conversation_trie as s


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, cs in members.items():
        for d in range(len(node) + 1):
            below[node[:d]][0] += node not in kids
            below[node[:d]][1] += (len(cs) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), kids.get(node, 0), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(rng):
    rows = []
    say = lambda n: rng.choice("abé") * n
    for c in [*range(40), 100, 101, 150, 199, 205, 207, -7, 300, *range(301, 330)]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9]) + (c == 300) * 7):
            rows.append((c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), say(rng.randint(0, 2)) or None))
    for c in (102, 103, 110, 120):  # long ones that part late
        rows += [(c, t, "user", f"turn {t}") for t in range(30 + c % 7)]
    rows += [(c, t, "user", f"turn {t}" if c < 410 or t < 9 else None) for c in range(400, 420) for t in range(10)]  # copies
    rows += [(5, 1, "user", "twice")] * 3 + [(None, 1, "user", "nobody"), (206, 0, "user", "alone")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "k") for r in rows], "conv_id long, turn long, role string, text string, place int, key string")


def nodes(spark, rows):
    return sorted((tuple(r) for r in s.trie(s.rebuilt(s.ordered(frame(spark, rows)))).collect()), key=str)


@pytest.mark.parametrize("width,rows", [(16, 20_000), (3, 15)])
def test_against_a_dictionary(spark, monkeypatch, width, rows):
    monkeypatch.setattr(s, "WIDTH", width)
    monkeypatch.setattr(s, "RANGE_ROWS", rows)
    data = table(random.Random(width))
    assert nodes(spark, data) == brute(data)


def test_turnless_and_empty(spark):
    assert nodes(spark, []) == []
    rows = [(c, 0, "user", "x") for c in range(1, 9) if zlib.crc32(str(c).encode()) % 6]  # all take their turns from an absent conversation
    assert nodes(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_long_text(spark):
    rows = [(c, t, "user", "word " * 100_000 + str(t)) for c in range(3) for t in range(4)]
    assert nodes(spark, rows) == brute(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in s.query(spark, sf_dir).collect()), key=str) == brute(rows)

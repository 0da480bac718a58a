"""Running compositions and the indicators on them against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import insight as I
from tidemark.operators import scan
from tidemark.operators import series as S

DAY = dt.date(2020, 1, 1)


def bars(spark, n, seed=0, symbols=("A", "B")):
    rng, rows = random.Random(seed), []
    for s in symbols:
        price = 100.0
        for i in range(n):
            price = max(1.0, price + rng.gauss(0, 2))
            high, low = price + rng.random() * 3, price - rng.random() * 3
            rows.append((s, DAY + dt.timedelta(days=i), price, high, low, price if rng.random() > 0.05 else None, rng.randint(0, 9) * 1.0))
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    return df.repartition(3), rows


def smooth(xs, n, k, seed):
    out, seen, v = [], [], None
    for x in xs:
        if x is not None:
            seen.append(x)
            if len(seen) == n:
                v = x if seed == "close" else sum(seen) / n
            elif len(seen) > n:
                v += k * (x - v)
        out.append(v)
    return out


def close(a, b):
    return a is b is None or (a is not None and b is not None and abs(a - b) < 1e-8 * max(1, abs(b)))


@pytest.mark.parametrize("block", [4, 256])
def test_means_against_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)  # 4: four levels
    df, rows = bars(spark, 90 if block == 4 else 600)
    for n, seed in ((5, "close"), (12, "sma"), (1, "close")):
        got = {(r.symbol, r.date): r.e for r in S.ema(df, n, "e", seed).collect()}
        for s in "AB":
            mine = [r for r in rows if r[0] == s]
            want = smooth([r[5] for r in mine], n, 2 / (n + 1), seed)
            assert all(close(got[s, r[1]], w if r[5] is not None else None) for r, w in zip(mine, want))


def test_atr_and_adx_against_loops(spark):
    df, rows = bars(spark, 300, 4, ("A",))
    df = df.withColumn("close", F.coalesce("close", "open"))
    x = [(r[3], r[4], r[5] if r[5] is not None else r[2]) for r in rows]
    tr = [None] + [max(h - lo, abs(h - p[2]), abs(lo - p[2])) for p, (h, lo, _) in zip(x, x[1:])]
    got = [r.atr for r in S.atr(df, 14).orderBy("date").collect()]
    assert all(map(close, got, smooth(tr, 14, 1 / 14, "sma")))
    n, p, m, t, dx, want = 14, 0.0, 0.0, 0.0, [], []
    for i, (h, lo, _) in enumerate(x):
        if i:
            up, down = h - x[i - 1][0], x[i - 1][1] - lo
            a, b = (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)
            p, m = (p + a, m + b) if i <= n else (p - p / n + a, m - m / n + b)
            t = t + tr[i] if i < n else (t + tr[i]) / n if i == n else (t * (n - 1) + tr[i]) / n
        plus, minus = (100 * p / t, 100 * m / t) if i >= n and t > 0 else (None, None)
        dx.append(100 * abs(plus - minus) / (plus + minus) if plus is not None and plus + minus > 0 else None)
        mean = [d for d in dx[-n:] if d is not None]
        want.append((plus, minus, sum(mean) / len(mean) if i >= 2 * n and mean else None))
    for r, w in zip(S.adx(df).orderBy("date").collect(), want):
        assert close(r.di_plus, w[0]) and close(r.di_minus, w[1]) and close(r.adx, w[2])


def test_nothing_and_one_bar(spark):
    df, _ = bars(spark, 1)
    assert S.ema(df.limit(0), 3).count() == 0
    assert [r.atr for r in S.atr(df).collect()] == [None, None]
    assert S.macd(df).columns == [*df.columns, "macd", "macd_signal", "macd_hist"]


@pytest.mark.parametrize("block", [3, 256])
def test_reweight_against_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    rng = random.Random(block)
    rows = [(k, i, rng.choice([1, 1, -1, 0, None])) for k in ("a", "b", None) for i in range(100)] + [("one", 0, 1)]
    want = {}
    for k, _, x in rows:
        want[k] = max(0.05, min(5.0, want.get(k, 1.0) + (0.3 if x and x > 0 else -0.2)))
    got = {r.entry: (r.n, r.weight) for r in I.reweight(spark.createDataFrame(rows, "entry string, seq int, rating int").repartition(5)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][1] - want[k]) < 1e-9 for k in want)
    assert got["a"][0] == 100 and got["one"][0] == 1


def test_memory_dedup_against_a_loop(spark):
    rng, base = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(u, base + dt.timedelta(hours=rng.randint(0, 200)), f"{'same start of a long note' if rng.random() < 0.7 else 'another note altogether'} {i % 3}") for u in (1, 2, None) for i in range(60)]
    rows += [(1, base, "short"), (1, None, "a text that has no time"), (1, base, None)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, text string")
    got = sorted(map(str, ((r.user_id, r.ts, r.text) for r in I.memory_dedup(df, hours=24, chars=10).collect())))
    last, want = {}, []
    for u, ts, text in sorted((r for r in rows if r[1] and r[2] and len(r[2]) >= 15), key=lambda r: (str(r[0]), r[1], r[2])):
        key = u, text[:10]
        if key not in last or ts > last[key] + dt.timedelta(hours=24):
            last[key] = ts
            want.append(str((u, ts, text)))
    assert got == sorted(want)

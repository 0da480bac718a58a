"""Near-duplicates against all pairs by exact weighted Jaccard."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidemark.llm import near_dedup as s


def weights(f, own):
    """Inverse document frequencies by counting every shingle."""
    seen = Counter(f.tolist())
    size = len(own) - 1
    held = sorted(seen)
    values = [1 + np.log(size / seen[x]) for x in held]
    return s.Idf(np.array(held, np.uint64), np.array(values), 0.0)


def brute(docs):
    """Classes of all pairs at or above the threshold, through shared shingles."""
    raw, holders = {}, defaultdict(list)
    f, bounds, _, _ = s.features(pa.array([t for _, t in docs], pa.string()))
    idf = weights(s.distinct_features(f, bounds)[0], bounds)
    f, n, own = s.distinct_features(f, bounds)
    for k in range(len(docs)):
        a, b = own[k], own[k + 1]
        raw[k] = f[a:b].tobytes() + (n[a:b] * idf.of(f[a:b])).tobytes()
        for x in f[a:b]:
            holders[x].append(k)
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    close = set()
    for a, b in pairs:
        if s.weighted_jaccard(raw[a], raw[b]) >= s.THRESHOLD:
            close.add((a, b))
            parent[top(b)] = top(a)
    low = {}
    for i in range(len(docs)):
        low[top(i)] = min(low.get(top(i), docs[i][0]), docs[i][0])
    return {docs[i][0]: low[top(i)] for i in range(len(docs))}


def test_table(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    want = brute(docs)
    got = {r.doc_id: r.class_id for r in s.query(spark, sf).collect()}
    assert len(got) == len(docs)
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong and len(set(want.values())) < len(want)


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w30 ", "other ")
    docs = [(4, base), (9, near), (2, base.upper()), (5, None), (6, ""), (7, "..."), (8, ""), (None, base), (1, "a b"), (3, "A, b!"), (10, "a b c"), (4, base)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, label int")
    got = sorted(((r.doc_id, r.class_id) for r in s.classes(df).collect()), key=str)
    want = [(4, 2), (4, 2), (9, 2), (2, 2), (5, 5), (6, 6), (7, 7), (8, 8), (None, None), (1, 1), (3, 1), (10, 10)]
    assert got == sorted(want, key=str)
    kept = s.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2, 5, 6, 7, 8, None, 1, 10]))
    assert s.classes(df.limit(0)).count() == 0


def test_draws_follow_weighted_jaccard():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    w, v = rng.random(40) * 4 + 0.1, rng.random(40) * 4 + 0.1
    v[:30] = w[:30]
    true = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    n = 2000
    sampler, bounds = s.Sampler(n), np.array([0, 40, 80])
    logs = np.log(np.r_[w, v]).astype(np.float32)
    hits = sum(len(set(sampler.sample(np.r_[keys, keys], logs, bounds, j).tolist())) == 1 for j in range(n))
    assert abs(hits / n - true) < 0.04


def test_inverse_frequencies(spark):
    texts = ["a b c d e f"] * 3 + ["a b c d e"] * 2 + ["x y"] + [None, ""] * 2
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for common in (0.1, 0.35):
        idf = s.inverse_frequencies(df, common)
        f, bounds, _, _ = s.features(pa.array(["a b c d e", "b c d e f", "x y", "new words"], pa.string()))
        want = [1 + np.log(1 / max(n / 10, common)) for n in (5, 3, 1, 0)]
        assert np.allclose(idf.of(f), want)


def test_without_a_floor_under_rare_shingles(spark):
    """Among 10,000 texts: pairs that a floor of COMMON under the share of holders would link or miss, without and with it."""
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"x{v}" for v in rng.integers(0, 1 << 40, 6))) for i in range(9_700)]
    common = " ".join(f"c{i}" for i in range(64))  # its shingles are in 9 documents
    for k in range(60):
        own = " ".join(f"o{k}x{i}" for i in range(60 + k))
        odd = " ".join(f"p{k}x{i}" for i in range(8 + k % 30))
        shared = own if k % 2 else f"{own} {common}"
        docs += [(20_000 + 5 * k, shared), (20_001 + 5 * k, f"{shared} {odd}")]
    docs += [(30_000 + i, f"{' '.join(f'y{i}x{j}' for j in range(9))} {common}") for i in range(9)]
    docs += [(40_000 + i, "") for i in range(10_000 - len(docs))]
    full = [d for d in docs if d[1]]
    f, bounds, _, _ = s.features(pa.array([t for _, t in docs], pa.string()))
    idf = weights(s.distinct_features(f, bounds)[0], bounds)
    f, n, own = s.distinct_features(f, bounds)
    assert len(docs) == 10_000 and len(full) < 10_000

    def similarity(a, b, values):
        raw = [f[own[k] : own[k + 1]].tobytes() + (n[own[k] : own[k + 1]] * values(f[own[k] : own[k + 1]])).tobytes() for k in (a, b)]
        return s.weighted_jaccard(*raw)

    place = {d[0]: k for k, d in enumerate(docs)}
    floor = 1 + np.log(1 / s.COMMON)
    want, floored = {}, {}
    for k in range(60):
        x, y = 20_000 + 5 * k, 20_001 + 5 * k
        for out, values in ((want, idf.of), (floored, lambda v: np.minimum(idf.of(v), floor))):
            out[y] = x if similarity(place[x], place[y], values) >= s.THRESHOLD else y
    assert want != floored and len(set(want.values())) > 20
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    for out, least in ((want, 0.0), (floored, s.COMMON)):
        got = {r.doc_id: r.class_id for r in s.classes(df, floor=least).collect()}
        assert {y: got[y] for y in out} == out

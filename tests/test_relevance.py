"""Who opens what, on planted rows; owners with too short or one-sided a history stay neutral."""

import random

import pytest

from tidemark.operators import ml as M

SAMPLE = "owner int, severity double, k int, label int"


def test_relevance(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for owner, n in ((1, 40), (2, 15), (3, 14), (4, 30), (None, 30)):
        for i in range(n):
            severity = rng.choice([2.0, 3.0, 8.0, 9.0])
            rows.append((owner, severity, rng.randrange(9), 1 if owner == 4 else int(severity > 5)))
    rows += [(1, None, 3, 0), (1, 9.0, 1, None)]
    asked = [(o, s, k) for o in (1, 2, 3, 4, 5, None) for s, k in ((9.0, 1), (2.0, None), (None, 4))]
    df = spark.createDataFrame(asked, "owner int, severity double, k int")
    samples = spark.createDataFrame(rows, SAMPLE)
    got = [tuple(r) for r in M.relevance(samples, df, "owner", ["severity", "k"], str(tmp_path / "model")).collect()]
    assert sorted(got, key=repr) == sorted([(o, s, k, pytest.approx(0.5 if o not in (1, 2) else float((s or 0) > 5))) for o, s, k in asked], key=lambda r: repr(r[:3]))
    none = M.relevance(samples.where("owner = 3"), df, "owner", ["severity", "k"], str(tmp_path / "none")).collect()
    assert len(none) == len(asked) and {r.p for r in none} == {0.5}

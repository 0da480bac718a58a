"""Models and components read what their passes share from a written table, not from its sources again."""

import datetime as dt

import pytest

from tidemark.operators import ml as M
from tidemark.operators import quant as Q
from tidemark.plans import catalog


@pytest.fixture
def read(spark):
    """Bars, and how often their rows were made."""
    n = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    day = dt.date(2020, 1, 1)
    rows = [(s, day + dt.timedelta(7 * i), *[100.0 + (i * 7 + j * 3) % 11 + j] * 4, 1000.0 + i) for j, s in enumerate("abc") for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    return df.mapInArrow(count, df.schema), n


def test_components(read):
    bars, n = read
    assert Q.principal_components(bars, 2).count() == 89
    assert n.value == 270


def test_direction(spark, read, monkeypatch):
    bars, n = read
    catalog.load()
    from tidemark.plans import stream_q

    monkeypatch.setattr(stream_q.V, "bars", lambda *_: bars)
    assert stream_q.direction(spark, "").count() == 90 and n.value == 270
    M.train_direction(M.features(bars), trees=2)
    assert n.value <= 270 + 3 * 270  # once for the rows and once for each symbol's end

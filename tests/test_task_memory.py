"""What a task holds follows a fixed number of rows or days, not the table."""

import datetime as dt

from tidemark.operators import impacts as I
from tidemark.operators import series as S
from tidemark.sources import views as V

SMALL = "/root/testdata/sf0.001"


def test_lines_are_dealt_into_more_tasks(spark):
    line, orders = (V.table(spark, SMALL, t) for t in ("lineitem", "orders"))
    out = V.with_orders(line, orders, rows=500)
    assert out.rdd.getNumPartitions() == line.count() // 500
    assert out.count() == line.join(orders, line.l_orderkey == orders.o_orderkey).count()


def bars_and_events(spark):
    day = dt.date(2024, 1, 1)
    bars = [("a", day + dt.timedelta(7 * i), 100.0 + i % 3) for i in range(20)]
    events = [(k, "a", day + dt.timedelta(k % 150), "x", 6.0 + k % 4, 1.0) for k in range(600)] + [(900, "b", day, "x", 9.0, 1.0)]
    return spark.createDataFrame(bars, "symbol string, date date, close double"), spark.createDataFrame(events, "key int, symbol string, on date, category string, severity double, relevance double")


def test_days_meet_bars_once(spark):
    bars, events = bars_and_events(spark)
    seen = []
    plain = S.forward_as_of
    S.forward_as_of = lambda left, *a: seen.append(left.count()) or plain(left, *a)
    try:
        rows = {r.key: r for r in S.reaction(bars, events, "key").collect()}
    finally:
        S.forward_as_of = plain
    assert seen == [151]  # 600 events of a on 150 days, one of b
    assert set(rows) == {k for k in range(600) if k % 150 <= 7 * 19}
    assert all((r.date - r.on).days in range(7) and r.date.weekday() == 0 for r in rows.values())


def test_overlay_keeps_the_most_relevant(spark):
    bars, events = bars_and_events(spark)
    rows = sorted(I.overlay(events, bars, "key", most=5).collect(), key=lambda r: r.place)
    assert [r.key for r in rows] == [3, 7, 11, 15, 19] and all(r.r1 is not None for r in rows)

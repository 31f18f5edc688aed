import random

import pytest

from boskage.operators.intervals import merge_days, periods_and_gaps, periods_by_window


def brute(rows):
    covered, found = {}, []
    for e, s, t in rows:
        if None not in (e, s, t) and t >= s:
            covered.setdefault(e, set()).update(range(s, t + 1))
    for e, days in covered.items():
        days = sorted(days)
        first = last = days[0]
        for day in [*days[1:], None]:
            if day is None or day != last + 1:
                found.append((e, "period", first, last))
                if day is not None:
                    found.append((e, "gap", last + 1, day - 1))
                first = day
            last = day
    return sorted(found)


@pytest.mark.parametrize(("seed", "n", "parts"), [(1, 0, 4), (2, 1, 4), (3, 600, 40), (4, 3000, 7), (5, 3000, 1)])
def test_against_covered_days(spark, seed, n, parts):
    rng = random.Random(seed)
    rows = [(rng.choice([1] * 6 + list(range(2, 9))), s := rng.randrange(2500), s + int(rng.expovariate(0.3))) for _ in range(n)]
    rows += rows[: n // 10] + [(1, 5, 3), (None, 1, 2), (3, None, 2), (3, 1, None)]
    df = spark.createDataFrame(rows, "e long, s int, t int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, merge_days(df, "e", "s", "t").collect())) == brute(rows)
        window = sorted(map(tuple, periods_by_window(df, "e", "s", "t").collect()))
        assert window == [(e, a, b) for e, kind, a, b in brute(rows) if kind == "period"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_day_texts(spark):
    rows = [
        (1, "2020-01-01", "2020-01-05"), (1, "2020-01-06", "2020-01-07"), (1, "2020-02-01", "2020-02-01"),
        (2, "2020-01-01", "2020-01-02"), (3, "2020-02-30", "2020-03-01"), (3, "2020-3-1", "2020-03-02"),
        (3, "2020-01-02", "2020-01-01"), (None, "2020-01-01", "2020-01-02"), (4, None, "2020-01-02"),
        (5, "2020-01-01", "2020-01-01"), (5, "2020-01-01", "2020-01-01"), (6, " 2020-01-01", "2020-01-01"), (6, "0000-01-01", "2020-01-01"),
    ]
    df = spark.createDataFrame(rows, "g long, a string, b string").selectExpr("g", "a", "b", "1 as kind", "2 as first_day")
    assert sorted(map(tuple, periods_and_gaps(df, "g", "a", "b").collect())) == [
        (1, "gap", "2020-01-08", "2020-01-31"), (1, "period", "2020-01-01", "2020-01-07"), (1, "period", "2020-02-01", "2020-02-01"),
        (5, "period", "2020-01-01", "2020-01-01"),
    ]

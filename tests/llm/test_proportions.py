import random
from collections import Counter
from datetime import datetime, timedelta
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from boskage.llm.proportions import allocate, class_margins, controlled_rounding, draw, report, second_margins, units


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=3, max_size=3), min_size=1, max_size=6), st.data())
def test_controlled_rounding_keeps_both_margins(counts, data):
    rows = [data.draw(st.integers(0, sum(c))) for c in counts]
    cells = [[Fraction(q * k, sum(c)) if sum(c) else Fraction(0) for k in c] for c, q in zip(counts, rows)]
    got = controlled_rounding(cells, rows)
    for i, row in enumerate(got):
        assert sum(row) == rows[i]
        for j, k in enumerate(row):
            assert cells[i][j].__floor__() <= k <= cells[i][j].__ceil__() and k <= counts[i][j]
    for j in range(3):
        whole = sum((c[j] for c in cells), Fraction(0))
        assert whole.__floor__() <= sum(r[j] for r in got) <= whole.__ceil__()


ROW = "row_id long, record_id long, dataset string, class string, feed_id int, loaded_at timestamp_ntz, quota int, g int"
TARGET = "plan_id int, dataset string, sample_size long, class string, target_permille int, min_keep int"


def rows(n, seed=1):
    rng, t = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for i in range(n):
        record = rng.randrange(int(n * 0.9))
        spelled = rng.choice(["Clear-cut", " clear_cut", "CLEAR CUT "] * 10 + ["Fire", "fire ", "Storm", None, "None"])
        out.append((i, record if i % 50 else None, rng.choice([" HM", "hm", "Hm "]), spelled, rng.choice([1, 1, 1, 2, 3, None]), t + timedelta(days=i % 7), 1, 2))
    return out


def test_sample(spark):
    data = rows(3000)
    targets = [(1, "hm", 100, "clear-cut", 700, 1), (1, "hm", 100, "Fire", 255, 0), (1, "hm", 100, "storm", 1, 5), (1, "hm", 100, "Absent", 44, 2),
               (2, "HM ", 100000, "Fire", 500, 0), (2, "HM ", 10, None, 500, 1), (3, "gone", 10, "Fire", 1000, 0), (4, "hm", 0, "Fire", 1000, 0)]
    sampled = units(spark.createDataFrame(data, ROW), "record_id", "dataset", "class", "feed_id", "loaded_at", "row_id")
    wanted = spark.createDataFrame(targets, TARGET)
    allocation = allocate(sampled, wanted).cache()
    got = {(r.plan_id, r["class"]): (r.quota, r.available, r.allocated) for r in report(allocation).collect()}
    key = lambda c: c and c.strip().lower().replace(" ", "-").replace("_", "-")
    there = {c: len({r[1] for r in data if r[1] is not None and key(r[3]) == c}) for c in ("clear-cut", "fire", "storm")}
    assert got[1, "clear-cut"] == (70, there["clear-cut"], 70)
    assert got[1, "Fire"] == (26, there["fire"], 26)
    assert got[1, "storm"] == (5, there["storm"], 5)
    assert got[1, "Absent"] == (5, 0, 0)
    assert got[2, "Fire"] == (50000, there["fire"], there["fire"])
    assert got[2, None] == (5, 0, 0) and got[3, "Fire"] == (10, 0, 0) and got[4, "Fire"] == (0, there["fire"], 0)
    drawn = draw(sampled, allocation).collect()
    assert len({(r.plan_id, r.c, r.u) for r in drawn}) == len(drawn)
    assert Counter((r.plan_id, r.c) for r in drawn) == {(1, "clear-cut"): 70, (1, "fire"): 26, (1, "storm"): 5, (2, "fire"): there["fire"]}
    # the second margin follows what is there
    stratum = Counter(r.s for r in drawn if (r.plan_id, r.c) == (1, "clear-cut"))
    cells = Counter(r.s for r in sampled.where("c = 'clear-cut'").collect())
    assert all(abs(stratum[s] - 70 * n / there["clear-cut"]) < 1 for s, n in cells.items())
    for size in (1, 50, 10**9):
        assert sorted(map(tuple, draw(sampled, allocation, bucket_units=size).collect()), key=str) == sorted(map(tuple, drawn), key=str)
    again = draw(sampled, allocation)
    assert {(r.plan_id, r["class"]): r.drawn for r in class_margins(again).collect()} == Counter((r.plan_id, r.c) for r in drawn)
    assert all(r.held for r in second_margins(again, allocation).collect())


def test_repeated_targets_are_reported_one_by_one(spark):
    df = spark.range(5).selectExpr("id row_id", "id record_id", "'hm' dataset", "'Fire' `class`", "1 feed_id", "timestamp_ntz'2024-01-01' loaded_at")
    sampled = units(df, "record_id", "dataset", "class", "feed_id", "loaded_at", "row_id")
    targets = spark.createDataFrame([(1, "hm", 10, "Fire", 1000, 0), (1, "hm", 10, "Fire", 1000, 0), (1, "hm", 10, "fire", 300, 0)], TARGET)
    allocation = allocate(sampled, targets)
    assert sorted(tuple(r) for r in report(allocation).collect()) == [(1, "Fire", 10, 5, 5), (1, "Fire", 10, 5, 5), (1, "fire", 3, 5, 3)]
    assert draw(sampled, allocation).count() == 5


def test_a_hot_cell_is_drawn_exactly(spark):
    base = datetime(2024, 1, 1)
    df = spark.range(30000).selectExpr("id row_id", "id record_id", "'hm' dataset", "'Fire' `class`", "1 feed_id", f"timestamp_ntz'{base}' loaded_at")
    sampled = units(df, "record_id", "dataset", "class", "feed_id", "loaded_at", "row_id")
    targets = spark.createDataFrame([(1, "hm", 12345, "fire", 1000, 0)], TARGET)
    drawn = draw(sampled, allocate(sampled, targets))
    assert drawn.count() == drawn.select("u").distinct().count() == 12345


def test_empty(spark):
    sampled = units(spark.createDataFrame([], ROW), "record_id", "dataset", "class", "feed_id", "loaded_at", "row_id")
    targets = spark.createDataFrame([(1, "hm", 10, "Fire", 1000, 0)], TARGET)
    assert [tuple(r) for r in report(allocate(sampled, targets)).collect()] == [(1, "Fire", 10, 0, 0)]
    assert draw(sampled, allocate(sampled, targets)).count() == 0
    assert report(allocate(sampled, targets.limit(0))).count() == 0

"""The sweep within bands against the walk over all candidate pairs."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import config as C
from ledgerloom.operators import deterministic, sweep

LEDGER = "id string, vn string, amount double, date date, entity string, currency string, ord int"


def walk(edges):
    """The sequential rule over (go, so, a, b)."""
    used, out = set(), set()
    for _, _, a, b in sorted(edges):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.add((a, b))
    return out


def sides(spark, seed, n=70, odd=True):
    r = random.Random(seed)
    day = date(2024, 1, 1)

    def rows(name):
        order = r.sample(range(n), n)
        return [(f"{name}{i}", r.choice(["a", "b", None] if odd else ["a"]), r.choice([10.0, 10.004, 20.0, 21.0, 0.0, -5.0, *([None] if odd else [])]), r.choice([None, *[day + timedelta(r.randint(0, 300)) for _ in range(9)]]) if odd else day + timedelta(r.randint(0, 40)), r.choice(["X", None]) if odd else "X", "USD", order[i]) for i in range(n)]

    return spark.createDataFrame(rows("G"), LEDGER), spark.createDataFrame(rows("S"), LEDGER)


@pytest.mark.parametrize("seed", range(4))
def test_banded_is_the_walk(spark, seed):
    g, s = sides(spark, seed)
    for days in (0, 30):
        want = walk([(r.go, r.so, r.a, r.b) for r in deterministic.banded(g, s, days).collect()])
        got = [tuple(r) for r in deterministic.scenario_banded(g, s, days).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (want or days == 0)


@pytest.mark.parametrize("scenario", [
    C.Scenario(("vendor", "amount"), amount_pct=0.05), C.Scenario(("entity", "amount", "date"), date_days=45, amount_abs=1.0, amount_pct=0.05), C.Scenario(("vendor", "date"), date_days=20),
    C.Scenario(("vendor", "amount", "date")), C.Scenario(("amount",), amount_abs=5.0), C.Scenario(("currency",)),
])
def test_dynamic_is_the_walk(spark, scenario):
    for seed in (11, 12):
        g, s = sides(spark, seed, 40, odd=seed == 11)
        want = walk([(r.go, r.so, r.a, r.b) for r in deterministic.dynamic_candidates(g, s, scenario).collect()])
        assert {tuple(r) for r in deterministic.scenario_dynamic(g, s, scenario).collect()} == want


def test_stretches_are_cut_at_gaps(spark):
    rows = spark.createDataFrame([("a", d) for d in (0, 0, 30, 61, 92, 400)] + [("b", 31), (None, 5), (None, 36)], "k string, day long")
    got = {(r.k, r.day): r.stretch for r in sweep.stretches(rows, ["k"], 30).collect()}
    assert got == {("a", 0): 0, ("a", 30): 0, ("a", 61): 1, ("a", 92): 2, ("a", 400): 3, ("b", 31): 0, (None, 5): 0, (None, 36): 1}


def test_one_key_with_very_many_rows(spark):
    """100,000 rows of one key on each side, most of them on the same day: ten thousand million pairs that are never formed."""
    n = 100_000
    side = lambda name, shift: spark.range(n).select(F.concat(F.lit(name), "id").alias("id"), F.lit("a").alias("vn"), F.lit(5.0).alias("amount"), F.when(F.col("id") % 3 == 0, F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 20).cast("int") + shift)).otherwise(F.lit(date(2024, 1, 5))).alias("date"), F.lit("X").alias("entity"), F.lit("USD").alias("currency"), F.col("id").cast("int").alias("ord"))
    got = deterministic.scenario_banded(side("G", 0), side("S", 25), 30).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got) > 0.9 * n


def test_free_rows_against_a_plain_list():
    r = random.Random(4)
    bands = sweep.Bands(7, 2.0, 0.1)
    for _ in range(20):
        n = r.randint(1, 120)
        right = [(float(r.randint(-30, 30)), r.randint(0, 60), k) for k in r.sample(range(n), n)]
        free = sweep.Free(*(np.array(c) for c in zip(*right)), bands)
        alive = set(range(n))
        for _ in range(150):
            amount, day = float(r.randint(-30, 30)), r.randint(0, 60)
            fit = [i for i in alive if abs(right[i][1] - day) <= 7 and (abs(amount - right[i][0]) <= 2 or abs(amount - right[i][0]) / max(abs(amount), 1e-9) <= 0.1)]
            want = min(fit, key=lambda i: right[i][2], default=None)
            assert free.take(amount, day) == want
            alive.discard(want)


def test_single_pairs_are_compared_without_a_walk(spark, monkeypatch):
    side = np.array([0, 1, 0, 1, 1, 0, 0, 1])
    day, amount = np.array([0, 30, 0, 31, 30, 5, 6, 7]), np.array([1.0] * 8)
    monkeypatch.setattr(sweep, "walked", None)  # trees for stretches of a row or two took most of the time
    a, b = sweep.matched(side, amount, day, np.array([0, 2, 5]), sweep.Bands(30))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (2, 4), (5, 7)]


def test_zeros_of_both_signs_and_keys_that_are_no_numbers_meet(spark):
    schema = "k double, e string, id string, ord long, amount double, day long"
    nan = float("nan")
    left = spark.createDataFrame([(0.0, None, "a", 1, 1.0, 1), (nan, "x", "b", 2, 1.0, 1), (None, "", "c", 3, 1.0, 1), (1.0, None, "d", 4, 1.0, 1)], schema)
    right = spark.createDataFrame([(-0.0, None, "A", 1, 1.0, 9), (nan, "x", "B", 2, 1.0, 9), (None, "", "C", 3, 1.0, 9), (1.0, "", "D", 4, 1.0, 9)], schema)
    for batch in ("10000", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = sweep.assigned(left, right, ["k", "e"], sweep.Bands(30)).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r.a, r.b) for r in found) == [("a", "A"), ("b", "B"), ("c", "C")]

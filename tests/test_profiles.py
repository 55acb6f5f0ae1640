"""Numeric column profiles of large and odd amounts, against Python's statistics."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from ledgerloom.operators import consolidate, profile


def test_amounts_that_are_large_and_close(spark):
    r = random.Random(4)
    big = [1e12 + r.randint(0, 400) / 100 for _ in range(999)]
    wide = [r.choice([-1, 1]) * 10.0 ** r.randint(-9, 15) for _ in range(500)] + [7.0] * 499
    rows = [(b, w, None, 5.0 if i == 0 else None, i % 2) for i, (b, w) in enumerate(zip(big, wide))]
    df = spark.createDataFrame(rows, "big double, wide double, none double, one double, k int").withColumn("label", F.lit("x"))
    got = {x.column_name: x for x in profile.column_profiles(df).collect()}
    assert got["big"].median == round(statistics.median(big), 4) and abs(got["big"].std - statistics.stdev(big)) < 1e-3
    assert got["wide"].median == round(statistics.median(wide), 4)
    assert (got["one"].median, got["one"].std, got["one"].histogram) == (5.0, 0.0, None)
    assert got["none"].median is None and got["none"].null_count == 999 and got["label"].median is None
    assert got["k"].histogram == "500|0|0|0|0|0|0|499" and got["k"].sum == 499.0 and got["k"].median == 0.0
    assert profile.column_profiles(df.limit(0)).count() == 0


def test_an_id_of_two_scenarios_counts_once_in_the_whole(spark):
    m = spark.createDataFrame([("M1", "deterministic", ["G1"], "auto", 1), ("M2", "deterministic", ["G1", "G2"], "auto", 2), ("M3", "ai", ["G3"], "auto", None)], "match_id string, layer string, a array<string>, status string, scenario_id int")
    gl = spark.createDataFrame([("G1", 5.0), ("G2", 7.0), ("G3", 9.0)], "id string, amount double")
    assert {(r.scenario_id, r.amount) for r in consolidate.scenario_amounts(m, gl).collect()} == {(1, 5.0), (2, 12.0), (None, 12.0)}

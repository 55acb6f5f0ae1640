"""Suggestions read each side once."""

from __future__ import annotations

import json
from datetime import date

from ledgerloom.operators import advisor


def test_sides_are_not_read_again_for_features(spark, tmp_path):
    columns = "id string, entity string, vn string, date date, amount double"
    d = date(2024, 1, 1)
    spark.createDataFrame([("G1", "X", "acme", d, -60.0), ("G2", "X", "acme", d, 40.0), ("G3", "Y", "acme", d, 1.0)], columns).write.parquet(f"{tmp_path}/g")
    spark.createDataFrame([("S1", "X", "acme", d, 100.0), ("S2", "X", "acme", d, 7.0)], columns).write.parquet(f"{tmp_path}/s")
    answer = json.dumps({"matches": [{"gl_ids": ["G1", "G2"], "sub_ids": ["S1"], "confidence": 0.9, "reasoning": "one"}, {"gl_ids": ["G3"], "sub_ids": ["S2"], "confidence": 0.9, "reasoning": "of another group"}]})
    answered = spark.createDataFrame([("X", "acme", answer)], "entity string, vn string, answer string")
    got = advisor.suggestions(answered, spark.read.parquet(f"{tmp_path}/g"), spark.read.parquet(f"{tmp_path}/s"))
    assert "parquet" not in got._jdf.queryExecution().executedPlan().toString().lower()
    assert [(r.reasoning, r.materiality, r.amount_difference) for r in got.collect()] == [("one", 100.0, 120.0)]

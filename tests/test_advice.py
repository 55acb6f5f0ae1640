"""What an advisor may set up: roles, scenarios, chat changes; answers that make no sense change nothing."""

from __future__ import annotations

import json

import pytest

from ledgerloom.config import MatchingConfig
from ledgerloom.operators import advice
from ledgerloom.sources import ledger


@pytest.fixture(scope="module")
def both(spark, data):
    return ledger.gl(spark, data), ledger.sub(spark, data)


def test_column_roles(both):
    seen = []
    said = {"roles": {"gl_id": "id", "vendor_name": "vendor", "amount": "amount", "account_code": "amount", "entity": "entity", "currency": "nonsense", "not there": "date"}}

    def advisor(payload):
        seen.append(json.loads(payload))
        return "```json\n" + json.dumps(said) + "\n```"

    roles = advice.column_roles(both[0], advisor)
    assert roles == {c: {"gl_id": "id", "vendor_name": "vendor", "account_code": "amount", "entity": "entity"}.get(c, "ignore") for c in both[0].columns if c != "ord"}
    assert {c["column_name"] for c in seen[0]["columns"]} == set(roles)


@pytest.mark.parametrize("answer", ["", "[]", "not json", '{"scenarios": 3}', '{"scenarios": [{"match_fields": []}, 4]}', '{"weights": {"vendor": 2}, "threshold": "x"}'])
def test_defaults_hold(both, answer):
    assert advice.matching_config(*both, lambda p: answer) == MatchingConfig()
    assert set(advice.column_roles(both[0], lambda p: answer).values()) == {"ignore"}


def test_matching_config_and_chat(both):
    said = {"scenarios": [{"match_fields": ["date", "entity"], "date_days": 10, "description": "near", "amount_pct": True}], "threshold": 0.9}
    config = advice.matching_config(*both, lambda p: json.dumps(said))
    assert config.scenarios[0].match_fields == ("vendor", "amount", "date", "entity") and config.scenarios[0].date_days == 10
    assert config.scenarios[0].amount_pct is None and config.threshold == 0.9
    seen = []

    def advisor(payload):
        seen.append(json.loads(payload))
        return json.dumps({"reply": "done", "config_update": {"scenarios": [{"match_fields": ["currency"]}]}})

    reply, after = advice.chat("only by currency", *both, config, advisor)
    assert reply == "done" and after.scenarios[0].match_fields == ("vendor", "amount", "currency") and after.threshold == 0.9
    assert len(seen[0]["gl"]["rows"]) and seen[0]["gl"]["facts"]["top_vendors"].count("|") == 14
    assert advice.chat("hello", *both, config, lambda p: 1 / 0) == ("", config)


def vendors_of(spark, names):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "original string, o int").withColumn("norm", F.lower("original"))


def test_pages_of_vendors(spark, tmp_path):
    """Payloads are bounded, the nearest vendors come first, and each vendor of the subledger is reached by those that need it."""
    import os

    from ledgerloom.operators import advisor

    theirs = [f"Trader {i:03d} Ltd" for i in range(23)] + ["Delta Freight", "Delta Freights", "Far Off"]
    seen = str(tmp_path)
    wanted = {"Delta Freighters": ("Delta Freights", 0.9), "Nobody Alike": ("Far Off", 0.8), "Torn": ("Trader 001 Ltd", 0.75), "Never": ("Not listed", 1.0)}

    def answer(payload):
        asked = json.loads(payload)
        with open(os.path.join(seen, f"{asked['vendor']}-{abs(hash(payload))}"), "w") as f:
            f.write(payload)
        name, sure = wanted[asked["vendor"]]
        if asked["vendor"] == "Torn" and "Trader 020 Ltd" in asked["candidates"]:
            return '{"matched_vendor": "Trader 020 Ltd", "confidence": 0.7}'
        return json.dumps({"matched_vendor": name, "confidence": sure})

    said = advisor.vendor_advice(vendors_of(spark, list(wanted)), vendors_of(spark, theirs), answer, most=5).collect()
    assert {r.original: (r.matched_to, r.confidence) for r in said} == {k: v for k, v in wanted.items() if k != "Never"}
    asked = [json.loads((tmp_path / f).read_text()) for f in os.listdir(seen)]
    assert max(len(p["candidates"]) for p in asked) == 5
    of = lambda v: [p["candidates"] for p in asked if p["vendor"] == v]
    assert of("Delta Freighters") == [["Delta Freights", "Delta Freight"]]  # settled by its nearest ones
    assert sorted(c for page in of("Never") for c in page) == sorted(theirs)
    assert advisor.vendor_advice(vendors_of(spark, ["A"]), vendors_of(spark, theirs).where("false"), answer).count() == 0

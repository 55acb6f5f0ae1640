"""The whole run from advised settings to the exported folder."""

from __future__ import annotations

import csv
import json
import zipfile

import pytest
from test_rules import p4, reject_all, stub

from ledgerloom.config import ColumnMap
from ledgerloom.plans import exports
from ledgerloom.plans.session import TransitionError, reconcile


def table(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def test_export_of_a_whole_run(spark, tmp_path):
    run = reconcile(spark, *p4(spark), advise=stub())
    folder = str(tmp_path / "export")
    with pytest.raises(TransitionError):
        exports.download(run, run.frames["matches"], folder, ["audit_log.csv"], str(tmp_path / "x.zip"))
    links = spark.createDataFrame([("GL004", [" SUB004 ", "SUB9", " "])], "gl_id string, sub_ids array<string>")
    listed = exports.write(run, folder, "S1", overrides=links)
    assert run.state == "finalized"
    assert {r.filename for r in listed.collect()} == {*exports.FILES, exports.CRITERIA, exports.REPORT}
    assert [r["gl_id"] for r in table(f"{folder}/uploaded_gl.csv")] == ["GL001", "GL002", "GL003", "GL004"]
    final = table(f"{folder}/final_results.csv")
    assert [r["match_id"] for r in final] == sorted(r["match_id"] for r in final)
    assert sorted((r["source_layer"], r["gl_gl_id"], r["sub_subledger_id"], r["grouping_type"], r["confidence"]) for r in final if r["source_layer"] in ("deterministic", "manual")) == [
        ("deterministic", "GL001", "SUB001", "one_to_one", "1.0"), ("deterministic", "GL002", "SUB002", "one_to_one", "0.9"), ("manual", "GL004", "", "one_to_many", "1.0"), ("manual", "GL004", "SUB004", "one_to_many", "1.0"),
    ]
    audit = table(f"{folder}/audit_log.csv")
    assert sorted((r["source_layer"], r["record_ids_A"]) for r in audit) == [("ai", "GL004"), ("deterministic", "GL001"), ("deterministic", "GL002"), ("probabilistic", "GL003")]
    assert table(f"{folder}/residual_unmatched_gl.csv") == [] and (tmp_path / "export" / "residual_unmatched_gl.csv").read_text().startswith("gl_id,")
    assert [r["step_name"] for r in table(f"{folder}/process_log_steps.csv")] == ["preprocessing", "deterministic", "probabilistic", "ai"]
    assert json.loads((tmp_path / "export" / exports.CRITERIA).read_text())["threshold"] == 0.8
    assert "class='card'" in (tmp_path / "export" / exports.REPORT).read_text()
    exports.download(run, listed, folder, ["audit_log.csv", exports.REPORT], str(tmp_path / "x.zip"))
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.testzip() is None and z.namelist() == ["audit_log.csv", exports.REPORT]
    with pytest.raises(TransitionError):
        exports.write(run, folder, "S1")


def test_export_of_rejections(spark, tmp_path):
    run = reconcile(spark, *p4(spark), decide=reject_all, advise=stub(), decide_advised=reject_all)
    refused = run.frames["matches"].where("a[0] = 'GL001'").select("match_id", "a", "b")
    exports.write(run, str(tmp_path), "S1", refused=refused)
    assert [r["gl_id"] for r in table(tmp_path / "residual_unmatched_gl.csv")] == ["GL001", "GL003", "GL004"]
    assert [r["subledger_id"] for r in table(tmp_path / "residual_unmatched_sub.csv")] == ["SUB001", "SUB003", "SUB004"]
    assert sorted((r["gl_gl_id"], r["user_status"]) for r in table(tmp_path / "rejected_matches.csv")) == [("GL001", "ui_rejected"), ("GL003", "rejected"), ("GL004", "rejected")]
    assert table(tmp_path / "probabilistic_matches.csv") == []


def test_set_up_by_an_advisor(spark):
    g, b = p4(spark)
    g = g.withColumnsRenamed({"gl_id": "no", "vendor_name": "who", "amount": "sum", "transaction_date": "day", "entity": "firm"})

    def advisor(payload):
        said = json.loads(payload)
        if "columns" in said:
            names = {c["column_name"] for c in said["columns"]}
            roles = {"no": "id", "who": "vendor", "sum": "amount", "day": "date", "firm": "entity"} if "no" in names else {"subledger_id": "id", "vendor_name": "vendor"}
            return json.dumps({"roles": roles})
        assert said["gl"]["rows"] == said["sub"]["rows"] == 4 and said["gl"]["amount_max"] == 1000.0
        return json.dumps({"scenarios": [{"match_fields": ["entity"]}], "threshold": 0.99})

    run = reconcile(spark, g, b, set_up=advisor)
    assert run.columns == (ColumnMap("no", "who", "sum", "day", "firm", None), ColumnMap("subledger_id"))  # amount is open on the other side: its default
    assert run.config.threshold == 0.99 and [s.match_fields for s in run.config.scenarios] == [("vendor", "amount", "entity")]
    assert sorted(r.a[0] for r in run.frames["deterministic"].collect()) == ["GL001", "GL002"]
    with pytest.raises(ValueError, match="gl: column gl_id of role id does not exist"):
        reconcile(spark, g, b)

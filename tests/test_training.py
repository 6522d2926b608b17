import json

import pytest
from veilspark.__main__ import main
from veilspark.operators import severity as S
from veilspark.operators.training import training_table
from veilspark.plans.improve import calibration, cycle, cycle_report, evaluate, subset
from veilspark.plans.pipeline import RedactionPipeline
from veilspark.plans.queries import found_rows

ROWS = "row_id int, text string, span_start double, span_end double, span_text string, pii_type string, severity_label string, confidence double, sources array<string>"
LABELLED = "text string, spans array<struct<pii_type:string,start:int,end:int>>"


def test_training_table(spark):
    text = "My account number is 12345678 and mail a@b.org now"
    rows = [
        (1, text, 21.0, 29.0, "12345678", "BANK_ACCOUNT", "HIGH", None, None), (2, text, None, None, "a@b.org", "EMAIL", "0.3", 0.5, ["ner"]), (3, "call 12345678901 please", None, None, "gone", "PHONE", "critical", None, None),
        (4, "nothing here", None, None, "gone", "PHONE", "LOW", None, None), (5, "odd words", 0.0, 3.0, "odd", "JOB_TITLE", "LOW", 0.4, ["ner"]), (6, None, 0.0, 1.0, "x", "A", "LOW", None, None),
    ]
    got = {r.row_id: (r.label, dict(zip(S.FEATURES, r.features))) for r in training_table(spark.createDataFrame(rows, ROWS)).collect()}
    assert sorted(got) == [1, 2, 3, 5] and [got[i][0] for i in (1, 2, 3, 5)] == ["HIGH", "MEDIUM", "VERY_HIGH", "LOW"]
    assert got[1][1]["source_regex"] == 1 and got[1][1]["source_domain_heuristics"] == 1 and got[1][1]["neighbor_span_count"] == 1 and got[2][1]["neighbor_high_risk_count"] == 1
    assert got[2][1]["source_ner"] == 0 and got[5][1]["ner_score"] == 0.4 and got[5][1]["num_detectors"] == 1
    plain = {r.row_id: dict(zip(S.FEATURES, r.features)) for r in training_table(spark.createDataFrame(rows, ROWS), augment=False).collect()}
    assert plain[2]["source_ner"] == 1 and plain[2]["confidence"] == 0.5


def test_cycle(spark):
    labelled = spark.createDataFrame([("mail a@b.org", [("EMAIL", 5, 12)]), ("mail c@d.org", [("EMAIL", 5, 12)]), (None, None)], LABELLED)
    assert evaluate(labelled)["f1"] == 1.0
    stats = S.feature_stats(S.add_features(RedactionPipeline().spans(labelled)).selectExpr("explode_outer(features) features").where("features is not null"))
    out = cycle(labelled, RedactionPipeline(), RedactionPipeline(detectors={}), stats)
    assert not out["promoted"] and out["max_drift"] == pytest.approx(0) and not out["retrain"] and "promoted: False" in cycle_report(out)
    best = calibration(labelled.where("text is not null"), lambda d: found_rows(d, "email_standard").selectExpr("*", "'regex' detector_name")).first()
    assert (best.pii_type, best.f1) == ("EMAIL", 1.0) and subset(labelled, 1, "text").count() == 1


def test_command_line(spark, tmp_path, capsys):
    assert main(["redact", "--text", "mail a@b.org"], spark) == 0 and capsys.readouterr().out.strip() == "mail <CONTACT>"
    main(["json", "--text", "mail a@b.org"], spark)
    assert json.loads(capsys.readouterr().out)["decision"] == "PROCESS"
    (tmp_path / "l.jsonl").write_text('{"text": "mail a@b.org", "spans": [{"pii_type": "EMAIL", "start": 5, "end": 12}]}\n')
    main(["evaluate", "--input", str(tmp_path / "l.jsonl"), "--output", str(tmp_path / "r")], spark)
    assert json.loads((tmp_path / "r.json").read_text())["tp"] == 1
    with pytest.raises(SystemExit):
        main(["redact", "--text", "a", "--input", "b"], spark)

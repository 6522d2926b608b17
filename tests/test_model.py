"""Severity models from files, embeddings in the features, isolation of failures, settings and commands."""

import json
import pickle
import warnings

import numpy as np
import pytest
from veilspark.__main__ import main
from veilspark.functions.rules import LABELS
from veilspark.operators import detect as D
from veilspark.operators import model as M
from veilspark.operators import severity as S
from veilspark.operators.fusion import fuse
from veilspark.plans import improve
from veilspark.plans.pipeline import RedactionPipeline, run_pipeline
from veilspark.sources.encoders import Encoder, model_folder
from veilspark.sources.readers import Settings


class Plain:
    """A classifier without names of features."""

    def __init__(self, classes=LABELS, names=None, n=None):
        self.classes_ = list(classes)
        if names is not None:
            self.feature_names_in_ = names
        if n is not None:
            self.n_features_in_ = n

    def predict_proba(self, x):
        return np.tile(np.arange(1, len(self.classes_) + 1) / sum(range(1, len(self.classes_) + 1)), (len(x), 1))


def test_no_model(spark, tmp_path):
    with pytest.warns(UserWarning):
        model = M.load_model(str(tmp_path / "none.pkl"))
    r = S.add_model_severity(fuse(D.detect(spark.createDataFrame([(0, "mail a@b.org")], "doc_id long, text string"))), model).first()
    assert [(s.severity_score, s.severity_label, s.severity_probs) for s in r.spans] == [(0.0, "LOW", {"LOW": 1.0})]


def test_load_and_check(tmp_path):
    path = tmp_path / "m.pkl"
    path.write_bytes(pickle.dumps(Plain()))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert M.load_model(str(path)).classes_ == list(LABELS)
    for bad in (Plain(("A", "B")), Plain(names=["x"] * 7), Plain(n=41)):
        path.write_bytes(pickle.dumps(bad))
        with pytest.raises(ValueError):
            M.load_model(str(path))
    for odd, meta in ((Plain((0, 1, 2, 3)), None), (Plain(names=S.FEATURES[::-1]), None), (Plain(), {"schema_version": "older"}), (Plain(), "{")):
        path.write_bytes(pickle.dumps(odd))
        (tmp_path / "m.metadata.json").write_text(meta if isinstance(meta, str) else json.dumps(meta or {}))
        with pytest.warns(UserWarning):
            M.load_model(str(path))
    path.write_bytes(pickle.dumps(Plain()))
    (tmp_path / "m.metadata.json").write_text(json.dumps({"feature_names": ["a", "b"]}))
    with pytest.raises(ValueError):
        M.load_model(str(path))


def test_forest_equals_spark(spark):
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    y = [LABELS[int(a > 0) + 2 * int(b > 0.3)] for a, b in x[:, :2]]
    rows = spark.createDataFrame([(r.tolist(), k) for r, k in zip(x, y)], "features array<double>, label string")
    fitted = S.fit_classifier(rows, trees=9, depth=4)
    forest = M.forest_of(fitted)
    want = {tuple(r.features): r.p for r in fitted.transform(rows.selectExpr("features", "label", "1.0 __w").withColumn("__x", __import__("pyspark.ml.functions", fromlist=["a"]).array_to_vector("features"))).select("features", vector_to_array("probability").alias("p")).collect()}
    got = pickle.loads(pickle.dumps(forest)).predict_proba(x)
    assert got == pytest.approx(np.array([want[tuple(r)] for r in x.tolist()])) and got.sum(axis=1) == pytest.approx(1)
    said = np.array(forest.classes_)[got.argmax(axis=1)]
    report = {r.label: r for r in M.evaluate_model(forest, rows).collect()}
    for k in LABELS:
        hit, n, m = sum((said == k) & (np.array(y) == k)), sum(said == k), y.count(k)
        assert (report[k].precision, report[k].recall, report[k].f1, report[k].support) == (pytest.approx(hit / n), pytest.approx(hit / m), pytest.approx(2 * hit / (n + m)), m)
    for method in ("sigmoid", "isotonic", "none"):
        p = M.calibrated(forest, rows, method).predict_proba(x)
        assert p.sum(axis=1) == pytest.approx(1) and (p.argmax(axis=1) == got.argmax(axis=1)).mean() > 0.9
    keyed = rows.selectExpr("*", "monotonically_increasing_id() row_id")
    dealt = M.folds(keyed, "row_id", 4).groupBy("fold").count().collect()
    assert sorted(r.fold for r in dealt) == [0, 1, 2, 3] and sum(r["count"] for r in dealt) == 400 and min(r["count"] for r in dealt) > 60
    assert len(scores := M.cross_validate(keyed, "row_id", 2, trees=5, depth=4)) == 2 and min(scores) > 0.8


def encoder():
    """A function of this one, so that it is sent to the workers by value."""

    def encode(texts):
        return np.array([[len(t) / 10, float("@" in t), 1.0] for t in texts])

    return encode


vectors = encoder()


def test_embedding_features(spark):
    docs = spark.createDataFrame([(0, "please mail a.b@mail.org or call it a day"), (1, None), (2, "nothing")], "doc_id long, text string")
    r = S.add_features(fuse(D.detect(docs)), encode=vectors).orderBy("doc_id").collect()
    f = dict(zip(S.FEATURES, r[0].features[0]))
    v, c = vectors(["a.b@mail.org", "please mail or call it a day"])
    assert [f[f"embedding_{k}"] for k in ("mean", "std", "norm", "max")] == pytest.approx([v.mean(), v.std(), np.linalg.norm(v), v.max()])
    assert f["context_embedding_norm"] == pytest.approx(np.linalg.norm(c)) and f["span_context_similarity"] == pytest.approx(v @ c / np.linalg.norm(v) / np.linalg.norm(c))
    assert r[1].features == [] and r[2].features == []
    plain = dict(zip(S.FEATURES, S.add_features(fuse(D.detect(docs))).orderBy("doc_id").first().features[0]))
    assert {k for k in S.FEATURES if f[k] != plain[k]} <= {"embedding_mean", "embedding_std", "embedding_norm", "embedding_max", "context_embedding_norm", "span_context_similarity"}


def test_encoder(spark, tmp_path):
    with pytest.raises(ValueError):
        model_folder(str(tmp_path))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "config.json").write_text("{}")
    assert model_folder(str(tmp_path)) == tmp_path / "a"
    loads = []

    def load(folder):
        loads.append(folder)
        return vectors

    e = Encoder(str(tmp_path), load)
    rows = e(["ab", "", "a@b"])
    assert np.linalg.norm(rows, axis=1) == pytest.approx([1, 0, 1]) and len(e([])) == 0 and len(loads) == 1
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "config.json").write_text("{}")
    with pytest.raises(ValueError):
        model_folder(str(tmp_path))


def test_tokens_and_failing_encoder(spark):
    docs = spark.createDataFrame([(0, "see x7 for 12345678 then more text to go on", [(4, 6)]), (1, "boom 99999999", []), (2, "ok 11111111", None)], "doc_id long, text string, t array<struct<start:int,end:int>>")

    def encode(texts):
        if any("99999999" in t for t in texts):
            raise RuntimeError("no")
        return np.array([[1.0, float(t[:1].isdigit() or "bank" in t)] for t in texts])

    out = D.detect(D.add_ml_token(docs, encode, tokens="t"), {"ml_token": "ml_token"}).orderBy("doc_id").collect()
    assert out[1].detections == [] and out[2].detections and any(d.text.startswith("x7 for") and d.end - d.start == 25 for d in out[0].detections)


def test_failing_document(spark):
    d = "struct<start:int,end:int,pii_type:string,ord:int,text:string,confidence:double,detector_name:string,pattern_id:string>"
    rows = [(0, "secret one", [(0, 6, None, 0, "secret", 0.9, "regex", None)]), (1, "a@b.org", [(0, 7, "EMAIL", 0, "a@b.org", 0.9, "regex", None), (None, 7, "EMAIL", 0, "x", 0.9, "regex", None)]), (2, "a@b.org", [(0, 7, "EMAIL", 0, "a@b.org", 0.9, "regex", None)])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, found array<{d}>").withColumnRenamed("found", "detections")
    with pytest.raises(Exception):
        fuse(docs).collect()
    got = fuse(docs, error="error").orderBy("doc_id").collect()
    assert got[1].error and not got[1].spans and got[2].error is None and len(got[2].spans) == 1
    done = RedactionPipeline(detectors={"regex": "given"}, isolate=True).transform(docs.selectExpr("doc_id", "text", "filter(detections, x -> x.pii_type is not null) given").where("doc_id <> 1")).orderBy("doc_id").collect()
    assert [r.decision for r in done] == ["PROCESS", "PROCESS"] and all(r.error is None for r in done)


def test_settings(spark, tmp_path):
    (tmp_path / "policy.json").write_text(json.dumps({"severity_thresholds": {"LOW": [0, 0.95], "HIGH": [0.95, 1]}, "rules": [{"id": "all", "action": {"decision": "BLOCK"}}]}))
    s = Settings.from_env({"VEIL_POLICY_PATH": str(tmp_path / "policy.json"), "VEIL_CONTEXT_WINDOW": "3", "VEIL_DETECTORS": "regex"})
    r = RedactionPipeline.from_settings(s).transform(spark.createDataFrame([(0, "my mail a@b.org ok")], "doc_id long, text string")).first()
    assert (r.severity_label, r.decision, r.applied_rules, r.spans[0].left_context, r.error) == ("LOW", "BLOCK", ["all"], "il ", None)
    with pytest.raises(ValueError):
        RedactionPipeline.from_settings(Settings(detectors=("ner",)))


LINES = [
    {"text": "mail a.b@mail.org now", "span_text": "a.b@mail.org", "pii_type": "EMAIL", "severity_label": "MEDIUM"}, {"text": "password: hunter22 here", "span_text": "hunter22", "pii_type": "PASSWORD", "severity_label": "0.9"},
    {"text": "see https://a.b/c today", "span_text": "https://a.b/c", "pii_type": "URL", "severity_label": "low"}, {"text": "sort code 20-00-00 ok", "span_text": "20-00-00", "pii_type": "SORT_CODE", "severity_label": "HIGH"},
]


def test_commands(spark, tmp_path, capsys):
    rows = [{**r, "text": r["text"] + f" {i}"} for i in range(12) for r in LINES]
    (tmp_path / "train.jsonl").write_text("\n".join(map(json.dumps, rows)))
    folder = str(tmp_path / "model")
    assert main(["train", "--input", str(tmp_path / "train.jsonl"), "--output", folder, "--trees", "5", "--folds", "2"], spark, {}) == 0
    said = json.loads(capsys.readouterr().out)
    assert sum(said["rows"].values()) == 48 and set(said["rows"]) == set(LABELS) and len(said["folds"]) == 2 and min(said["folds"]) > 0.8
    meta = json.loads((tmp_path / "model" / "metadata.json").read_text())
    assert meta["schema_version"] == S.SCHEMA_VERSION and set(meta["class_labels"]) == set(LABELS) and meta["feature_names"] == list(S.FEATURES)
    assert main(["severity", "--text", "write to a.b@mail.org", "--model", folder], spark, {}) == 0
    (span,) = json.loads(capsys.readouterr().out)["spans"]
    assert span["pii_type"] == "EMAIL" and len(span["features"]) == 130 and sum(span["severity_probs"].values()) == pytest.approx(1)
    assert main(["redact", "--text", "write to a.b@mail.org"], spark, {"VEIL_MODEL_PATH": folder}) == 0
    assert "a.b@mail.org" not in capsys.readouterr().out
    (tmp_path / "f.jsonl").write_text(json.dumps({"features": span["features"]}) + "\n" + json.dumps(span["features"]))
    assert main(["analyse", "--input", str(tmp_path / "f.jsonl"), "--model", folder, "--train-stats", f"{folder}/training_stats.json"], spark, {}) == 0
    report = capsys.readouterr().out
    assert "## Importance" in report and "## Drift" in report
    (tmp_path / "gold.jsonl").write_text("\n".join(json.dumps({"text": r["text"], "spans": [{"pii_type": r["pii_type"], "start": r["text"].index(r["span_text"]), "end": r["text"].index(r["span_text"]) + len(r["span_text"])}]}) for r in LINES))
    assert main(["calibrate", "--input", str(tmp_path / "gold.jsonl"), "--detectors", "regex", "--apply"], spark, {"VEIL_THRESHOLDS_PATH": str(tmp_path / "t.json")}) == 0
    best = json.loads(capsys.readouterr().out)
    assert {"EMAIL", "URL"} <= {r["pii_type"] for r in best} and json.loads((tmp_path / "t.json").read_text())["regex"]["EMAIL"] == pytest.approx(0.2)
    assert main(["cycle", "--input", str(tmp_path / "gold.jsonl"), "--model", folder, "--train-stats", f"{folder}/training_stats.json"], spark, {}) == 0
    assert "candidate promoted: True" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["train"], spark, {})


def test_pipeline_still_plain(spark):
    """Without settings there is no error column."""
    assert "error" not in run_pipeline(spark.createDataFrame([(0, "x")], "doc_id long, text string")).columns
    assert improve.subset(spark.range(5), 2, "id").count() == 2

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from veilspark.functions import text as T
from veilspark.functions.expr import X
from veilspark.operators import detect as D
from veilspark.operators import evaluate as E
from veilspark.operators import policy as P
from veilspark.operators import severity as S
from veilspark.operators.fusion import fuse
from veilspark.plans.pipeline import run_pipeline
from veilspark.plans.queries import QUERIES, SQL
from veilspark.sources import readers as R
from veilspark.sources import writers as W

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if not isinstance(v, (list, np.ndarray)) and (v is None or v != v) else v for v in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    a, b = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and key(a) == key(b)


def test_redact_email_equals_sql_on_odd_texts(spark, tmp_path):
    """Neighbours, safe domains, long addresses, words beside letters outside ASCII, a long s, marks, edges of dots."""
    mail = "a.b@mail.org"
    texts = [f"{mail} {mail}", f"{mail},{mail};c@d.org", f"é{mail}", f"{mail}é x", f"é-{mail}", f"é.{mail}", f"x@example.com {mail}", "order-12345678@mail.org", "a" * 140 + "@mail.org", "ſ@KELVIN.ſſ", "K@mail.org", f"<{mail}>", f"..{mail}..", f"._{mail}_",
             f"\ufdd0{mail}\ufdd1", f"🙂{mail}🙂 {mail}", "a@b@c.org", "a@b.c1", f"1{mail}1", "@", "", None, f"٣{mail}", f"{mail}\n{mail}\r\n{mail}", "<CONTACT>", "a@b.orgorgorgorgorgorgorgorgorgorgorg"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = dict(con.execute(SQL["redact_email"]).fetchall())
    got = {r.doc_id: r.sanitized_text for r in QUERIES["redact_email"](spark, str(tmp_path)).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, expected[i]) for i, t in enumerate(texts)]


def test_pipeline_query(spark):
    assert QUERIES["redact_all"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_sentences(spark):
    long = "word " * 300 + "end. Next"
    df = spark.createDataFrame([("a. b!\nc",), ("",), (None,), (long,)], "t string").select("t", T.sentence_boundaries(F.col("t")).alias("s")).collect()
    assert [tuple(s) for s in df[0].s] == [(0, 2), (2, 5), (5, 6), (6, 7)] and [tuple(s) for s in df[1].s] == [(0, 0)] == [tuple(s) for s in df[2].s]
    assert max(b - a for a, b in df[3].s) <= 505 and df[3].s[0].start == 0 and df[3].s[-1].end == len(long)
    with pytest.raises(ValueError):
        T.sentence_boundaries(F.col("t"), longest=0)


def test_sentences_one_by_one():
    """Delimiters, none, those special in patterns, and white space beyond the length."""

    def plain(text, delimiters, longest):
        out, start = [], 0
        for i, c in enumerate(text):
            if c in delimiters:
                out.append((start, i + 1))
                start = i + 1
            elif i - start >= longest and c.isspace() and i > start:
                out.append((start, i))
                start = i
        return out + [(start, len(text))] if start < len(text) else out or [(0, 0)]

    rng = np.random.default_rng(5)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab .!\n\t\x1c\x85\u3000é]-^"), rng.integers(0, 40)))
        for delimiters in (".!?\n", "", "]^-\\", " "):
            assert all(T._sentences(text, delimiters, n) == plain(text, delimiters, n) for n in (1, 2, 5, 500)), text


def test_features_read_texts_that_have_spans_only(spark, monkeypatch):
    read, cut = [], T.sentence_boundaries
    monkeypatch.setattr(T, "sentence_boundaries", lambda c: read.append(c) or cut(c))
    df = spark.createDataFrame([(0, "One. Mail a@b.org"), (1, "Two. None"), (2, None)], "doc_id long, text string")
    fused = P.add_severity(fuse(D.detect(df)))
    got = S.add_features(fused).orderBy("doc_id").collect()
    assert [r[0] for r in fused.orderBy("doc_id").select(read[0]).collect()] == ["One. Mail a@b.org", None, None]
    assert [len(r.features) for r in got] == [1, 0, 0] and got[0].features[0][S.FEATURES.index("sentence_index")] == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("  (a-b),  ",)], "t string")
    t = X.col("t")
    assert tuple(df.select(T.trim_span(t, X.lit(-3), X.lit(99)).column().alias("x")).first().x) == (3, 6, "a-b")
    assert df.select(T.normalize_text(F.lit("ﬁ①")).alias("x")).first().x == "fi1"
    tok = X.array(*[X.struct(X.lit(2 * i).alias("start"), X.lit(2 * i + 1).alias("end")) for i in range(10)])
    assert [tuple(c) for c in df.select(T.token_chunks(tok, 4, 1).column().alias("x")).first().x] == [(0, 7), (6, 13), (12, 19)]
    assert df.select(T.json_safe(t).column().alias("x")).first().x == '{"value":"  (a-b),  "}'


def test_features(spark):
    assert len(S.FEATURES) == 130 == len(set(S.FEATURES)) and S.FEATURES[66] == "context_channel_email" and S.FEATURES[129] == "pii_category_LOCATION_ACTIVITY"
    done = run_pipeline(spark.createDataFrame([(0, "Hi Jane, the bank account number is 12345678 and the password hunter2."), (1, None)], "doc_id long, text string"))
    a, b = S.add_features(done).orderBy("doc_id").collect()
    f = dict(zip(S.FEATURES, a.features[0]))
    assert a.spans[0].text == "12345678" and f["source_regex"] == 1 and f["digit_count"] == 8 and f["neighbor_span_count"] >= 1 and f["ctx_has_bank"] == 1 and f["pii_type_BANK_ACCOUNT"] == 1
    assert f["is_financial"] == 0 and f["token_position_ratio"] == pytest.approx(7 / 12) and len(a.features[0]) == 130 and b.features == []
    with pytest.raises(ValueError):
        S.vector({"x": X.lit(0.0)})


def test_model_severity(spark):
    class Stub:
        classes_ = list(S.LABELS)

        def predict_proba(self, x):
            return np.tile([0.1, 0.2, 0.3, 0.4], (len(x), 1))

    df = spark.createDataFrame([(0, "mail a@b.org")], "doc_id long, text string")
    r = run_pipeline(df, severity=lambda d: S.add_model_severity(d, Stub())).first()
    assert r.spans[0].severity_label == "VERY_HIGH" and r.severity_score == pytest.approx(0.75)
    bad = Stub()
    bad.feature_names_in_ = ["a"]
    with pytest.raises(ValueError):
        S.add_model_severity(run_pipeline(df), bad)


def test_vectors_and_stats(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), (None, None)], "v array<double>, c array<double>")
    got = df.select(*[e.alias(k).column() for k, e in S.vector_features(X.col("v"), X.col("c")).items()]).collect()
    assert got[0].embedding_norm == 5 and got[0].embedding_std == pytest.approx(0.5) and got[0].span_context_similarity == pytest.approx(0.96) and got[1].embedding_max == 0
    rows = spark.createDataFrame([([1.0, 0.0],), ([3.0, 0.0],)], "features array<double>")
    stats = {r.feature: r for r in S.feature_stats(rows, names=["a", "b"]).collect()}
    assert stats["a"].mean == 2 and stats["a"].std == 1
    moved = S.drift(S.feature_stats(rows, names=["a", "b"]), S.feature_stats(rows.select(F.transform("features", lambda x: x + 1).alias("features")), names=["a", "b"]))
    assert {r.feature: round(r.drift, 3) for r in moved.collect()} == {"a": 1.0, "b": 1e6} and S.needs_retraining(moved).first().retrain


def test_training(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0], "HIGH" if i % 2 else "LOW") for i in range(80)], "id int, features array<double>, label string")
    train, held = S.stratified_split(rows, "label", "id")
    assert train.count() + held.count() == 80 and 0 < held.count() < 40
    model = S.fit_classifier(train, trees=3, depth=2)
    out = model.transform(held.withColumn("__x", __import__("pyspark.ml.functions", fromlist=["x"]).array_to_vector("features")))
    assert out.where("prediction <> __y").count() == 0 if "__y" in out.columns else out.count()
    importance = S.feature_importance(model.stages[-1], ["a", "b"])
    assert importance["a"] > 0 and S.top(importance, 1)[0][0] == "a"
    W.write_model(model, str(tmp_path / "m"), ["a", "b"], importance, [r.asDict() for r in S.feature_stats(rows, names=["a", "b"]).collect()])
    assert json.loads((tmp_path / "m/metadata.json").read_text())["feature_names"] == ["a", "b"]
    fixed = S.repair_offsets(spark.createDataFrame([("my cat", None, None, "cat", "A", []), ("x", None, None, "zz", "B", [(4, 6, "B")]), ("x", 1.0, 2.0, "", "C", []), ("x", None, None, "q", "D", [])], "text string, span_start double, span_end double, span_text string, pii_type string, found array<struct<start:int,end:int,pii_type:string>>"), spans="found")
    assert sorted((r.span_start, r.span_end) for r in fixed.collect()) == [(1, 2), (3, 6), (4, 6)]
    table = S.confusion(spark.createDataFrame([("LOW", "LOW"), ("LOW", "HIGH")], "label string, predicted string")).first()
    assert table.LOW == 1 and table.HIGH == 1 and table.VERY_HIGH == 0


def test_matching(spark):
    g = lambda *s: [{"start": a, "end": b, "pii_type": t} for a, b, t in s]
    m = E.match_spans(g((0, 10, "A"), (1, 10, "A"), (20, 30, "B")), g((0, 10, "A"), (20, 30, "C")))
    assert (m["tp"], m["fp"], m["fn"]) == (1, 2, 1)
    docs = run_pipeline(spark.createDataFrame([(0, "mail a@b.org", [(5, 12, "EMAIL")]), (1, "none", [(0, 2, "EMAIL")])], "doc_id long, text string, gold array<struct<start:int,end:int,pii_type:string>>"))
    row = E.metrics(E.add_matches(docs)).first().asDict()
    assert (row["tp"], row["fp"], row["fn"], row["precision"], row["recall"], row["mean_iou"]) == (1, 0, 1, 1.0, 0.5, 1.0) and "Samples: 2" in W.evaluation_report(row)
    assert E.promote(0.98, 1.0) and not E.promote(0.97, 1.0)
    best = E.calibrate(spark.createDataFrame([("d", "A", 0.5, True), ("d", "A", 0.3, False)], "detector_name string, pii_type string, confidence double, ok boolean"))
    r = best.first()
    assert r.f1 == 1.0 and 0.3 < r.threshold <= 0.5
    assert E.adopt(best, spark.createDataFrame([("d", "A", 1.0)], "detector_name string, pii_type string, baseline_f1 double")).first().adopted


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line\nmail a@b.org", "utf-8")
    assert R.read_text(spark, str(tmp_path / "a.txt")).first().text == "line\nmail a@b.org" and R.text_or_file(spark, "x").first().text == "x"
    with pytest.raises(ValueError):
        R.text_or_file(spark)
    (tmp_path / "l.jsonl").write_text('{"text": "t", "spans": [{"pii_type": "A", "start": 0, "end": 1}]}\n\n{"text": "u"}\n')
    assert R.read_jsonl(spark, str(tmp_path / "l.jsonl")).count() == 2
    (tmp_path / "t.csv").write_text("text,span_start,span_end,span_text,pii_type,severity_label,confidence\n\"a, b\",0,1,a,X,HIGH,0.5\n")
    (tmp_path / "t.jsonl").write_text('{"text": "ab", "span": {"start": 0, "end": 1, "text": "a", "pii_type": "X"}, "severity_label": "LOW"}\n')
    assert R.read_training(spark, str(tmp_path / "t.csv")).first().text == "a, b" and R.read_training(spark, str(tmp_path / "t.jsonl")).first().span_text == "a"
    named = json.dumps({"features": dict.fromkeys(S.FEATURES, 1.5)})
    (tmp_path / "f.jsonl").write_text(named + "\n" + json.dumps({"feature_vector": [2.0] * 130}) + "\n\n" + json.dumps(dict.fromkeys(S.FEATURES, 3.0)) + "\n")
    assert sorted(r.features[7] for r in R.read_features(spark, str(tmp_path / "f.jsonl")).collect()) == [1.5, 2.0, 3.0]
    (tmp_path / "bad.jsonl").write_text('{"features": [1.0]}\n')
    with pytest.raises(Exception, match="130 features"):
        R.read_features(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "p.json").write_text('{"rules": [{"id": "r"}]}')
    assert R.load_policy(str(tmp_path / "p.json"))[1] == ({"id": "r"},) and len(R.load_policy()[1]) == 15 and R.load_json("/no/such", {"a": 1}) == {"a": 1}
    s = R.Settings.from_env({"VEIL_CONTEXT_WINDOW": "40", "VEIL_DEBUG": "true", "VEIL_DETECTORS": "regex, ner"})
    assert s.context_window == 40 and s.debug and s.detectors == ("regex", "ner")
    done = run_pipeline(R.literal_text(spark, "mail a@b.org"))
    W.write_text(done, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "mail <CONTACT>"
    assert json.loads(W.json_result(done).first().value)["pii_spans"][0]["text"] == "a@b.org" and json.loads(W.debug_result(done, 3).first().value)["spans"][0]["text"] == "a@b..."
    assert json.loads(W.severity_result(S.add_features(done)).first().value)["spans"][0]["pii_type"] == "EMAIL" and W.inference_result(done).first().spans[0].decision.action == "MASK"
    assert W.decision_log(done).first().rule_id == "contact_medium_plus" and "drift" in W.analysis_report([("a", 1.0)], [], [("drift", 1.0)]).lower()
    assert W.write_thresholds(spark.createDataFrame([("embedding", "A", 0.5)], "detector_name string, pii_type string, threshold double"), str(tmp_path / "t.json"))["embedding"] == {"A": 0.5}
    W.write_report(str(tmp_path / "r"), {"a": 1}, "# x")


def test_stream_equals_batch(spark, tmp_path):
    from veilspark.streaming import redaction as St

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    St.write_redacted(St.redact_stream(St.read_documents(spark, str(tmp_path / "in"), files=1)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "sanitized_text")
    want = run_pipeline(docs).select("doc_id", "sanitized_text")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    timed = run_pipeline(docs.limit(5).withColumn("ts", F.lit("2024-01-01 00:10:00").cast("timestamp")))
    assert set(St.rollup(timed).columns) == {"window", "pii_type", "spans", "masked"}

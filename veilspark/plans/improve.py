"""Evaluation of a labelled corpus, and the cycle that recalibrates, checks for drift and decides on a new model."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import model as M
from ..operators import severity as S
from ..operators.detect import BUILT_IN, detect
from ..operators.fusion import fuse
from ..operators.training import training_table
from ..sources.session import cut
from ..sources.writers import analysis_report, write_model
from .pipeline import RedactionPipeline, each


def evaluate(labelled: DataFrame, pipeline: RedactionPipeline | None = None) -> dict:
    """One row of metrics for (text, spans) rows: the labelled spans become the column gold."""
    docs = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("spans", F.array().cast(labelled.schema["spans"].dataType)).alias("gold"))
    return E.metrics(E.add_matches((pipeline or RedactionPipeline()).spans(docs))).first().asDict()


def calibration(labelled: DataFrame, detections: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Best thresholds for ``detections``, which maps documents to rows (doc_id, start, end, pii_type, confidence, detector_name)."""
    docs = labelled.withColumn("doc_id", F.xxhash64("text"))
    gold = docs.select("doc_id", F.explode("spans").alias("g")).select("doc_id", "g.*")
    return E.calibrate(E.detection_hits(detections(docs.select("doc_id", "text")), gold))


def detections_of(*names: str) -> Callable[[DataFrame], DataFrame]:
    """For ``calibration``: rows of the detectors of the built-in pipeline, or of those named."""
    chosen = {n: BUILT_IN[n] for n in names or BUILT_IN}
    return lambda docs: each(detect(docs, chosen), "detections", "doc_id").select("doc_id", "d.start", "d.end", "d.pii_type", "d.confidence", "d.detector_name")


def severity_spans(docs: DataFrame, model, pipeline: RedactionPipeline | None = None, text: str = "text", encode=None) -> DataFrame:
    """Severity alone: ``docs`` with spans, scored by ``model``, and their features; no policy, no redaction."""
    p = pipeline or RedactionPipeline()
    found = fuse(detect(docs, p.detectors, text), text=text, context=p.context, strict_compat=p.strict_compat)
    return S.add_features(S.add_model_severity(found, model, text, encode=encode), text, encode=encode)


def train_severity(rows: DataFrame, folder: str, share: float = 0.2, k: int = 3, method: str = "sigmoid", augment: bool = True, seed: int = 42, **fit) -> dict:
    """Fit, calibrate, validate and write a severity model of labelled spans (as ``read_training`` gives them).

    The model and its metadata, importance and statistics go to ``folder``,
    which ``load_model`` reads; the report of the rows held out is returned.
    """
    if "row_id" not in rows.columns:
        rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    table = cut(training_table(rows, augment), "training")
    train, held = S.stratified_split(table, "label", "row_id", share, seed)
    fitted = M.forest_of(S.fit_classifier(train.select("features", "label"), seed=seed, **fit))
    model = M.calibrated(fitted, held if not held.isEmpty() else train, method)
    stats = [r.asDict() for r in S.feature_stats(train.select("features")).collect()]
    counts = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    write_model(model, folder, list(S.FEATURES), S.feature_importance(fitted), stats, class_labels=list(model.classes_), schema_version=S.SCHEMA_VERSION, calibration=method)
    report = {r["label"]: r.asDict() for r in M.evaluate_model(model, held if not held.isEmpty() else train).collect()}
    return {"rows": counts, "held": report, "folds": M.cross_validate(table, "row_id", k, seed=seed, **fit) if k > 1 else []}


def analyse(features: DataFrame, model, train_stats: dict | None = None) -> str:
    """Markdown of statistics of (features) rows, the model's importance and, with {feature: {mean, std}}, drift."""
    now = S.feature_stats(features)
    drift = None
    if train_stats:
        rows = [(k, float(v["mean"]), float(v.get("std") or 0.0)) for k, v in train_stats.items()]
        drift = [(r["feature"], r["drift"]) for r in S.drift(features.sparkSession.createDataFrame(rows, "feature string, mean double, std double"), now).collect()]
    return analysis_report(S.top(S.feature_importance(model)), [r.asDict() for r in now.orderBy("feature").collect()], drift)


def subset(labelled: DataFrame, rows: int, order: str) -> DataFrame:
    """The first ``rows`` by ``order``, for a debug run."""
    return labelled.orderBy(order).limit(rows)


def cycle(labelled: DataFrame, baseline: RedactionPipeline, candidate: RedactionPipeline, train_stats: DataFrame | None = None, gate: float = 0.15) -> dict:
    """The decisions of a round: baseline and candidate metrics, drift, whether to retrain and whether to promote.

    The baseline stays unless the candidate's F1 is at least 0.98 of its own.
    """
    before, after = evaluate(labelled, baseline), evaluate(labelled, candidate)
    out = {"at": datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ"), "baseline": before, "candidate": after, "promoted": E.promote(after["f1"], before["f1"]), "max_drift": None, "retrain": False}
    if train_stats is not None:
        docs = baseline.spans(labelled.select(F.coalesce("text", F.lit("")).alias("text")))
        now = S.feature_stats(S.add_features(docs).select(F.explode_outer("features").alias("features")).where("features is not null"))
        row = S.needs_retraining(S.drift(train_stats, now), gate).first()
        out |= {"max_drift": row.max_drift, "retrain": row.retrain}
    return out


def cycle_report(result: dict) -> str:
    """Markdown of ``cycle``."""
    lines = [f"# Round {result['at']}", "", "| | precision | recall | f1 |", "|-|-|-|-|"]
    lines += [f"| {k} | {result[k]['precision']:.3f} | {result[k]['recall']:.3f} | {result[k]['f1']:.3f} |" for k in ("baseline", "candidate")]
    return "\n".join([*lines, "", f"- candidate promoted: {result['promoted']}", f"- largest drift: {result['max_drift']}", f"- retrain: {result['retrain']}"]) + "\n"



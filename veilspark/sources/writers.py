"""Sinks: redacted text, JSON results, reports and the decision log."""

from __future__ import annotations

import json
import pickle
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import LABELS
from ..plans.pipeline import each

SHOWN = ("start", "end", "text", "pii_type", "confidence", "severity_score", "severity_label")
INFERRED = ("start", "end", "text", "pii_type", "severity_label", "severity_score", "decision")


def write_text(done: DataFrame, path: str) -> None:
    done.select("sanitized_text").write.text(path)


def _spans(fields: tuple[str, ...], cut: int = 0) -> Column:
    def one(f: str) -> str:
        value = f"if(length(s.text) > {cut}, concat(left(s.text, {cut}), '...'), s.text)" if f == "text" and cut > 0 else f"s.{f}"
        return f"'{f}', {value}"

    return F.expr(f"transform(spans, s -> named_struct({', '.join(map(one, fields))}))")


def json_result(done: DataFrame) -> DataFrame:
    """(value): the result of each document as JSON, spans by SHOWN and without raw detections."""
    return done.select(F.to_json(F.struct("sanitized_text", "decision", "severity_label", "severity_score", "applied_rules", _spans(SHOWN).alias("pii_spans"))).alias("value"))


def debug_result(done: DataFrame, cut: int = 0, text: str = "text") -> DataFrame:
    """(value): with the text itself and span texts of at most ``cut`` characters (0: whole)."""
    return done.select(F.to_json(F.struct(F.col(text).alias("text"), "sanitized_text", "decision", "severity_label", "severity_score", _spans(("start", "end", "pii_type", "severity_label", "decision", "text"), cut).alias("spans"))).alias("value"))


def inference_result(done: DataFrame) -> DataFrame:
    return done.select("sanitized_text", _spans(INFERRED).alias("spans"), "decision", "severity_label", "severity_score", "applied_rules")


def severity_result(done: DataFrame) -> DataFrame:
    """(value): spans with features and probabilities, for tables that have them."""
    probs = ", 'severity_probs', s.severity_probs" if "severity_probs" in done.schema["spans"].dataType.elementType.names else ""
    each = F.expr(f"zip_with(spans, features, (s, f) -> named_struct('start', s.start, 'end', s.end, 'text', s.text, 'pii_type', s.pii_type, 'severity_label', s.severity_label, 'severity_score', s.severity_score, 'features', f{probs}))")
    return done.select(F.to_json(F.struct(each.alias("spans"))).alias("value"))


def decision_log(done: DataFrame, key: str = "doc_id", window: int = 200) -> DataFrame:
    """(key, logged_at, action, rule_id, pii_type, start, end, score, window): one row for each decision, UTC time, context of at most ``window`` characters."""
    return each(done, "spans", key, "s").select(key, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("logged_at"), "s.decision.action", "s.decision.rule_id", "s.pii_type", "s.start", "s.end", F.col("s.severity_score").alias("score"), F.left(F.concat("s.left_context", "s.text", "s.right_context"), F.lit(window)).alias("window"))


def evaluation_report(row: dict) -> str:
    """Markdown of one row of ``metrics``."""
    out = ["# Evaluation", "", f"- Samples: {row['samples']}", *(f"- {k.replace('_', ' ')}: {row[k]:.3f}" for k in ("precision", "recall", "f1", "mean_iou"))]
    for title, keys in (("Severity", LABELS), ("Errors", ("missed", "over_detect", "boundary_miss")), ("Agreement", ("multi_detector_spans", "single_detector_spans"))):
        out += ["", f"## {title}", "", *(f"- {k}: {row[k]}" for k in keys)]
    return "\n".join(out) + "\n"


def analysis_report(importance: list[tuple[str, float]], stats: list[dict], drift: list[tuple[str, float]] | None = None) -> str:
    out = ["# Severity model", "", "## Importance", "", *(f"- {n}: {v:g}" for n, v in importance[:10]), "", "## Statistics", "", "| feature | mean | std | min | max |", "|-|-|-|-|-|"]
    out += [f"| {s['feature']} | {s['mean']:.4g} | {s['std']:.4g} | {s['min']:.4g} | {s['max']:.4g} |" for s in stats]
    if drift:
        out += ["", "## Drift", "", *(f"- {n}: {v:.4g}" for n, v in sorted(drift, key=lambda x: -x[1])[:10])]
    return "\n".join(out) + "\n"


def write_report(path: str, row: dict, markdown: str) -> None:
    """``path``.json and ``path``.md."""
    Path(f"{path}.json").write_text(json.dumps(row, indent=2, default=str), "utf-8")
    Path(f"{path}.md").write_text(markdown, "utf-8")


def write_thresholds(best: DataFrame | list, path: str) -> dict:
    """{detector: {type: threshold}} of a calibration, one row for each detector and type, as JSON."""
    out: dict[str, dict[str, float]] = {"embedding": {}, "ml_token": {}}
    for r in best if isinstance(best, list) else best.collect():
        out.setdefault(r["detector_name"], {})[r["pii_type"]] = r["threshold"]
    Path(path).write_text(json.dumps(out, indent=2), "utf-8")
    return out


def write_model(model, path: str, features: list[str], importance: dict[str, float], stats: list[dict], **metadata) -> None:
    """A model (Spark ML, or any that can be pickled) with its metadata, importance and training statistics beside it."""
    if hasattr(model, "write"):
        model.write().overwrite().save(f"{path}/model")
    else:
        Path(path).mkdir(parents=True, exist_ok=True)
        Path(f"{path}/model.pkl").write_bytes(pickle.dumps(model))
    for name, value in (("metadata", {"feature_names": features} | metadata), ("feature_importance", importance), ("training_stats", {s["feature"]: {k: s[k] for k in ("mean", "std", "min", "max")} for s in stats})):
        Path(f"{path}/{name}.json").write_text(json.dumps(value, indent=2), "utf-8")

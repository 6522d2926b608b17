"""The whole path from text to redacted text, as narrow steps over a table of documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import X
from ..functions.rules import POLICY_RULES
from ..operators import policy as P
from ..operators.detect import BUILT_IN, Detector, detect
from ..operators.fusion import CONTEXT, fuse
from ..operators.model import load_model
from ..operators.severity import add_model_severity
from ..sources.readers import Settings, load_policy


@dataclass(frozen=True)
class RedactionPipeline:
    """detect -> fuse -> severity -> policy -> redact; each part can be replaced.

    ``severity`` maps a table with spans to one whose spans have severity_score
    and severity_label, and the columns of those names; the default takes the
    strongest confidence.  ``strict_compat`` keeps the quirks that lose text.
    ``isolate``: a document whose detections can't be fused gets a message in the
    column ``error``, an empty text and the decision ERROR instead of failing the job.
    """

    detectors: dict[str, Detector] = field(default_factory=lambda: dict(BUILT_IN))
    severity: Callable[[DataFrame], DataFrame] = P.add_severity
    rules: Sequence[dict] = POLICY_RULES
    context: int = CONTEXT
    strict_compat: bool = False
    isolate: bool = False

    @classmethod
    def from_settings(cls, settings: Settings, spark: SparkSession | None = None, **parts) -> RedactionPipeline:
        """The pipeline that ``settings`` describe: context, policy with its ranges, detectors of those built in, and the severity model, if one is named."""
        thresholds, rules = load_policy(settings.policy_path)
        unknown = [n for n in settings.detectors if n not in BUILT_IN]
        if unknown:
            raise ValueError(f"{unknown} need a model; give them as detectors")
        severity = partial(P.add_severity, thresholds=thresholds)
        if settings.model_path:
            severity = partial(add_model_severity, model=load_model(settings.model_path, spark))
        own = {"detectors": {n: BUILT_IN[n] for n in settings.detectors}, "severity": severity, "rules": rules, "context": settings.context_window, "isolate": not settings.debug}
        return cls(**own | parts)

    def spans(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with detections and decided spans."""
        found = fuse(detect(docs, self.detectors, text), text=text, context=self.context, strict_compat=self.strict_compat, error="error" if self.isolate else None)
        return P.add_decisions(self.severity(found), self.rules)

    def transform(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with detections, spans, severity_score, severity_label, sanitized_text, decision and applied_rules."""
        done = self.spans(docs, text)
        whole, spans = X.coalesce(X.col(text), ""), X.col("spans")
        failed = X.col("error").isNotNull() if self.isolate else X.lit(False)
        return done.withColumns({
            "sanitized_text": X.when(failed, "").otherwise(P.redact(whole, spans, self.strict_compat)).column(),
            "decision": X.when(failed, "ERROR").when(X.exists(spans, lambda s: s["decision"]["action"] == "BLOCK"), "BLOCK").otherwise("PROCESS").column(),
            "applied_rules": X.filter(X.transform(spans, lambda s: s["decision"]["rule_id"]), lambda r: r.isNotNull()).column(),
        })


def run_pipeline(docs: DataFrame, **parts) -> DataFrame:
    return RedactionPipeline(**parts).transform(docs)


def redact_text(spark: SparkSession, text: str, **parts) -> dict:
    """One text, as a dictionary; a failure withholds the text instead of showing it."""
    try:
        row = run_pipeline(spark.createDataFrame([(0, text)], "doc_id bigint, text string"), **parts).first()
    except Exception as e:  # noqa: BLE001
        return {"sanitized_text": "", "error": str(e), "spans": [], "decision": "ERROR"}
    return row.asDict(recursive=True)


def each(rows: DataFrame, array: str, key: str, name: str = "d") -> DataFrame:
    """(key, name): a row for each element.

    An inner explode would make Spark infer a filter on the array's size, which
    moves below the steps that make the array and has them run twice.
    """
    return rows.select(key, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def explode_spans(done: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each span."""
    return each(done, "spans", key, "s").select(key, "s.*")

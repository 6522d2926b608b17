"""Sources: texts, labelled rows, features, policies, thresholds and settings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import POLICY_RULES, THRESHOLDS, WEIGHTS
from ..operators.severity import FEATURES

LABELLED = "text string, spans array<struct<pii_type:string,start:int,end:int>>, context map<string,string>"
TRAINING = "text string, span_start double, span_end double, span_text string, pii_type string, severity_label string, confidence double, sources array<string>, span struct<start:int,end:int,text:string,pii_type:string>"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One document for each file: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def literal_text(spark: SparkSession, *texts: str | None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def text_or_file(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """Exactly one of the two."""
    if (text is None) == (path is None):
        raise ValueError("give a text or a path")
    return literal_text(spark, text) if path is None else read_text(spark, path)


def read_jsonl(spark: SparkSession, path: str, schema: str = LABELLED) -> DataFrame:
    """Rows of a fixed schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training rows of CSV or JSON lines, by suffix; a nested span fills missing flat columns."""
    if path.endswith((".csv", ".csv.gz")):
        flat = ", ".join(c for c in TRAINING.split(", ")[:7])
        return spark.read.schema(flat).option("enforceSchema", False).csv(path, header=True, multiLine=True, escape='"')
    rows = spark.read.schema(TRAINING).json(path)
    both = {"span_start": "span.start", "span_end": "span.end", "span_text": "span.text", "pii_type": "span.pii_type"}
    return rows.withColumns({k: F.coalesce(F.col(k), F.col(v)) for k, v in both.items()}).drop("span")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(features) vectors: ``features``, else ``feature_vector``, else the whole object; a wrong length or a missing name fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    inner = F.coalesce(F.get_json_object("value", "$.features"), F.get_json_object("value", "$.feature_vector"), F.col("value"))
    parsed = lines.select(inner.alias("j")).select("j", F.from_json("j", "map<string,double>").alias("m"), F.from_json("j", "array<double>").alias("l"))
    found = parsed.select(F.when(F.col("j").startswith("["), F.col("l")).otherwise(F.array(*[F.try_element_at("m", F.lit(n)) for n in FEATURES])).alias("features"))
    ok = (F.size("features") == len(FEATURES)) & ~F.exists("features", lambda x: x.isNull())
    return found.select(F.when(ok, F.col("features")).otherwise(F.raise_error(F.lit(f"a row doesn't have {len(FEATURES)} features"))).alias("features"))


def load_policy(path: str | None = None) -> tuple[tuple, tuple[dict, ...]]:
    """(thresholds, rules) of a JSON file, or YAML where a parser is installed; missing thresholds are the usual ones."""
    if path is None:
        return THRESHOLDS, POLICY_RULES
    raw = Path(path).read_text("utf-8-sig")
    if path.endswith((".yaml", ".yml")):
        import yaml

        config = yaml.safe_load(raw)
    else:
        config = json.loads(raw)
    ranges = config.get("severity_thresholds")
    return (tuple((k, float(v[0]), float(v[1])) for k, v in sorted(ranges.items(), key=lambda x: x[1][0])) if ranges else THRESHOLDS), tuple(config.get("rules") or ())


def load_json(path: str | None, default: dict) -> dict:
    """The default where there is no readable file."""
    try:
        return json.loads(Path(path).read_text("utf-8")) if path else default
    except (OSError, ValueError):
        return default


def load_yaml(path: str) -> dict:
    """JSON is YAML, so a file of that needs no parser."""
    raw = Path(path).read_text("utf-8")
    try:
        return json.loads(raw)
    except ValueError:
        import yaml

        return yaml.safe_load(raw) or {}


@dataclass(frozen=True)
class Settings:
    """Configuration on the driver; ``from_env`` reads VEIL_* variables."""

    context_window: int = 80
    ner_confidence: float = 0.75
    similarity_threshold: float = 0.55
    policy_path: str | None = None
    thresholds_path: str | None = None
    model_path: str | None = None
    detector_weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    detectors: tuple[str, ...] = ("regex", "domain_heuristic")
    debug: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        out, kinds = cls(), {"context_window": int, "ner_confidence": float, "similarity_threshold": float, "debug": lambda v: v.lower() in ("1", "true", "yes"), "detectors": lambda v: tuple(x.strip() for x in v.split(",") if x.strip())}
        for name in ("context_window", "ner_confidence", "similarity_threshold", "policy_path", "thresholds_path", "model_path", "debug", "detectors"):
            if (v := env.get(f"VEIL_{name.upper()}")) is not None:
                out = replace(out, **{name: kinds.get(name, str)(v)})
        return out

    def thresholds(self) -> dict:
        return load_json(self.thresholds_path, {"embedding": {}, "ml_token": {}})

"""Command line: ``python -m veilspark redact|json|debug|evaluate|severity|calibrate|train|analyse|cycle``.

VEIL_* variables give the settings (sources/readers.py).
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.model import load_model
from .plans import improve
from .plans.pipeline import RedactionPipeline
from .sources import readers, writers
from .sources.session import ship

COMMANDS = ("redact", "json", "debug", "evaluate", "severity", "calibrate", "train", "analyse", "cycle")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--text", help="a text; without it and without --input, standard input is read")
    p.add_argument("--input", help="a file or folder of texts; of labelled JSON lines for evaluate, calibrate and cycle; of training rows for train; of feature rows for analyse")
    p.add_argument("--output", help="where results go; without it, standard output")
    p.add_argument("--policy", help="a policy file")
    p.add_argument("--trunc-span", type=int, default=0, help="most characters of a span's text in debug output")
    p.add_argument("--model", help="a severity model: a pickle or a folder")
    p.add_argument("--train-stats", help="training statistics as JSON, for drift")
    p.add_argument("--detectors", default="", help="names of the detectors to calibrate, with commas")
    p.add_argument("--apply", action="store_true", help="calibrate: also write to the settings' file of thresholds")
    p.add_argument("--folds", type=int, default=3)
    p.add_argument("--validation-share", type=float, default=0.2)
    p.add_argument("--calibration", choices=("none", "sigmoid", "isotonic"), default="sigmoid")
    p.add_argument("--no-augment", action="store_true", help="train: don't run detectors over the training texts")
    p.add_argument("--trees", type=int, default=150)
    p.add_argument("--seed", type=int, default=42)
    return p


def show(path: str | None, text: str) -> None:
    if path:
        Path(path).write_text(text, "utf-8")
    else:
        print(text)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, env: dict[str, str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.text is not None and a.input:
        p.error("give --text or --input, not both")
    if a.command in COMMANDS[5:] + ("evaluate",) and not a.input:
        p.error(f"{a.command} needs --input")
    spark = spark or SparkSession.builder.appName("veilspark").getOrCreate()
    ship(spark)
    settings = readers.Settings.from_env(env)
    settings = replace(settings, policy_path=a.policy or settings.policy_path, model_path=a.model or settings.model_path)
    pipeline = RedactionPipeline.from_settings(settings, spark)
    if a.command == "evaluate":
        row = improve.evaluate(readers.read_jsonl(spark, a.input), pipeline)
        if a.output:
            writers.write_report(a.output, row, writers.evaluation_report(row))
        else:
            print(json.dumps(row, indent=2))
        return 0
    if a.command == "calibrate":
        names = tuple(x.strip() for x in a.detectors.split(",") if x.strip())
        best = improve.calibration(readers.read_jsonl(spark, a.input), improve.detections_of(*names)).collect()
        show(a.output, json.dumps([r.asDict() for r in best], indent=2))
        if a.apply:
            if not settings.thresholds_path:
                p.error("--apply needs VEIL_THRESHOLDS_PATH")
            writers.write_thresholds(best, settings.thresholds_path)
        return 0
    if a.command == "train":
        if not a.output:
            p.error("train needs --output")
        done = improve.train_severity(readers.read_training(spark, a.input), a.output, a.validation_share, a.folds, a.calibration, not a.no_augment, a.seed, trees=a.trees)
        print(json.dumps(done, indent=2, default=str))
        return 0
    if a.command == "analyse":
        stats = readers.load_json(a.train_stats, {})
        show(a.output, improve.analyse(readers.read_features(spark, a.input), load_model(settings.model_path, spark), stats or None))
        return 0
    if a.command == "cycle":
        labelled = readers.read_jsonl(spark, a.input)
        baseline = RedactionPipeline.from_settings(replace(settings, model_path=None), spark)
        stats = readers.load_json(a.train_stats, {})
        table = spark.createDataFrame([(k, float(v["mean"]), float(v.get("std") or 0.0)) for k, v in stats.items()], "feature string, mean double, std double") if stats else None
        show(a.output, improve.cycle_report(improve.cycle(labelled, baseline, pipeline, table)))
        return 0
    docs = readers.read_text(spark, a.input) if a.input else readers.literal_text(spark, a.text if a.text is not None else sys.stdin.read())
    if a.command == "severity":
        shown = writers.severity_result(improve.severity_spans(docs, load_model(settings.model_path, spark), pipeline))
    else:
        done = pipeline.transform(docs)
        shown = {"redact": lambda: done.select(done.sanitized_text.alias("value")), "json": lambda: writers.json_result(done), "debug": lambda: writers.debug_result(done, a.trunc_span)}[a.command]()
    if a.output:
        shown.write.text(a.output)
    else:
        for r in shown.toLocalIterator():
            print(r.value)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

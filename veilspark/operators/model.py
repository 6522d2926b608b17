"""Severity classifiers: loading and checking, forests as arrays, calibration, folds and reports."""

from __future__ import annotations

import json
import pickle
import warnings
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import LABELS
from .severity import FEATURES, SCHEMA_VERSION, fit_classifier


class NoModel:
    """Where there is no classifier, every span is LOW with a score of 0."""

    classes_ = ["LOW"]
    scores = [0.0]

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        return np.ones((len(x), 1))


class Forest:
    """A forest as arrays, so that workers need no JVM: predict_proba like Spark's, the mean of the leaves' shares."""

    def __init__(self, trees: list[dict[str, np.ndarray]], classes: Sequence[str], importances: np.ndarray | None = None, names: Sequence[str] = tuple(FEATURES)):
        self.trees, self.classes_, self.feature_importances_, self.feature_names_in_ = trees, list(classes), importances, list(names)

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        out = np.zeros((len(x), len(self.classes_)))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while (live := np.flatnonzero(t["feature"][at] >= 0)).size:
                own = at[live]
                at[live] = np.where(x[live, t["feature"][own]] <= t["threshold"][own], t["left"][own], t["right"][own])
            out += t["share"][at]
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def forest_of(fitted) -> Forest:
    """The arrays of a pipeline that ``fit_classifier`` gives."""
    indexer, model = fitted.stages
    trees = []
    for tree in model.trees:
        rows: list[list] = []

        def visit(node, rows=rows) -> int:
            k = len(rows)
            stats = np.array(list(node.impurityStats().stats()), float)
            rows.append([-1, 0.0, -1, -1, stats / max(stats.sum(), 1e-300)])
            if node.subtreeDepth():
                split = node.split()
                rows[k][:2] = split.featureIndex(), split.threshold()
                rows[k][2], rows[k][3] = visit(node.leftChild()), visit(node.rightChild())
            return k

        visit(tree._java_obj.rootNode())
        trees.append({n: np.array([r[i] for r in rows]) for i, n in enumerate(("feature", "threshold", "left", "right", "share"))})
    return Forest(trees, indexer.labels, model.featureImportances.toArray())


class Calibrated:
    """A classifier whose probabilities go through a curve for each class and are made to sum to 1."""

    def __init__(self, model, curves: list[Callable[[np.ndarray], np.ndarray]]):
        self.model, self.curves, self.classes_ = model, curves, list(model.classes_)
        self.feature_importances_ = getattr(model, "feature_importances_", None)
        self.feature_names_in_ = getattr(model, "feature_names_in_", None)

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        p = self.model.predict_proba(x)
        q = np.stack([c(p[:, k]) for k, c in enumerate(self.curves)], axis=1)
        total = q.sum(axis=1, keepdims=True)
        return np.where(total > 0, q / np.maximum(total, 1e-300), p)


class Sigmoid:
    def __init__(self, slope: float, offset: float):
        self.slope, self.offset = slope, offset

    def __call__(self, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * p + self.offset, -60, 60)))


class Steps:
    """Linear between the bounds of an isotonic fit."""

    def __init__(self, at: Sequence[float], value: Sequence[float]):
        self.at, self.value = np.asarray(at, float), np.asarray(value, float)

    def __call__(self, p: np.ndarray) -> np.ndarray:
        return np.interp(p, self.at, self.value)


def _scored(rows: DataFrame, model) -> DataFrame:
    """``rows`` (features, label) with p, an array of probabilities, and predicted."""
    classes = list(model.classes_)

    @F.arrow_udf("array<double>")
    def proba(x: pa.Array) -> pa.Array:
        return pa.array(np.asarray(model.predict_proba(np.array(x.to_pylist(), float)), float).tolist() if len(x) else [], pa.list_(pa.float64()))

    scored = rows.select("features", "label", proba("features").alias("p"))
    return scored.withColumn("predicted", F.element_at(F.array(*map(F.lit, classes)), F.expr("CAST(array_position(p, array_max(p)) AS INT)")))


def calibrated(model, rows: DataFrame, method: str = "sigmoid"):
    """``model`` with curves fitted on ``rows`` (features, label) that it wasn't fitted on: sigmoid, isotonic or none."""
    if method == "none":
        return model
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"unknown calibration {method}")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    scored, curves = _scored(rows, model), []
    for k, name in enumerate(model.classes_):
        one = VectorAssembler(inputCols=["x"], outputCol="v").transform(scored.select(F.col("p")[k].alias("x"), (F.col("label") == name).cast("double").alias("y")))
        if one.agg(F.count_distinct("y")).first()[0] < 2:
            curves.append(Steps([0, 1], [0, 1]))
        elif method == "sigmoid":
            fit = LogisticRegression(featuresCol="v", labelCol="y", regParam=1e-3).fit(one)
            curves.append(Sigmoid(float(fit.coefficients[0]), float(fit.intercept)))
        else:
            fit = IsotonicRegression(featuresCol="v", labelCol="y").fit(one)
            curves.append(Steps(fit.boundaries.toArray(), fit.predictions.toArray()))
    return Calibrated(model, curves)


def load_model(path: str | None, spark: SparkSession | None = None):
    """The classifier at ``path``: a pickle, or a folder that ``write_model`` made; NoModel where there is nothing.

    Metadata beside it (name.metadata.json, or metadata.json in a folder) fills
    what the model doesn't say of itself.
    """
    if path is None or not Path(path).exists():
        warnings.warn(f"no severity model at {path}: every span is LOW", stacklevel=2)
        return NoModel()
    p = Path(path)
    if p.is_dir() and not (p / "model.pkl").is_file():
        from pyspark.ml import PipelineModel

        model, meta = forest_of(PipelineModel.load(str(p / "model"))), p / "metadata.json"
    else:
        meta = p / "metadata.json" if p.is_dir() else p.with_suffix(".metadata.json")
        with open(p / "model.pkl" if p.is_dir() else p, "rb") as f:
            model = pickle.load(f)
    try:
        metadata = json.loads(meta.read_text("utf-8")) if meta.exists() else {}
    except ValueError:
        warnings.warn(f"unreadable {meta}", stacklevel=2)
        metadata = {}
    return check_model(model, metadata)


def check_model(model, metadata: dict | None = None):
    """``model`` with classes_: other labels than LABELS or another number of features raise; other names or another version of the schema warn."""
    metadata = metadata or {}
    classes = getattr(model, "classes_", None)
    classes = metadata.get("class_labels") if classes is None else list(classes)
    if classes is None:
        raise ValueError("the model doesn't name its classes")
    if all(isinstance(c, str) for c in classes) and set(classes) != set(LABELS):
        raise ValueError(f"the model's classes are {tuple(classes)}, not {tuple(LABELS)}")
    if not all(isinstance(c, str) for c in classes):
        warnings.warn(f"the model's classes {tuple(classes)} are no labels", stacklevel=2)
    names = next((list(n) for n in (getattr(model, "feature_names_in_", None), getattr(model, "feature_names", None), metadata.get("feature_names")) if n is not None), None)
    count = getattr(model, "n_features_in_", None) if names is None else len(names)
    if count is not None and count != len(FEATURES):
        raise ValueError(f"the model was fitted on {count} features, not {len(FEATURES)}")
    if names is not None and names != list(FEATURES):
        warnings.warn("the model was fitted on features of other names", stacklevel=2)
    version = getattr(model, "schema_version", None) or metadata.get("schema_version") or SCHEMA_VERSION
    if version != SCHEMA_VERSION:
        warnings.warn(f"the model's schema is {version}, not {SCHEMA_VERSION}", stacklevel=2)
    if getattr(model, "classes_", None) is None:
        model.classes_ = list(classes)
    return model


def folds(rows: DataFrame, key: str, k: int = 3, label: str = "label", seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``, 0 to k-1, by a hash within each label; no shuffle."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col(label), F.col(key), F.lit(seed)), F.lit(k)).cast("int"))


def classification_report(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support) of each label that is true or said somewhere; from counts of pairs."""
    n = rows.groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    each = n.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).cast("bigint").alias("said"), F.col("n").alias("true")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("hit"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("true")))).alias("x")).select("x.*")
    s = each.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("said").alias("said"), F.sum("true").alias("support"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    both = F.col("said") + F.col("support")
    return s.select("label", share("hit", "said").alias("precision"), share("hit", "support").alias("recall"), F.when(both > 0, 2 * F.col("hit") / both).otherwise(0.0).alias("f1"), "support")


def cross_validate(rows: DataFrame, key: str, k: int = 3, **fit) -> list[float]:
    """Macro F1 of each fold, fitted on the others; a fold without rows or others is left out."""
    dealt, out = folds(rows, key, k), []
    for i in range(k):
        train, test = dealt.where(F.col("fold") != i), dealt.where(F.col("fold") == i)
        if train.isEmpty() or test.isEmpty():
            continue
        said = _scored(test, forest_of(fit_classifier(train.select("features", "label"), **fit)))
        out.append(float(classification_report(said).agg(F.avg("f1")).first()[0]))
    return out


def evaluate_model(model, rows: DataFrame) -> DataFrame:
    return classification_report(_scored(rows, model))

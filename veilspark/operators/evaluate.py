"""Evaluation across documents: span matching, metrics, thresholds, gates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import X
from ..functions.rules import LABELS
from ..functions.text import iou

LEAST_IOU = 0.5
STEPS = tuple(0.2 + 0.7 * i / 16 for i in range(17))


def _iou(a: dict, b: dict) -> float:
    both = max(0, min(a["end"], b["end"]) - max(a["start"], b["start"]))
    union = (a["end"] - a["start"]) + (b["end"] - b["start"]) - both
    return both / union if union > 0 else 0.0


def match_spans(found: list[dict], gold: list[dict]) -> dict:
    """One-to-one matching, greedy in the order of ``found``: tp, fp, fn and the overlaps of the matches."""
    left, ious, fp = list(gold or []), [], 0
    for p in found or []:
        best, at = 0.0, -1
        for i, g in enumerate(left):
            if g["pii_type"] == p["pii_type"] and (v := _iou(p, g)) > best:
                best, at = v, i
        if best >= LEAST_IOU:
            ious.append(best)
            del left[at]
        else:
            fp += 1
    return {"tp": len(ious), "fp": fp, "fn": len(left), "ious": ious}


def add_matches(docs: DataFrame, spans: str = "spans", gold: str = "gold", out: str = "match") -> DataFrame:
    """``docs`` with (tp, fp, fn, ious); the matching consumes gold spans, so it is a fold for each document."""
    kind = pa.struct([("tp", pa.int32()), ("fp", pa.int32()), ("fn", pa.int32()), ("ious", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<tp:int,fp:int,fn:int,ious:array<double>>")
    def match(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([match_spans(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    narrow = lambda c: F.expr(f"transform({c}, s -> named_struct('start', s.start, 'end', s.end, 'pii_type', s.pii_type))")
    return docs.withColumn(out, match(narrow(spans), narrow(gold)))


def prf(tp, fp, fn) -> tuple:
    """(precision, recall, f1) columns, 0 where undefined."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def severity_counts(spans: str = "spans") -> list:
    return [F.sum(F.expr(f"size(filter({spans}, s -> s.severity_label = '{n}'))")).alias(n) for n in LABELS]


def metrics(matched: DataFrame, spans: str = "spans", match: str = "match") -> DataFrame:
    """One row: samples, tp, fp, fn, precision, recall, f1, mean_iou, severity counts, error buckets, detector agreement."""
    m = lambda k: F.coalesce(F.sum(f"{match}.{k}"), F.lit(0))
    total = f"aggregate({match}.ious, 0D, (a, x) -> a + x)"
    sums = matched.agg(
        F.count("*").alias("samples"), m("tp").alias("tp"), m("fp").alias("fp"), m("fn").alias("fn"), F.sum(F.expr(total)).alias("iou_sum"),
        F.count_if(F.expr(f"size({match}.ious) > 0 AND {total} / size({match}.ious) < 0.7")).alias("boundary_miss"),
        F.sum(F.expr(f"size(filter({spans}, s -> size(s.sources) > 1))")).alias("multi_detector_spans"), F.sum(F.expr(f"size(filter({spans}, s -> size(s.sources) <= 1))")).alias("single_detector_spans"), *severity_counts(spans),
    )
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    mean = F.when(F.col("tp") > 0, F.col("iou_sum") / F.col("tp")).otherwise(0.0)
    return sums.select("samples", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"), mean.alias("mean_iou"), F.col("fn").alias("missed"), F.col("fp").alias("over_detect"), "boundary_miss", "multi_detector_spans", "single_detector_spans", *LABELS)


def detection_hits(found: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """``found`` rows (key, start, end, pii_type, ...) with ``ok``: whether a gold span of the type overlaps by LEAST_IOU.  Gold isn't consumed."""
    g = gold.select(F.col(key).alias("__k"), F.col("pii_type").alias("__t"), F.col("start").alias("__a"), F.col("end").alias("__b")).groupBy("__k", "__t").agg(F.collect_list(F.struct("__a", "__b")).alias("__g"))
    best = X.exists(X.col("__g"), lambda x: iou(X.col("start"), X.col("end"), x["__a"], x["__b"]) >= LEAST_IOU)
    return found.join(g, (F.col(key) == F.col("__k")) & (F.col("pii_type") == F.col("__t")), "left").withColumn("ok", F.coalesce(best.column(), F.lit(False))).drop("__k", "__t", "__g")


def threshold_f1(scored: DataFrame, thresholds: tuple[float, ...] = STEPS, keys: tuple[str, ...] = ("detector_name", "pii_type")) -> DataFrame:
    """(keys, threshold, tp, fp, fn, f1) of (keys, confidence, ok) rows.

    Rows are first counted by the number of thresholds that they reach, so the
    sweep crosses a few counts with the thresholds, not every row.
    """
    reached = sum((F.when(F.col("confidence") >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    counts = scored.groupBy(*keys, reached.alias("reached")).agg(F.count_if("ok").alias("hit"), F.count_if(~F.col("ok")).alias("miss"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)]))
    rows = counts.withColumn("s", steps).groupBy(*keys, "s.threshold").agg(
        F.sum(F.when(F.col("reached") > F.col("s.i"), F.col("hit")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("reached") > F.col("s.i"), F.col("miss")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("reached") <= F.col("s.i"), F.col("hit")).otherwise(0)).alias("fn")
    )
    return rows.withColumn("f1", prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])


def calibrate(scored: DataFrame, thresholds: tuple[float, ...] = STEPS, keys: tuple[str, ...] = ("detector_name", "pii_type")) -> DataFrame:
    """(keys, threshold, f1) of the best F1, the lowest threshold of several."""
    w = Window.partitionBy(*keys).orderBy(F.desc("f1"), "threshold")
    return threshold_f1(scored, thresholds, keys).withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, "threshold", "f1")


def adopt(best: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = ("detector_name", "pii_type"), share: float = 0.95) -> DataFrame:
    """``best`` with ``adopted``: whether its F1 is at least ``share`` of the baseline's (keys, baseline_f1)."""
    return best.join(baseline, list(keys), "left").withColumn("adopted", F.col("f1") >= F.coalesce("baseline_f1", F.lit(0.0)) * share)


def promote(candidate_f1: float, baseline_f1: float, share: float = 0.98) -> bool:
    return candidate_f1 >= share * baseline_f1


def best_overlap(labelled: DataFrame, found: DataFrame, key: str = "doc_id", least: float = 0.8) -> DataFrame:
    """``labelled`` (key, row_id, span_start, span_end) with ``best``: the found span (start, end, pii_type) of the largest overlap of at least ``least``, the first of several."""
    f = found.select(F.col(key).alias("__k"), F.struct("start", "end", "pii_type").alias("f"))
    v = iou(X.col("span_start"), X.col("span_end"), X.col("f")["start"], X.col("f")["end"]).column()
    pairs = labelled.join(f, F.col(key) == F.col("__k")).withColumn("__v", v).where(F.col("__v") >= least)
    best = pairs.groupBy("row_id").agg(F.max_by("f", F.struct("__v", -F.col("f.start"), -F.col("f.end"))).alias("best"), F.max("__v").alias("overlap"))
    return labelled.join(best, "row_id", "left")

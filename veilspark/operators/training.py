"""The training table of the severity model: a vector of features and a label for each labelled span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expr import Sql, X
from ..functions.rules import CATEGORY
from .detect import detect
from .fusion import CONTEXT, fuse
from .severity import normalise_label, span_features

LEAST_IOU = 0.8
DEFAULT_CONFIDENCE = 0.8


def _best(found: Sql, start: Sql, end: Sql) -> Sql:
    """The found span of the largest overlap of at least LEAST_IOU, the first of several, or null."""
    scored = X.transform(found, lambda f, i: X.struct(T.iou(start, end, f["start"], f["end"]).cast("double").alias("v"), (0 - i).alias("i"), f.alias("f")))
    # a map can't be compared, so the largest is sought by value and place
    near = X.filter(scored, lambda s: s["v"] >= LEAST_IOU)
    top = X.array_max(X.transform(near, lambda s: X.struct(s["v"].alias("v"), s["i"].alias("i"))))
    return X.get(X.filter(near, lambda s: (s["v"] == top["v"]) & (s["i"] == top["i"])), 0)["f"]


def training_table(rows: DataFrame, augment: bool = True) -> DataFrame:
    """(row_id, label, features) of rows as ``read_training`` gives them, with a row_id.

    Rows of one text are brought together, so that detectors run once for a text
    and neighbours are counted among its labelled spans.  Missing offsets come
    from where span_text stands, else from the first span found of the type; a
    row without either is left out.  ``augment``: a labelled span takes the type,
    detectors and scores of the found span that it overlaps most.
    """
    row = F.struct("row_id", F.col("span_start").cast("int").alias("a"), F.col("span_end").cast("int").alias("b"), "span_text", "pii_type", F.col("severity_label").cast("string").alias("severity_label"), "confidence", "sources")
    docs = rows.where("text is not null").groupBy("text").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    docs = fuse(detect(docs), out="found")
    text, found = X.col("text"), X.col("found")

    def placed(r: Sql) -> Sql:
        at = X.when(X.length(X.coalesce(r["span_text"], "")) > 0, X.instr(text, r["span_text"])).otherwise(0)
        given = r["a"].isNotNull() & r["b"].isNotNull()
        of_type = X.get(X.filter(found, lambda f: f["pii_type"] == r["pii_type"]), 0)
        start = X.when(given, r["a"]).when(at > 0, at - 1).otherwise(of_type["start"])
        end = X.when(given, r["b"]).when(at > 0, at - 1 + X.length(r["span_text"])).otherwise(of_type["end"])
        return X.struct(r.alias("r"), start.alias("start"), end.alias("end"))

    kinds = X.create_map(*[x for kv in CATEGORY.items() for x in kv])

    def span(p: Sql) -> Sql:
        r = p["r"]
        own = X.when(X.size(X.coalesce(r["sources"], X.array().cast("array<string>"))) > 0, r["sources"]).otherwise(X.array("regex"))
        sure = X.coalesce(r["confidence"], DEFAULT_CONFIDENCE).cast("double")

        def build(f: Sql) -> Sql:
            kind = X.coalesce(f["pii_type"], r["pii_type"], "OTHER")
            names = X.coalesce(f["detectors"], own)
            return X.struct(
                r["row_id"].alias("row_id"), r["severity_label"].alias("label"), p["start"].alias("start"), p["end"].alias("end"), T.piece(text, p["start"], p["end"]).alias("text"), kind.alias("pii_type"),
                X.coalesce(f["all_types"], X.array(kind)).alias("all_types"), names.alias("detectors"), X.coalesce(f["detector_scores"], X.map_from_arrays(names, X.transform(names, lambda n: sure))).alias("detector_scores"),
                X.coalesce(f["category"], X.try_element_at(kinds, kind)).alias("category"), X.coalesce(f["max_confidence"], sure).alias("max_confidence"),
                T.piece(text, X.greatest(p["start"] - CONTEXT, 0), p["start"]).alias("left_context"), X.substring(text, p["end"] + 1, CONTEXT).alias("right_context"),
            )

        match = _best(found, p["start"], p["end"]) if augment else X.get(X.slice(found, 1, 0), 0)
        return T.let(match, build)

    whole = X.filter(X.transform(X.col("rows"), placed), lambda p: (p["start"] >= 0) & (p["start"] < p["end"]))
    ready = docs.withColumn("spans", X.transform(whole, span).column()).withColumn("cuts", T.sentence_boundaries(F.col("text")))
    spans = X.col("spans")
    vectors = T.let(X.col("cuts"), lambda cuts: X.transform(spans, lambda s, i: X.struct(s["row_id"].alias("row_id"), normalise_label(s["label"]).alias("label"), span_features(text, spans, cuts, s, i).alias("features"))))
    return ready.select(F.explode_outer(vectors.column()).alias("x")).where("x is not null").select("x.*")

"""Fusion: detections of a document become ordered, disjoint spans.

Two folds in which each step reads the state left by the one before, so they run
as one Arrow function over whole arrays; only documents with detections send
their text.  ``fuse_rows`` is the fold for one document.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CATEGORY, FAMILIES, PRIORITY, TRIM, WEIGHTS

GAP, LEAST_IOU, BONUS, CONTEXT = 1, 0.1, 0.05, 80

SOURCE = "struct<pii_type:string,text:string,start:int,end:int,confidence:double,detector_name:string,pattern_id:string>"
FUSED = (
    "struct<start:int,end:int,text:string,pii_type:string,confidence:double,category:string,all_types:array<string>,all_categories:array<string>,"
    f"detectors:array<string>,detector_scores:map<string,double>,type_scores:map<string,double>,sources:array<{SOURCE}>,left_context:string,right_context:string,max_confidence:double>"
)
_SOURCE = pa.struct([("pii_type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("detector_name", pa.string()), ("pattern_id", pa.string())])
_NAMES = [f.name for f in _SOURCE]
_FUSED = pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("pii_type", pa.string()), ("confidence", pa.float64()), ("category", pa.string()), ("all_types", pa.list_(pa.string())),
    ("all_categories", pa.list_(pa.string())), ("detectors", pa.list_(pa.string())), ("detector_scores", pa.map_(pa.string(), pa.float64())), ("type_scores", pa.map_(pa.string(), pa.float64())),
    ("sources", pa.list_(_SOURCE)), ("left_context", pa.string()), ("right_context", pa.string()), ("max_confidence", pa.float64()),
]))


def _families(types: Iterable[str]) -> list:
    out = []
    for t in types:
        out += [f for f in FAMILIES if t in f]
        if t.startswith("PERSON"):
            out.append("name")
    return out


class _Open:
    """The span being built."""

    def __init__(self, d: dict):
        self.start, self.end, self.text = d["start"], d["end"], d["text"]
        self.pii_type = d["pii_type"]
        self.confidence = self.max_confidence = float(d["confidence"] or 0.0)
        self.types = {self.pii_type}
        self.category = CATEGORY.get(self.pii_type)
        self.categories = {self.category} if self.category else set()
        self.scores = {d["detector_name"]: self.confidence}
        self.sources = [d]
        self.left = self.right = ""

    def takes(self, d: dict) -> bool:
        overlap = min(self.end, d["end"]) - max(self.start, d["start"])
        if overlap <= 0 and not 0 <= d["start"] - self.end <= GAP:
            return False
        kind = d["pii_type"]
        own = _families(self.types)
        if kind in self.types or any(f in own for f in _families((kind,))):
            return True
        if overlap <= 0:
            return False
        category = CATEGORY.get(kind)
        if self.categories and category and category not in self.categories:
            return False
        union = (self.end - self.start) + (d["end"] - d["start"]) - overlap
        return overlap / union >= LEAST_IOU

    def type_scores(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for s in self.sources:
            value = float(s["confidence"] or 0.0) * WEIGHTS.get(s["detector_name"], 1.0)
            out[s["pii_type"]] = max(out.get(s["pii_type"], 0.0), value)
        return out

    def take(self, d: dict) -> None:
        self.start, self.end = min(self.start, d["start"]), max(self.end, d["end"])
        self.sources.append(d)
        self.types.add(d["pii_type"])
        self.scores[d["detector_name"]] = float(d["confidence"] or 0.0)
        by_type = self.type_scores()
        # the first of equals, as sources came
        self.pii_type = max(by_type, key=lambda t: (by_type[t], PRIORITY.get(t, 0)))
        self.category = self.category or CATEGORY.get(self.pii_type)
        if self.category:
            self.categories.add(self.category)
        top = max(self.scores.values())
        self.confidence = min(1.0, max(0.0, top + BONUS * (len(self.scores) - 1)))
        self.max_confidence = top

    def close(self, text: str | None, context: int) -> None:
        if text is None:
            return
        a, b = max(0, self.start), min(len(text), self.end)
        while a < b and text[a] in TRIM:
            a += 1
        while b > a and text[b - 1] in TRIM:
            b -= 1
        self.start, self.end, self.text = a, b, text[a:b]
        self.left, self.right = text[max(0, a - context) : a], text[b : b + context]

    def rank(self) -> tuple:
        return PRIORITY.get(self.pii_type, 0), self.confidence, max(0, self.end - self.start)

    def part(self, start: int, end: int) -> _Open | None:
        """A copy within [start, end), or None if nothing is left."""
        a, b = max(self.start, start), min(self.end, end)
        if b <= a:
            return None
        out = object.__new__(_Open)
        out.__dict__.update(self.__dict__)
        out.start, out.end, out.text = a, b, self.text[a - self.start : b - self.start]
        return out

    def row(self) -> dict:
        return {
            "start": self.start, "end": self.end, "text": self.text, "pii_type": self.pii_type, "confidence": self.confidence, "category": self.category, "all_types": sorted(self.types),
            "all_categories": sorted(self.categories), "detectors": sorted(self.scores), "detector_scores": sorted(self.scores.items()), "type_scores": sorted(self.type_scores().items()),
            "sources": [{k: s[k] for k in _NAMES} for s in self.sources], "left_context": self.left, "right_context": self.right, "max_confidence": self.max_confidence,
        }


def _disjoint(spans: list[_Open], strict_compat: bool) -> list[_Open]:
    """Where two overlap the higher (priority, confidence, length) keeps its place.

    With ``strict_compat`` the right end of a span around a stronger one is lost;
    else it stays as a span of its own, so that nothing found goes unmasked.
    """
    out: list[_Open] = []
    for s in spans:
        if not out or s.start >= out[-1].end:
            out.append(s)
            continue
        last = out[-1]
        if s.end <= last.end:
            if s.rank() > last.rank():
                left, right = last.part(last.start, s.start), last.part(s.end, last.end)
                out[-1:] = [*([left] if left else []), s, *([right] if right and not strict_compat else [])]
        elif s.rank() >= last.rank():
            left = last.part(last.start, s.start)
            out[-1:] = [*([left] if left else []), s]
        elif tail := s.part(last.end, s.end):
            out.append(tail)
    return out


def fuse_rows(detections: list[dict] | None, text: str | None, context: int = CONTEXT, strict_compat: bool = False) -> list[dict]:
    """Fused spans of one document, as rows of FUSED."""
    found = sorted((d for d in detections or [] if d["start"] < d["end"]), key=lambda d: (d["start"], d["start"] - d["end"], -float(d["confidence"] or 0.0)))
    done: list[_Open] = []
    current = None
    for d in found:
        if current is not None and current.takes(d):
            current.take(d)
            continue
        if current is not None:
            current.close(text, context)
            done.append(current)
        current = _Open(d)
    if current is not None:
        current.close(text, context)
        done.append(current)
    done.sort(key=lambda s: (s.start, s.end))
    return [s.row() for s in _disjoint(done, strict_compat)]


def fuse(docs: DataFrame, detections: str = "detections", text: str = "text", out: str = "spans", context: int = CONTEXT, strict_compat: bool = False, error: str | None = None) -> DataFrame:
    """``docs`` with ``out``, an array of FUSED; null or no detections give no spans.  Narrow.

    ``error``: a column for the message of a document whose detections can't be
    fused (a null start, say), which then has no spans; else such a one fails the job.
    """

    kind = pa.struct([("spans", _FUSED), ("error", pa.string())])

    def one(found: list[dict] | None, whole: str | None) -> dict:
        return {"spans": fuse_rows(found, whole, context, strict_compat) if found else [], "error": None}

    @F.arrow_udf(f"struct<spans:array<{FUSED}>,error:string>")
    def fold(found: pa.Array, texts: pa.Array) -> pa.Array:
        rows = list(zip(found.to_pylist(), texts.to_pylist()))
        try:
            return pa.array([one(*r) for r in rows], kind)
        except Exception:
            if error is None:
                raise
        out = []
        for r in rows:  # one by one, so that the others of the batch keep their spans
            try:
                pa.array([x := one(*r)], kind)
            except Exception as e:  # noqa: BLE001
                x = {"spans": [], "error": f"{type(e).__name__}: {e}"}
            out.append(x)
        return pa.array(out, kind)

    done = docs.withColumn("__fused", fold(F.col(detections), F.when(F.size(detections) > 0, F.col(text)))).withColumn(out, F.col("__fused.spans"))
    return (done.withColumn(error, F.col("__fused.error")) if error else done).drop("__fused")

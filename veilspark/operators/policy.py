"""Severity labels, policy decisions and redaction, all as JVM expressions over the array of spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import text as T
from ..functions.expr import Sql, X
from ..functions.masking import apply_mask
from ..functions.rules import LABELS, PLACEHOLDER, POLICY_RULES, THRESHOLDS

DECISION = "struct<action:string,rule_id:string,placeholder:string,severity_label:string,masked_text:string,mask_strategy:string,mask_args:map<string,string>>"


def severity_label(score: Sql, thresholds: Sequence[tuple[str, float, float]] = THRESHOLDS) -> Sql:
    """The label with the lowest range, both ends included, that holds the score; outside all, the highest label."""
    ordered = sorted(thresholds, key=lambda t: t[1])
    out = X.when(score.between(float(ordered[0][1]), float(ordered[0][2])), ordered[0][0])
    for name, low, high in ordered[1:]:
        out = out.when(score.between(float(low), float(high)), name)
    return out.otherwise(ordered[-1][0])


def fallback_severity(span: Sql) -> Sql:
    return X.coalesce(span["max_confidence"], 0.0)


def document_score(spans: Sql) -> Sql:
    return X.coalesce(X.array_max(X.transform(spans, lambda s: s["severity_score"])), 0.0)


def ordered_rules(rules: Sequence[dict]) -> list[dict]:
    return sorted(rules, key=lambda r: r.get("priority", 0), reverse=True)


def _placeholder(pii_type: Sql, action: dict) -> Sql:
    """None unless the action itself says MASK."""
    null = X.lit(None).cast("string")
    if action.get("decision") != "MASK":
        return null
    known = X.try_element_at(X.create_map(*[x for kv in PLACEHOLDER.items() for x in kv]), pii_type)
    if action.get("mask_strategy") == "placeholder":
        own = (action.get("mask_args") or {}).get("placeholder")
        return X.lit(own) if own else known
    return X.coalesce(known, X.concat("<", pii_type, ">"))


def matches(rule: dict, pii_type: Sql, label: Sql, labels: Sequence[str] = LABELS) -> Sql:
    """Whether an enabled rule with a decision holds; missing pii_types hold for all, an unknown least label for none."""
    if not rule.get("enabled", True) or not (rule.get("action") or {}).get("decision"):
        return X.lit(False)
    tests = []
    if least := rule.get("severity_at_least"):
        tests.append(label.isin(*labels[labels.index(least) :]) if least in labels else X.lit(False))
    if among := rule.get("severity_in"):
        tests.append(label.isin(*among))
    if types := rule.get("pii_types"):
        tests.append(pii_type.isin(*types))
    out = X.lit(True)
    for t in tests:
        out = out & t
    return out


def _decision(action: str, rule_id: str | None, placeholder: Sql, label: Sql, masked: Sql, strategy: str | None, args: dict | None) -> Sql:
    entries = [x for k, v in (args or {}).items() if v is not None for x in (k, str(v))]
    return X.struct(
        X.lit(action).alias("action"), X.lit(rule_id).cast("string").alias("rule_id"), placeholder.cast("string").alias("placeholder"), label.alias("severity_label"),
        masked.cast("string").alias("masked_text"), X.lit(strategy).cast("string").alias("mask_strategy"), X.create_map(*entries).cast("map<string,string>").alias("mask_args"),
    )


def decide(span: Sql, rules: Sequence[dict] = POLICY_RULES, labels: Sequence[str] = LABELS) -> Sql:
    """The DECISION on one span: the first rule by priority that holds, else MASK for the two highest labels and ALLOW below; a VERY_HIGH span is never allowed."""
    kind, label, text = span["pii_type"], span["severity_label"], span["text"]
    null = X.lit(None).cast("string")
    safe = label == "VERY_HIGH"
    out = None
    for r in ordered_rules(rules):
        action = r.get("action") or {}
        what = action.get("decision")
        if not what or not r.get("enabled", True):
            continue
        strategy, args = action.get("mask_strategy") or "placeholder", action.get("mask_args") or {}
        holds = matches(r, kind, label, labels)
        shown = _placeholder(kind, action)
        if what == "ALLOW":
            forced = _decision("MASK", f"{r['id']}_forced_mask" if r.get("id") else "forced_mask", null, label, null, "placeholder", {})
            out = out.when(holds & safe, forced) if out is not None else X.when(holds & safe, forced)
        one = _decision(what, r.get("id"), shown, label, apply_mask(strategy, text, args) if what == "MASK" else null, strategy, args)
        out = out.when(holds, one) if out is not None else X.when(holds, one)
    high = _decision("MASK", "default_mask_high", null, label, null, None, None)
    allow = _decision("ALLOW", "default_allow", null, label, null, None, None)
    return (out.when(label.isin("HIGH", "VERY_HIGH"), high) if out is not None else X.when(label.isin("HIGH", "VERY_HIGH"), high)).otherwise(allow)


_INSTRUCTION = "struct<start:int,end:int,replacement:string,rank:struct<severity:int,action:int,length:int,confidence:double>>"


def replacement(span: Sql) -> Sql:
    """masked_text, else the placeholder, else <TYPE>; an empty masked_text counts as none."""
    d = span["decision"]
    return X.coalesce(X.nullif(d["masked_text"], ""), d["placeholder"], X.concat("<", span["pii_type"], ">"))


def instructions(text: Sql, spans: Sql) -> Sql:
    """Disjoint (start, end, replacement, rank) of the spans to mask or block, in order.

    On overlap the higher (severity, BLOCK over MASK, length, confidence) stays,
    and the rest of the other is still covered.
    """
    n = X.length(text)
    live = X.filter(spans, lambda s: s["decision"]["action"].isin("MASK", "BLOCK") & (s["start"] < X.least(s["end"], n)))

    def one(s: Sql) -> Sql:
        level = X.when(s["decision"]["severity_label"] == "VERY_HIGH", 3).when(s["decision"]["severity_label"] == "HIGH", 2).when(s["decision"]["severity_label"] == "LOW", 0).otherwise(1)
        end = X.least(s["end"], n)
        rank = X.struct(level.alias("severity"), X.when(s["decision"]["action"] == "MASK", 1).otherwise(2).alias("action"), (end - s["start"]).alias("length"), X.coalesce(s["confidence"], 0.0).cast("double").alias("confidence"))
        return X.struct(s["start"].alias("start"), end.alias("end"), replacement(s).alias("replacement"), rank.alias("rank"))

    ordered = X.array_sort(X.transform(live, lambda s, i: X.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), one(s).alias("x"))))

    def moved(x: Sql, start: Sql, end: Sql) -> Sql:
        return X.struct(start.alias("start"), end.alias("end"), x["replacement"].alias("replacement"), x["rank"].alias("rank"))

    def step(acc: Sql, item: Sql) -> Sql:
        def join(last: Sql) -> Sql:
            x = item["x"]
            left = X.when(last["start"] < x["start"], X.array(moved(last, last["start"], x["start"]))).otherwise(X.array().cast(f"array<{_INSTRUCTION}>"))
            tail = X.when(x["end"] > last["end"], X.concat(acc, X.array(moved(x, last["end"], x["end"])))).otherwise(acc)
            over = X.concat(X.slice(acc, 1, X.size(acc) - 1), left, X.array(x))
            return X.when(last.isNull() | (x["start"] >= last["end"]), X.concat(acc, X.array(x))).when(x["rank"] > last["rank"], over).otherwise(tail)

        return T.let(X.try_element_at(acc, -1), join)

    return X.filter(X.aggregate(ordered, X.array().cast(f"array<{_INSTRUCTION}>"), step), lambda x: x["end"] > x["start"])


def redact(text: Sql, spans: Sql, strict_compat: bool = False) -> Sql:
    """``text`` with the spans replaced, in one pass from left to right.

    A segment that already is its own replacement stays; with ``strict_compat``
    it is dropped together with the text before it.
    """
    start = X.struct(X.array().cast("array<string>").alias("parts"), X.lit(0).alias("at"))

    def step(acc: Sql, x: Sql) -> Sql:
        before = T.piece(text, acc["at"], x["start"])
        full = X.struct(X.concat(acc["parts"], X.array(before, x["replacement"])).alias("parts"), x["end"].alias("at"))
        out = X.when(x["start"] < acc["at"], acc)
        if strict_compat:
            inside = X.trim(T.piece(text, x["start"], x["end"]))
            out = out.when((inside == x["replacement"]) & X.startswith(inside, "<") & X.endswith(inside, ">"), X.struct(acc["parts"].alias("parts"), x["end"].alias("at")))
        return out.otherwise(full)

    whole = X.aggregate(instructions(text, spans), start, step, lambda s: X.array_join(X.concat(s["parts"], X.array(T.piece(text, s["at"], X.length(text)))), ""))
    return X.when(X.size(spans) > 0, whole).otherwise(text)


def mask_span(text: Sql, start: Sql, end: Sql, char: str = "*") -> Sql:
    return X.concat(X.left(text, start), X.repeat(char, X.greatest(end - start, 0)), X.substring(text, end + 1, X.length(text)))


def tokenize_span(text: Sql, start: Sql, end: Sql, token: Sql) -> Sql:
    return X.concat(X.left(text, start), token, X.substring(text, end + 1, X.length(text)))


def apply_operations(text: Sql, operations: Sql) -> Sql:
    """Replace (start, end, replacement) operations from the last start to the first."""
    turned = X.reverse(X.array_sort(X.transform(operations, lambda o, i: X.struct(o["start"].alias("s"), (0 - i).alias("i"), o.alias("o")))))
    return X.aggregate(turned, text, lambda t, x: tokenize_span(t, x["o"]["start"], x["o"]["end"], x["o"]["replacement"]))


def add_severity(docs: DataFrame, spans: str = "spans", thresholds: Sequence[tuple[str, float, float]] = THRESHOLDS) -> DataFrame:
    """Spans with severity_score = max_confidence and its label, and the document's score and label."""
    fields = [f.name for f in docs.schema[spans].dataType.elementType if f.name not in ("severity_score", "severity_label")]
    with_score = X.transform(X.col(spans), lambda s: X.struct(*[s[f].alias(f) for f in fields], fallback_severity(s).alias("severity_score"), severity_label(fallback_severity(s), thresholds).alias("severity_label")))
    out = docs.withColumn(spans, with_score.column())
    out = out.withColumn("severity_score", document_score(X.col(spans)).column())
    return out.withColumn("severity_label", severity_label(X.col("severity_score"), thresholds).column())


def add_decisions(docs: DataFrame, rules: Sequence[dict] = POLICY_RULES, spans: str = "spans") -> DataFrame:
    fields = [f.name for f in docs.schema[spans].dataType.elementType if f.name != "decision"]
    return docs.withColumn(spans, X.transform(X.col(spans), lambda s: X.struct(*[s[f].alias(f) for f in fields], decide(s, rules).alias("decision"))).column())

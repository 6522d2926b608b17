"""Detectors: column expressions text -> array of detections.

A detector is a function (text, lowered) -> Sql of type DETECTIONS, or the name
of a column of that type; DETECTORS gives the order of the union.  The scan and
keyword detectors stay in the JVM; those of similarity add a column from a
vectorized model.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from contextvars import ContextVar
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expr import Sql, X
from ..functions.rules import ALLOWED, BUSINESS_TERMS, BUSINESS_TYPES, DETECTORS, KEYWORD_RULES, SCAN_RULES, KeywordRule, ScanRule
from ..functions.validators import OTHER_DIGITS, VALIDATORS, always

DETECTION = "struct<start:int,end:int,pii_type:string,ord:int,text:string,confidence:double,detector_name:string,pattern_id:string>"
DETECTIONS = f"array<{DETECTION}>"
MAX_SCAN, MIN_SPAN, MAX_SPAN = 128, 3, 64
KEYWORD_WINDOW, BUSINESS_WINDOW = 48, 32


def empty() -> Sql:
    return X.array().cast(DETECTIONS)


def detection(span: Sql, pii_type: str, confidence: float, detector: str, pattern_id: str | None, order: int) -> Sql:
    return X.struct(
        span["start"].alias("start"), span["end"].alias("end"), X.lit(pii_type).alias("pii_type"), X.lit(order).alias("ord"), span["text"].alias("text"),
        X.lit(float(confidence)).alias("confidence"), X.lit(detector).alias("detector_name"), X.lit(pattern_id).cast("string").alias("pattern_id"),
    )


def _any(text: Sql, words: Sequence[str]) -> Sql:
    out = X.lit(False)
    for w in words:
        out = out | X.contains(text, X.lit(w))
    return out


def around(text: Sql, span: Sql, window: int) -> Sql:
    a = X.greatest(span["start"] - window, X.lit(0))
    return X.substring(text, a + 1, span["end"] + window - a)


# predicates ------------------------------------------------------------------


def short_enough(span: Sql) -> Sql:
    return span["end"] - span["start"] <= MAX_SCAN


def not_allowed(span: Sql) -> Sql:
    return ~_any(X.lower(span["text"]), ALLOWED)


def keyword_gate(lowered: Sql, span: Sql, keywords: Sequence[str]) -> Sql:
    """Whether a keyword is in the text within KEYWORD_WINDOW characters of the span, itself included."""
    return _any(around(lowered, span, KEYWORD_WINDOW), [k.lower() for k in keywords])


def business_reference(lowered: Sql, span: Sql, pii_type: str, confidence: float) -> Sql:
    """Whether a financial span stands among at least two business terms, or a card number beside a product."""
    window = around(lowered, span, BUSINESS_WINDOW)
    out = X.lit(False)
    if confidence < 0.75:
        out = out | (sum((X.contains(window, X.lit(t)).cast("int") for t in BUSINESS_TERMS), X.lit(0)) >= 2)
    if pii_type == "CARD_NUMBER":
        out = out | X.contains(window, X.lit("product"))
    return out


# scan rules ------------------------------------------------------------------

#: White space, digits and letters outside ASCII that the Unicode-aware rules take for ASCII ones.
_WIDE = r"[\x{17f}\x{212a}\x{130}\x{131}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}" + "".join(f"\\x{{{ord(c):x}}}" for c in OTHER_DIGITS) + "]"
_TOKEN = re.compile(r"\\.|\(\?<!\\w\)|\(\?:|\(\?|\[\^?\]|&&|.", re.S)


def relaxed(pattern: str, bounds: bool) -> str | None:
    """An RE2 pattern found at least in each text without _WIDE characters that holds the Unicode-aware ``pattern``; None where RE2 may read it otherwise.

    RE2 looks at a text in one pass that costs the same whatever the pattern.
    It knows boundaries of ASCII words only, so ``bounds`` are for texts of ASCII.
    """
    out, inside = [], False
    for t in _TOKEN.findall(pattern):
        if t == r"\s":
            t = r"\s\x0b" if inside else r"[\s\x0b]"
        elif t == r"\b":
            if inside:
                return None
            t = t if bounds else "(?:)"
        elif t == r"(?<!\w)" and not inside:
            t = "(?:)"
        elif t[0] == "\\":
            if t[1].isalnum() and t[1] not in "dnrt":
                return None
        elif t in ("[]", "[^]", "&&") or t == "[" and inside or t in ("$", "(?") and not inside:
            return None
        elif t == "[" or t == "]" and inside:
            inside = t == "["
        out.append(t)
    found = "(?i)" + "".join(out)
    try:
        pc.match_substring_regex(pa.array([""]), found)
    except pa.ArrowInvalid:
        return None
    return found


#: Rules that gates look for at once in the texts that hold any.
GROUP = 8
_patterns: ContextVar[list[str]] = ContextVar("patterns")


def gate(pattern: str) -> Sql:
    """Whether the text that ``detect`` is at may hold ``pattern``."""
    known = _patterns.get()
    if pattern not in known:
        known.append(pattern)
    return X.array_contains(X.col("__gate")["may"], X.lit(known.index(pattern)))


def wide() -> Sql:
    """Whether Unicode-aware rules may match the text where their ASCII forms don't."""
    return X.col("__gate")["wide"]


class Gated(Sql):
    """Detections that don't read a text that passes no gate."""

    __slots__ = ()


def _passed() -> Sql:
    return X.size(X.col("__gate")["may"]) > 0


def _rules(found: Sequence[Sql]) -> Sql:
    """The union of what rules with gates found; a text that passes no gate is done after one look."""
    return Gated((X.when(_passed(), X.flatten(X.array(*found))).otherwise(empty()) if found and _patterns.get() else empty()).sql)


def gates(patterns: Sequence[str]) -> Callable:
    """A function of texts: (wide, may), where may lists the indices of the patterns that a text may hold: all, if it is wide."""
    forms = {ascii: [relaxed(p, ascii) for p in patterns] for ascii in (True, False)}
    always = [k for k, p in enumerate(forms[True]) if p is None]

    def union(own: Sequence[tuple[int, str]]) -> str:
        return "|".join(f"(?:{p})" for _, p in own)

    @F.arrow_udf("struct<wide:boolean,may:array<int>>")
    def look(texts: pa.Array) -> pa.Array:
        n = len(texts)
        plain = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
        wide = np.zeros(n, bool)
        rest = np.flatnonzero(~plain)
        wide[rest] = pc.match_substring_regex(texts.take(pa.array(rest)), _WIDE).to_numpy(zero_copy_only=False)
        may = np.zeros((n, len(patterns)), bool)
        may[wide] = True
        may[:, always] = True
        for ascii, at in ((True, np.flatnonzero(plain)), (False, np.flatnonzero(~plain & ~wide))):
            own = [(k, p) for k, p in enumerate(forms[ascii]) if p is not None]
            if not own or not len(at):
                continue
            some = texts.take(pa.array(at))
            # most texts hold none, and the others none of most groups
            for group in (own, *(own[i : i + GROUP] for i in range(0, len(own), GROUP))):
                hit = pc.match_substring_regex(some, union(group))
                held, left = at[hit.to_numpy(zero_copy_only=False)], some.filter(hit)
                if group is own:
                    at, some = held, left
                    continue
                for k, p in group:
                    may[held, k] = pc.match_substring_regex(left, p).to_numpy(zero_copy_only=False)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], may.sum(axis=1).cumsum()]).astype(np.int32), np.nonzero(may)[1].astype(np.int32))
        return pa.StructArray.from_arrays([pa.array(wide), lists], ["wide", "may"])

    # so that it stays in a step of its own: in one with a Python function of its results, Spark 4.1 leaves that function where it can't run
    return look.asNondeterministic()


def scan_rule(text: Sql, lowered: Sql, rule: ScanRule, order: int = 0, detector: str = "regex", gated: bool = False) -> Sql:
    """Detections of one rule; a rule with an unknown validator has none."""
    if rule.validator and rule.validator not in VALIDATORS:
        return empty()

    def keep(s: Sql) -> Sql:
        ok = []
        if rule.keywords:
            ok.append(keyword_gate(lowered, s, rule.keywords))
        if rule.validator and VALIDATORS[rule.validator] is not always:
            ok.append(X.coalesce(VALIDATORS[rule.validator](s["text"]), X.lit(False)))
        if rule.pii_type in BUSINESS_TYPES and (rule.confidence < 0.75 or rule.pii_type == "CARD_NUMBER"):
            ok.append(~business_reference(lowered, s, rule.pii_type, rule.confidence))
        return reduce(and_, ok) if ok else X.lit(True)

    found = T.spans(text, rule.before, rule.payload, rule.after)
    out = X.transform(X.filter(found, lambda s: short_enough(s) & not_allowed(s) & keep(s)), lambda s: detection(s, rule.pii_type, rule.confidence, detector, rule.id, order))
    some = gate(f"(?:{rule.before})(?:{rule.payload})(?:{rule.after})") if gated else X.lit(True)
    if rule.keywords:
        # letters and digits of a literal have relatives outside ASCII, so texts that hold such are looked at in any case
        held = _any(lowered, [k.lower() for k in rule.keywords])
        some = some & (held | wide()) if gated else held
    return X.when(some, out).otherwise(empty())


def scan(text: Sql, lowered: Sql, rules: Sequence[ScanRule] = SCAN_RULES, disabled: Sequence[str] = (), detector: str = "regex") -> Sql:
    """Detections of all ``rules`` but those ``disabled``, in (priority, id) order."""
    rules = sorted((r for r in rules if r.id not in disabled), key=lambda r: (r.priority, r.id))
    return _rules([scan_rule(text, lowered, r, k, detector, True) for k, r in enumerate(rules)])


# keyword rules ---------------------------------------------------------------


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in word)


def keyword_rule(text: Sql, rule: KeywordRule, order: int = 0) -> Sql:
    words = "|".join(map(_quoted, rule.keywords))
    hits = T.spans(text, r"\b", words, r"\b")
    name = "domain_heuristic"
    if rule.number is not None:
        window = max(8, rule.window)

        def near(hit: Sql) -> Sql:
            a = X.greatest(hit["start"] - window, X.lit(0))

            def inside(w: Sql) -> Sql:
                found = T.spans(w, "", rule.number, "", "(?iuU)" if rule.fold_case else "(?U)")
                moved = X.transform(found, lambda s: X.struct((s["start"] + a).alias("start"), (s["end"] + a).alias("end"), s["text"].alias("text")))
                return X.when(T.heading_like(w), X.array().cast(T.SPAN)).otherwise(X.filter(moved, lambda s: X.length(s["text"]).between(MIN_SPAN, MAX_SPAN)))

            return T.let(X.substring(text, a + 1, hit["end"] + window - a), inside)

        found = X.flatten(X.transform(hits, near))
    else:

        def after(hit: Sql) -> Sql:
            tail = X.substring(text, hit["end"] + 1, X.lit(max(0, rule.right)))
            return T.let(X.concat(hit["text"], X.substring_index(tail, "\n\n", 1)), lambda raw: T.let(T.trimmed(raw), lambda t: X.struct((hit["start"] + t["lead"]).alias("start"), (hit["start"] + t["lead"] + X.length(t["text"])).alias("end"), t["text"].alias("text"))))

        found = X.filter(X.transform(hits, after), lambda s: X.length(s["text"]).between(MIN_SPAN, MAX_SPAN) & ~T.heading_like(s["text"]))
    out = X.transform(found, lambda s: detection(s, rule.pii_type, min(1.0, max(0.0, rule.score)), name, None, order))
    return X.when(gate(rf"\b(?:{words})\b"), out).otherwise(empty())


def keyword_scan(text: Sql, lowered: Sql, rules: Sequence[KeywordRule] = KEYWORD_RULES) -> Sql:
    """Detections of all rules with keywords, in (priority, id) order."""
    rules = sorted((r for r in rules if r.keywords), key=lambda r: (r.priority, r.id))
    return _rules([keyword_rule(text, r, k) for k, r in enumerate(rules)])


# models ----------------------------------------------------------------------

#: Beyond any cosine.
MAIL_SCORE = 2.0


def _found(span: Sql, pii_type: Sql, confidence: Sql, detector: str) -> Sql:
    return X.struct(
        span["start"].alias("start"), span["end"].alias("end"), pii_type.alias("pii_type"), X.lit(0).alias("ord"), span["text"].alias("text"),
        confidence.cast("double").alias("confidence"), X.lit(detector).alias("detector_name"), X.lit(None).cast("string").alias("pattern_id"),
    )


ENTITY_TYPES = {t: t for t in ("DATE", "MONEY", "PERSON")} | dict.fromkeys(("LOC", "GPE"), "LOCATION")
_TOOLS = tuple("bitbucket git github repo".split())


def entities(text: Sql, found: Sql, confidence: float = 0.75, detector: str = "ner") -> Sql:
    """Detections of an entity model's array of (start, end, label)."""
    kind = X.create_map(*[X.lit(x) for kv in ENTITY_TYPES.items() for x in kv])
    valid = X.filter(found, lambda e: X.coalesce((e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= X.length(text)), X.lit(False)) & X.coalesce(X.map_contains_key(kind, e["label"]), X.lit(False)))
    cut = X.transform(valid, lambda e: X.struct(T.trim_span(text, e["start"], e["end"]).alias("s"), X.element_at(kind, e["label"]).alias("t")))

    def keep(x: Sql) -> Sql:
        t = x["s"]["text"]
        caps = t.rlike(r"\p{Lu}") & ~t.rlike(r"[\p{Ll}\p{Lt}]") & (X.size(T.tokens(t)) <= 3)
        return X.length(t).between(2, 80) & ~X.lower(t).isin(*_TOOLS) & ~caps & ~((x["t"] == "DATE") & t.rlike(r"(?U)^\d+$"))

    return X.transform(X.filter(cut, keep), lambda x: _found(x["s"], x["t"], X.lit(float(confidence)), detector))


_MAIL = r"\b[-+%_.A-Za-z0-9]+@[-.A-Za-z0-9]+\.[A-Za-z]{2,}\b"
_POST = r"(?i:\b[a-z]{1,2}\d[a-z\d]?\s?\d[a-z]{2}\b)"
EMBEDDING_CANDIDATES = (_MAIL, _POST, r"\b\d{4,16}\b")
TOKEN_CANDIDATES = (_MAIL, _POST, r"(?<!\d)\d{2}[\s-]?\d{2}[\s-]?\d{2}(?!\d)", r"\b\d{6,}\b")

#: Phrases that stand for a type, and thresholds of similarity.
EMBEDDING_PHRASES = {
    "EMAIL": "email address|email contact|email account", "PHONE": "phone number|mobile number|telephone number", "ADDRESS": "street address|home address|postal address",
    "PERSON": "person name|full name|individual name", "CREDENTIAL": "login password|secret key|authentication token", "CARD_NUMBER": "credit card number|debit card number",
    "BANK_ACCOUNT": "bank account number|account detail", "NI_NUMBER": "national insurance number|NINO", "NHS_NUMBER": "NHS number", "POSTCODE": "postal code|zip code",
    "NEGATIVE": "random number|generic text|identifier unrelated|miscellaneous content",
}
EMBEDDING_THRESHOLDS = dict.fromkeys("CREDENTIAL EMAIL CARD_NUMBER BANK_ACCOUNT NI_NUMBER NHS_NUMBER".split(), 0.6) | dict.fromkeys(("PHONE", "PERSON"), 0.58) | dict.fromkeys(("ADDRESS", "POSTCODE"), 0.55)
TOKEN_PHRASES = {
    "CARD_NUMBER": "16 digit card number|long card number|credit card digits", "BANK_ACCOUNT": "bank account digits|eight digit account number", "SORT_CODE": "bank sort code|sort code digits",
    "PHONE": "mobile phone digits|phone contact number", "EMAIL": "email address token|email handle", "ADDRESS": "street and house number|address line", "POSTCODE": "uk postcode token|postal code",
    "NI_NUMBER": "national insurance number|ni number", "NHS_NUMBER": "nhs service number|national health service number digits", "CREDENTIAL": "one time password code|temporary passcode|login passcode",
}
TOKEN_THRESHOLDS = {"CARD_NUMBER": 0.55, "EMAIL": 0.52, "ADDRESS": 0.45, "POSTCODE": 0.48, "CREDENTIAL": 0.48} | dict.fromkeys("BANK_ACCOUNT SORT_CODE PHONE NI_NUMBER NHS_NUMBER".split(), 0.5)


def candidates(text: Sql, patterns: Sequence[str], tokens: Sql | None = None, reach: int = 20) -> Sql:
    """Distinct (start, end) spans: ``tokens`` that hold a digit or @, with ``reach`` characters after them, then the patterns' matches."""
    found = [X.transform(T.spans(text, "", p, "", "(?U)"), lambda s: X.struct(s["start"].alias("start"), s["end"].alias("end"))) for p in patterns]
    if tokens is not None:
        some = X.filter(X.coalesce(tokens, X.array().cast("array<struct<start:int,end:int>>")), lambda t: T.piece(text, t["start"], t["end"]).rlike(r"(?U)[\d@]"))
        found.insert(0, X.transform(some, lambda t: X.struct(t["start"].cast("int").alias("start"), X.least(X.length(text), t["end"] + reach).cast("int").alias("end"))))
    return X.filter(X.array_distinct(X.concat(*found)), lambda s: s["end"] > s["start"])


def add_similar(docs: DataFrame, out: str, patterns: Sequence[str], encode: Callable[[list[str]], np.ndarray], phrases: dict[str, str], thresholds: dict[str, float], otherwise: float, detector: str, emails: bool = False, text: str = "text", tokens: str | None = None, reach: int = 20) -> DataFrame:
    """``docs`` with the column ``out`` of detections by similarity.

    Candidates are classified by cosine with ``phrases``: the best phrase's type,
    if it reaches its threshold.  ``encode`` maps texts to rows of unit length; it
    runs once for each Arrow batch, and once for the phrases in each task.
    ``tokens``: a column of (start, end) tokens, of which those with a digit or @
    are candidates, with ``reach`` characters after them.  ``emails``: a span with both @ and a dot
    is an EMAIL of 0.9, unless all phrases have zero vectors.
    """
    kinds = [k for k, v in phrases.items() for _ in v.split("|")]
    words = [p for v in phrases.values() for p in v.split("|")]
    kind = pa.list_(pa.struct([("pii_type", pa.string()), ("score", pa.float64())]))
    known: list[np.ndarray] = []  # filled in the worker, which gets this list empty

    @F.arrow_udf("array<struct<pii_type:string,score:double>>")
    def classify(texts: pa.Array) -> pa.Array:
        if not known:
            known.append(np.asarray(encode(words), np.float64))
        base, own = known[0], [t or [] for t in texts.to_pylist()]

        def judge(flat: list[str]) -> list[dict]:
            if not flat:
                return []
            s = np.asarray(encode(flat), np.float64) @ base.T
            rows = [{"pii_type": kinds[b], "score": float(s[i, b])} for i, b in enumerate(s.argmax(axis=1))]
            return [{"pii_type": "EMAIL", "score": MAIL_SCORE} if emails and base.any() and "@" in t and "." in t else r for t, r in zip(flat, rows)]

        try:
            rows = judge([t for ts in own for t in ts])
        except Exception:  # one by one, so that a document the encoder fails on has no detections and the others keep theirs
            rows, groups = [], []
            for ts in own:
                try:
                    groups.append(judge(ts))
                except Exception as e:  # noqa: BLE001
                    warnings.warn(f"{detector}: {e}", stacklevel=1)
                    groups.append([])
            return pa.array(groups, kind)
        groups, at = [], 0
        for ts in own:
            groups.append(rows[at : at + len(ts)])
            at += len(ts)
        return pa.array(groups, kind)

    whole = X.col("__text")
    cut = X.transform(candidates(whole, patterns, X.col(tokens) if tokens else None, reach), lambda s: T.trim_span(whole, s["start"], s["end"]))
    limit = X.create_map(*[x for kv in thresholds.items() for x in kv])

    def keep(p: Sql) -> Sql:
        words = p["s"]["text"]
        usual = (p["t"] != "NEGATIVE") & (p["score"] >= X.coalesce(X.try_element_at(limit, p["t"]), otherwise)) & X.length(words).between(MIN_SPAN, MAX_SPAN) & ~((p["t"] == "PERSON") & X.lower(words).isin(*_TOOLS))
        return usual | (p["score"] == MAIL_SCORE)

    pairs = X.zip_with(X.col("__cut"), X.col("__kind"), lambda s, c: X.struct(s.alias("s"), c["pii_type"].alias("t"), c["score"].alias("score")))
    found = X.transform(X.filter(pairs, keep), lambda p: _found(p["s"], p["t"], X.when(p["score"] == MAIL_SCORE, 0.9).otherwise(p["score"]), detector))
    steps = docs.withColumn("__text", T.unmarked(X.col(text)).column()).withColumn("__cut", cut.column()).withColumn("__kind", classify(F.expr("transform(__cut, s -> s.text)")))
    return steps.withColumn(out, found.column()).drop("__text", "__cut", "__kind")


def add_embedding(docs: DataFrame, encode: Callable[[list[str]], np.ndarray], thresholds: dict[str, float] | None = None, out: str = "embedding", tokens: str | None = None) -> DataFrame:
    return add_similar(docs, out, EMBEDDING_CANDIDATES, encode, EMBEDDING_PHRASES, EMBEDDING_THRESHOLDS | (thresholds or {}), 0.55, "embedding", emails=True, tokens=tokens, reach=20)


def add_ml_token(docs: DataFrame, encode: Callable[[list[str]], np.ndarray], thresholds: dict[str, float] | None = None, out: str = "ml_token", tokens: str | None = None) -> DataFrame:
    return add_similar(docs, out, TOKEN_CANDIDATES, encode, TOKEN_PHRASES, TOKEN_THRESHOLDS | (thresholds or {}), 0.48, "ml_token", tokens=tokens, reach=24)


# runner ----------------------------------------------------------------------


def first_of_each(found: Sql) -> Sql:
    """Valid detections, the first of each (type, start, end), ordered by (start, end) and then as they came."""
    valid = X.filter(found, lambda d: (d["start"] >= 0) & (d["start"] < d["end"]) & (X.length(d["text"]) == d["end"] - d["start"]))
    keyed = X.array_sort(X.transform(valid, lambda d, i: X.struct(d["start"].alias("a"), d["end"].alias("b"), d["pii_type"].alias("t"), i.alias("i"), d.alias("d"))))

    def other(x: Sql, y: Sql) -> Sql:
        return (x["a"] != y["a"]) | (x["b"] != y["b"]) | (x["t"] != y["t"])

    one = T.let(keyed, lambda k: X.filter(k, lambda x, i: (i == 0) | other(x, X.get(k, X.greatest(i - 1, X.lit(0))))))
    back = X.array_sort(X.transform(one, lambda x: X.struct(x["a"].alias("a"), x["b"].alias("b"), x["i"].alias("i"), x["d"].alias("d"))))
    return X.transform(back, lambda x: x["d"])


Detector = Callable[[Sql, Sql], Sql] | str
BUILT_IN: dict[str, Detector] = {"regex": scan, "domain_heuristic": keyword_scan}


def detect(docs: DataFrame, detectors: dict[str, Detector] | None = None, text: str = "text", out: str = "detections") -> DataFrame:
    """``docs`` with ``out``: the ordered union of the detectors' results; null texts have none.  Narrow."""
    found = detectors if detectors is not None else BUILT_IN
    names = sorted(found, key=lambda n: DETECTORS.index(n) if n in DETECTORS else len(DETECTORS))
    patterns: list[str] = []
    token = _patterns.set(patterns)
    try:
        own = [X.coalesce(X.col(f), empty()) if isinstance(f := found[n], str) else f(X.col("__text"), X.col("__low")) for n in names]
    finally:
        _patterns.reset(token)
    each = [X.when(_passed(), first_of_each(d)).otherwise(empty()) if patterns and isinstance(d, Gated) else first_of_each(d) for d in own]
    raw, whole = docs, T.unmarked(X.col(text))
    if patterns:
        raw = raw.withColumn("__gate", gates(patterns)(whole.column()))
        if all(isinstance(d, Gated) or isinstance(found[n], str) for n, d in zip(names, own)):
            # copies of the texts that the detectors don't read would cost more than the look at them
            whole = X.when(_passed(), whole).otherwise("")
    raw = raw.withColumn("__text", whole.column()).withColumn("__low", F.expr("lower(__text)"))
    return raw.withColumn(out, (X.concat(*each) if each else empty()).column()).drop("__text", "__low", "__gate")

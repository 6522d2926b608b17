"""Text primitives as column functions; offsets are 0-based, half-open, in code points."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Sql, X
from .rules import TRIM

#: Noncharacters that mark the two ends of a match while a text is being cut.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
SPAN = "array<struct<start:int,end:int,text:string>>"
_SPACE = re.compile(r"\s")
_SET = "[" + "".join("\\" + c if c in "[]\\^-" else c for c in TRIM) + "]"


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """``body(value)`` with ``value`` computed once, also where body uses it inside a lambda."""
    return X.element_at(X.transform(X.array(value), body), 1)


def unmarked(text: Sql) -> Sql:
    """``text`` of the same length without the two marks, null as empty."""
    whole = X.coalesce(text, X.lit(""))
    return X.when(whole.contains(OPEN) | whole.contains(CLOSE), X.translate(whole, OPEN + CLOSE, "\ufffd\ufffd")).otherwise(whole)


def piece(text: Sql, start: Sql, end: Sql) -> Sql:
    """text[start:end]; ``start`` isn't negative."""
    return X.substring(text, start + 1, X.greatest(end - start, X.lit(0)))


def spans(text: Sql, before: str, payload: str, after: str, flags: str = "(?iuU)") -> Sql:
    """All matches of ``before payload after``, as (start, end, text) of the payload.

    One pass marks both ends of every payload, then the text is cut at the marks;
    lengths of the parts add up to offsets.  ``text`` holds no marks.
    """
    marked = X.regexp_replace(text, X.lit(f"{flags}({before})({payload})({after})"), X.lit(f"$1{OPEN}$2{CLOSE}$3"))
    return let(marked, lambda m: X.when(X.instr(m, OPEN) > 0, _cut(m)).otherwise(X.array().cast(SPAN)))


def _cut(marked: Sql) -> Sql:
    start = X.struct(X.lit(0).alias("at"), X.lit(False).alias("inside"), X.array().cast(SPAN).alias("out"))

    def step(s: Sql, part: Sql) -> Sql:
        end = s["at"] + X.length(part)
        one = X.array(X.struct(s["at"].alias("start"), end.alias("end"), part.alias("text")))
        return X.struct(end.alias("at"), (~s["inside"]).alias("inside"), X.when(s["inside"], X.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return X.aggregate(X.split(marked, f"[{OPEN}{CLOSE}]", -1), start, step, lambda s: s["out"])


def normalize_text(text: Column) -> Column:
    """NFKC; null gives an empty text."""

    @F.arrow_udf("string")
    def nfkc(texts: pa.Array) -> pa.Array:
        return pa.array([unicodedata.normalize("NFKC", t) if t else "" for t in texts.to_pylist()], pa.string())

    return nfkc(text)


def trimmed(text: Sql) -> Sql:
    """(lead, text): characters cut off in front, and what is left."""
    lead = X.length(X.regexp_extract(text, f"^{_SET}*", 0))
    return X.struct(lead.alias("lead"), X.regexp_replace(X.regexp_replace(text, f"^{_SET}+", ""), f"{_SET}+$", "").alias("text"))


def trim_span(text: Sql, start: Sql, end: Sql) -> Sql:
    """The span (start, end, text) without TRIM characters at its edges; the bounds are clamped to the text."""
    s, e = X.greatest(start, X.lit(0)), X.least(end, X.length(text))
    return let(X.struct(s.alias("s"), trimmed(piece(text, s, e)).alias("t")), lambda x: X.struct((x["s"] + x["t"]["lead"]).alias("start"), (x["s"] + x["t"]["lead"] + X.length(x["t"]["text"])).alias("end"), x["t"]["text"].alias("text")))


def _sentences(text: str | None, delimiters: str, longest: int) -> list[tuple[int, int]]:
    if not text:
        return [(0, 0)]
    out, start = [], 0
    ends = re.finditer(f"[{re.escape(delimiters)}]", text) if delimiters else ()
    for end in [*(m.end() for m in ends), len(text) + 1]:
        while space := _SPACE.search(text, start + longest, end - 1):
            out.append((start, space.start()))
            start = space.start()
        if start < min(end, len(text)):
            out.append((start, min(end, len(text))))
        start = end
    return out


def sentence_boundaries(text: Column, delimiters: str = ".!?\n", longest: int = 500) -> Column:
    """array of (start, end): a sentence ends after a delimiter, or before white space once it is ``longest`` long."""
    if longest <= 0:
        raise ValueError("longest must be positive")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in _sentences(t, delimiters, longest)] for t in texts.to_pylist()], kind)

    return cut(text)


def short_sentences(text: Sql) -> Sql:
    """Sentences of texts in which none exceeds the limit, without leaving the JVM."""
    return X.filter(X.split(text, r"(?<=[.!?\n])", -1), lambda s: s != "")


def token_chunks(tokens: Sql, most: int, stride: int = 32) -> Sql:
    """(start, end) windows of at most ``most`` of the (start, end) ``tokens``; neighbours share ``stride``."""
    if most <= 0 or stride < 0:
        raise ValueError("most must be positive and stride not negative")
    step = max(1, most - stride) if stride < most else max(1, most - 1)
    n = X.size(tokens)
    firsts = X.sequence(X.lit(0), X.greatest(X.lit(0), X.ceil((n - most) / X.lit(step)).cast("int")))
    return X.transform(firsts, lambda i: X.struct(X.element_at(tokens, i * step + 1)["start"].alias("start"), X.element_at(tokens, X.least(n, i * step + most))["end"].alias("end")))


def tokens(text: Sql) -> Sql:
    """Runs that aren't white space."""
    return X.filter(X.split(text, r"(?U)\s+"), lambda t: t != "")


def context_window(text: Sql, start: Sql, end: Sql, window: int = 10) -> Sql:
    """``window`` tokens before the span and after it, joined by spaces."""
    before = let(tokens(piece(text, X.lit(0), start)), lambda t: X.slice(t, X.greatest(X.size(t) - (window - 1), X.lit(1)), X.lit(window)))
    after = X.slice(tokens(piece(text, end, X.length(text))), 1, window)
    return X.array_join(X.concat(before, after), " ")


def token_position_ratio(text: Sql, start: Sql) -> Sql:
    return let(X.size(tokens(text)), lambda n: X.when(n > 0, X.least(X.lit(1.0), X.size(tokens(piece(text, X.lit(0), start))) / n)).otherwise(0.0))


def sentence_context(sentences: Sql, start: Sql) -> Sql:
    """(index, offset / length) of the first sentence that holds ``start``, else (0, 0)."""
    found = X.filter(X.transform(sentences, lambda s, i: X.struct(i.alias("i"), s["start"].alias("a"), s["end"].alias("b"))), lambda s: (s["a"] <= start) & (start < s["b"]))
    first = X.get(found, X.lit(0))
    return X.struct(X.coalesce(first["i"], X.lit(0)).alias("index"), X.coalesce((start - first["a"]) / X.greatest(first["b"] - first["a"], X.lit(1)), X.lit(0.0)).alias("ratio"))


def heading_like(text: Sql) -> Sql:
    """At most 8 words, and at least 0.7 of the letters upper case."""
    letters = X.regexp_count(text, X.lit(r"\p{L}"))
    return (letters > 0) & (X.regexp_count(text, X.lit(r"\p{Lu}")) / letters >= 0.7) & (X.size(tokens(text)) <= 8)


def json_safe(value: Sql) -> Sql:
    return X.to_json(X.struct(value.alias("value")))


def iou(a0: Sql, a1: Sql, b0: Sql, b1: Sql) -> Sql:
    both = X.greatest(X.lit(0), X.least(a1, b1) - X.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - both
    return X.when(union > 0, both / union).otherwise(0.0)

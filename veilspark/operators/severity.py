"""The 130 severity features of a span, statistics over them, drift, and models that score them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from ..functions.expr import Sql, X
from ..functions.rules import CATEGORY, CONTACTS, CREDENTIALS, FINANCIAL, LABELS, PLACES

SCHEMA_VERSION = "severity_v1"
#: Detectors by feature; two names of the reference list have no detector and stay 0.
SOURCES = {"regex": "regex", "ner": "ner", "embedding": "embedding", "domain_heuristics": "domain_heuristic", "ml_token": "ml_token"}
_SCORED = "regex ner ml_ner embedding semantic domain domain_heuristic ml_token".split()
CONTEXT_WORDS = {
    "bank": "bank|branch|ifsc", "account": "account|acct|iban", "password": "passcode|password|pwd", "secret": "api key|api-key|bearer|secret|token", "otp": "one time|otp|verification code",
    "confidential": "confidential|private|sensitive", "credit": "card|credit|debit", "address": "address|avenue|road|street", "phone": "call|mobile|phone", "email": "@|email|mail",
    "health": "diagnosis|nhs|prescribed|symptom|treatment", "employment": "company|employer|job title|manager|payroll", "biometric": "face id|fingerprint|iris|voiceprint", "location": "check-in|coordinates|gps|itinerary|travel",
}
CHANNELS, SECTIONS = "email chat log other".split(), "subject body signature header".split()
TYPES = (
    "BANK_ACCOUNT SORT_CODE IBAN CARD_NUMBER CUSTOMER_ID CREDENTIAL PASSWORD PIN TOKEN API_KEY SESSION_ID EMAIL PHONE ADDRESS POSTCODE URL SOCIAL_HANDLE NI_NUMBER PASSPORT_NUMBER DRIVING_LICENSE NHS_NUMBER ORGANIZATION DATE "
    "MONEY PERSON GOV_ID MEDICAL_INFO MEDICATION DIAGNOSIS HOSPITAL HEALTH_CONTEXT IP_ADDRESS IPV6_ADDRESS MAC_ADDRESS DEVICE_ID COOKIE_ID TRACKING_ID EMPLOYER_NAME JOB_TITLE EMPLOYMENT_ID STUDENT_ID DEGREE GEO_COORDINATES "
    "TRAVEL_PLAN EVENT_CHECKIN ACTIVITY_PATTERN GENERIC_NUMBER"
).split()
CATEGORIES = "GOVERNMENT_ID CONTACT FINANCIAL BIOMETRIC AUTHENTICATION HEALTH ONLINE_DEVICE EMPLOYMENT_EDUCATION LOCATION_ACTIVITY".split()
FEATURES = [
    *(f"source_{s}" for s in SOURCES), "num_detectors", "confidence", "fused_score", *(f"{s}_detector_score" for s in ("max", "mean", "min")), *(f"{s}_score" for s in _SCORED),
    *(f"{s}_count" for s in ("digit", "alpha", "special", "whitespace")), "span_length", *(f"{s}_ratio" for s in ("digit", "alpha", "special", "whitespace")),
    *(f"has_{s}" for s in ("hyphen", "plus", "at", "special_char", "punctuation")), "is_all_digits", "is_mixed_case", "has_domain_suffix", "segment_count", *(f"embedding_{s}" for s in ("mean", "std", "norm", "max")),
    *(f"is_{s}" for s in ("financial", "credential", "contact_detail", "location_related")), "sentence_index", "sentence_position_ratio", "token_position_ratio", "context_embedding_norm", "span_context_similarity",
    "neighbor_span_count", "neighbor_high_risk_count", *(f"ctx_has_{s}" for s in CONTEXT_WORDS), *(f"context_channel_{s}" for s in CHANNELS), *(f"context_section_{s}" for s in SECTIONS),
    *(f"pii_type_{s}" for s in TYPES), *(f"pii_category_{s}" for s in CATEGORIES),
]
assert len(FEATURES) == 130
#: Cosine between labels and scores of a classifier.
LABEL_WEIGHTS = dict(zip(LABELS, (0.1, 0.5, 0.8, 1.0)))
OTHER_WEIGHT = 0.75
NEAR = 64


def flag(test: Sql) -> Sql:
    return X.when(test, 1.0).otherwise(0.0)


def char_features(text: Sql) -> dict[str, Sql]:
    """Counts and shares of character classes, and flags of shape."""
    n = X.length(text)
    count = lambda p: X.regexp_count(text, p)
    digit, alpha, space = count(r"\p{Nd}"), count(r"\p{L}"), count(r"(?U)\s")
    special = count(r"(?U)[^\p{L}\p{N}\s]")
    out = {f"{k}_count": v.cast("double") for k, v in (("digit", digit), ("alpha", alpha), ("special", special), ("whitespace", space))}
    out["span_length"] = n.cast("double")
    out |= {f"{k}_ratio": X.when(n > 0, v / n).otherwise(0.0) for k, v in (("digit", digit), ("alpha", alpha), ("special", special), ("whitespace", space))}
    out |= {"has_hyphen": flag(text.contains("-")), "has_plus": flag(text.contains("+")), "has_at": flag(text.contains("@")), "has_special_char": flag(special > 0), "has_punctuation": flag(text.rlike("[.,;:!?]"))}
    out |= {"is_all_digits": flag((digit == n) & (n > 0)), "is_mixed_case": flag(text.rlike(r"\p{Ll}") & text.rlike(r"\p{Lu}")), "has_domain_suffix": flag(X.lower(text).rlike(r"\.[a-z]{2,}$"))}
    return out | {"segment_count": X.size(X.filter(X.split(text, r"(?U)[\s,/;:]+"), lambda s: s != "")).cast("double")}


def context_flags(left: Sql, right: Sql) -> dict[str, Sql]:
    around = X.lower(X.concat_ws(" ", left, right))
    out = {}
    for name, words in CONTEXT_WORDS.items():
        test = X.lit(False)
        for w in words.split("|"):
            test = test | around.contains(w)
        out[f"ctx_has_{name}"] = flag(test)
    return out


def channel_flags(channel: Sql, section: Sql) -> dict[str, Sql]:
    """One flag of each kind, the first that holds; none without a value."""
    c, s = X.lower(X.coalesce(channel, "")), X.lower(X.coalesce(section, ""))
    kind = X.when(c.contains("email"), "email").when(c.contains("chat") | c.contains("sms"), "chat").when(c.contains("log"), "log").when(c != "", "other").otherwise("")
    part = X.when(s.contains("subject"), "subject").when(s.contains("signature"), "signature").when(s.contains("header"), "header").when(s != "", "body").otherwise("")
    return {f"context_channel_{k}": flag(kind == k) for k in CHANNELS} | {f"context_section_{k}": flag(part == k) for k in SECTIONS}


def vector_features(v: Sql, context: Sql) -> dict[str, Sql]:
    """Mean, population deviation, norm and maximum of ``v``, the norm of ``context`` and their cosine; a null is a zero."""
    zero = X.array(X.lit(0.0))
    a, b = X.coalesce(v, zero), X.coalesce(context, zero)
    total = lambda x, f: X.aggregate(x, 0.0, lambda s, e: s + f(e.cast("double")))
    n = X.size(a)
    mean = total(a, lambda e: e) / n
    norm = lambda x: X.sqrt(total(x, lambda e: e * e))
    dot = X.aggregate(X.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), 0.0, lambda s, e: s + X.coalesce(e, 0.0))
    std = X.sqrt(X.greatest(total(a, lambda e: e * e) / n - mean * mean, X.lit(0.0)))
    return {"embedding_mean": mean, "embedding_std": std, "embedding_norm": norm(a), "embedding_max": X.array_max(a).cast("double"), "context_embedding_norm": norm(b), "span_context_similarity": X.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)}


def neighbours(spans: Sql, span: Sql, index: Sql, near: int = NEAR) -> Sql:
    """(count, high-risk count) of other spans that start or end within ``near`` characters of the start or end of ``span``."""
    others = X.filter(spans, lambda o, j: (j != index) & ((X.abs(o["start"] - span["start"]) <= near) | (X.abs(o["end"] - span["end"]) <= near)))
    risky = X.array(*sorted(FINANCIAL | CREDENTIALS))
    return X.struct(X.size(others).alias("n"), X.size(X.filter(others, lambda o: X.arrays_overlap(o["all_types"], risky) | X.array_contains(risky, o["pii_type"]))).alias("risky"))


def span_features(text: Sql, spans: Sql, sentences: Sql, span: Sql, index: Sql, embedding: Sql | None = None, context_embedding: Sql | None = None, channel: Sql | None = None, section: Sql | None = None) -> Sql:
    """array<double> of FEATURES, in order."""
    null = X.lit(None)
    scores, types = span["detector_scores"], X.array_union(span["all_types"], X.array(span["pii_type"]))
    values = X.map_values(scores)
    among = lambda names: X.arrays_overlap(types, X.array(*sorted(names)))
    out: dict[str, Sql] = {f"source_{k}": flag(X.array_contains(span["detectors"], d)) for k, d in SOURCES.items()}
    out |= {"num_detectors": X.size(span["detectors"]).cast("double"), "confidence": span["max_confidence"], "fused_score": span["max_confidence"]}
    out |= {"max_detector_score": X.array_max(values), "mean_detector_score": X.aggregate(values, 0.0, lambda a, x: a + x) / X.size(values), "min_detector_score": X.array_min(values)}
    out |= {f"{d}_score": X.coalesce(X.try_element_at(scores, d), 0.0) for d in _SCORED}
    out |= char_features(span["text"])
    out |= vector_features(embedding if embedding is not None else null.cast("array<double>"), context_embedding if context_embedding is not None else null.cast("array<double>"))
    out |= {"is_financial": X.lit(0.0), "is_credential": flag(among(CREDENTIALS)), "is_contact_detail": flag(among(CONTACTS)), "is_location_related": flag(among(PLACES))}
    place = T.sentence_context(sentences, span["start"])
    near = neighbours(spans, span, index)
    out |= {"sentence_index": place["index"].cast("double"), "sentence_position_ratio": place["ratio"], "token_position_ratio": T.token_position_ratio(text, span["start"])}
    out |= {"neighbor_span_count": near["n"].cast("double"), "neighbor_high_risk_count": near["risky"].cast("double")}
    out |= context_flags(span["left_context"], span["right_context"])
    out |= channel_flags(channel if channel is not None else null.cast("string"), section if section is not None else null.cast("string"))
    out |= {f"pii_type_{t}": flag(X.array_contains(types, t)) for t in TYPES}
    by_category = {c: [t for t, k in CATEGORY.items() if k == c] for c in CATEGORIES}
    out |= {f"pii_category_{c}": flag((among(ts) if ts else X.lit(False)) | X.coalesce(span["category"] == c, False)) for c, ts in by_category.items()}
    return vector(out)


def vector(features: dict[str, Sql]) -> Sql:
    """The features in order; a missing or unknown name raises."""
    if set(features) != set(FEATURES):
        raise ValueError(f"missing {sorted(set(FEATURES) - set(features))}, unknown {sorted(set(features) - set(FEATURES))}")
    return X.array(*[X.coalesce(features[n], 0.0).cast("double") for n in FEATURES])


def add_vectors(docs: DataFrame, encode, text: str = "text", spans: str = "spans", out: str = "vectors") -> DataFrame:
    """``docs`` with ``out``: for each span (span, context), the vectors of its text and of the tokens around it; ``encode`` runs once for each Arrow batch."""

    @F.arrow_udf("array<struct<span:array<double>,context:array<double>>>")
    def embed(pairs: pa.Array) -> pa.Array:
        own = [p or [] for p in pairs.to_pylist()]
        flat = [t or "" for p in own for x in p for t in (x["a"], x["b"])]
        rows = np.asarray(encode(flat), np.float64).tolist() if flat else []
        each = iter(rows)
        kind = pa.list_(pa.struct([("span", pa.list_(pa.float64())), ("context", pa.list_(pa.float64()))]))
        return pa.array([[{"span": next(each), "context": next(each)} for _ in p] for p in own], kind)

    whole = X.coalesce(X.col(text), "")
    pairs = X.transform(X.col(spans), lambda s: X.struct(s["text"].alias("a"), T.context_window(whole, s["start"], s["end"]).alias("b")))
    return docs.withColumn("__pairs", pairs.column()).withColumn(out, embed("__pairs")).drop("__pairs")


def add_features(docs: DataFrame, text: str = "text", spans: str = "spans", out: str = "features", encode=None, channel: str | None = None, section: str | None = None) -> DataFrame:
    """``docs`` with ``out``: an array of one vector for each span.

    ``encode`` (texts -> rows) fills the features of embeddings, which are 0
    without it; ``channel`` and ``section`` name columns of a document's context.
    """
    col = X.col(spans)
    ready = docs.withColumn("__sentences", T.sentence_boundaries(F.when(F.size(spans) > 0, F.col(text))))
    if encode is not None:
        ready = add_vectors(ready, encode, text, spans, "__vectors")
    named = {k: X.col(v).cast("string") for k, v in (("channel", channel), ("section", section)) if v}

    def vectors(i: Sql) -> dict[str, Sql]:
        return {"embedding": X.get(X.col("__vectors"), i)["span"], "context_embedding": X.get(X.col("__vectors"), i)["context"]} if encode is not None else {}

    # bound outside the lambda: Spark can't extract a Python function from a lambda's body
    each = T.let(X.col("__sentences"), lambda cuts: X.transform(col, lambda s, i: span_features(X.coalesce(X.col(text), ""), col, cuts, s, i, **vectors(i), **named)))
    return ready.withColumn(out, each.column()).drop("__sentences", "__vectors")


def add_model_severity(docs: DataFrame, model, text: str = "text", spans: str = "spans", encode=None) -> DataFrame:
    """Like ``add_severity``, with a classifier: ``model.predict_proba`` over FEATURES and ``model.classes_``.

    The label is that of the largest probability and the score the weighted
    sum of probabilities (or ``model.scores`` as weights); a model of another
    number of features is refused.
    """
    names = getattr(model, "feature_names_in_", None)
    if names is not None and len(names) != len(FEATURES):
        raise ValueError("the model was fitted on other features")
    classes = [str(c) for c in model.classes_]
    weights = np.array(getattr(model, "scores", None) or [LABEL_WEIGHTS.get(c, OTHER_WEIGHT) for c in classes])
    kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64()), ("probs", pa.map_(pa.string(), pa.float64()))]))

    def predict(batches):
        for batch in batches:
            out = []
            for own in batch.column("__features").to_pylist():
                p = np.asarray(model.predict_proba(np.array(own))) if own else np.zeros((0, len(classes)))
                out.append([{"label": classes[int(q.argmax())], "score": float(q @ weights), "probs": list(zip(classes, q.tolist()))} for q in p])
            yield batch.append_column("__severity", pa.array(out, kind))

    fields = [f.name for f in docs.schema[spans].dataType.elementType if f.name not in ("severity_score", "severity_label", "severity_probs")]
    ready = add_features(docs, text, spans, "__features", encode)
    schema = T_.StructType([*ready.schema.fields, T_.StructField("__severity", T_._parse_datatype_string("array<struct<label:string,score:double,probs:map<string,double>>>"))])
    scored = ready.mapInArrow(predict, schema)
    joined = X.zip_with(X.col(spans), X.col("__severity"), lambda s, m: X.struct(*[s[f].alias(f) for f in fields], m["score"].alias("severity_score"), m["label"].alias("severity_label"), m["probs"].alias("severity_probs")))
    from .policy import document_score, severity_label

    out = scored.withColumn(spans, joined.column()).drop("__features", "__severity").withColumn("severity_score", document_score(X.col(spans)).column())
    return out.withColumn("severity_label", severity_label(X.col("severity_score")).column())


# statistics ------------------------------------------------------------------


def feature_stats(rows: DataFrame, features: str = "features", names: list[str] | None = None) -> DataFrame:
    """(feature, mean, std, min, max) over a column of vectors; std is the population's.  One pass, partial sums first."""
    names = names or FEATURES
    each = rows.select(F.posexplode(features).alias("i", "v"))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    return each.groupBy(named.alias("feature")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def drift(train: DataFrame, now: DataFrame) -> DataFrame:
    """(feature, drift): distance of the means in training deviations; a deviation of 0 counts as 1e-6."""
    a, b = train.select("feature", F.col("mean").alias("m0"), "std"), now.select("feature", F.col("mean").alias("m1"))
    std = F.when(F.coalesce("std", F.lit(0.0)) == 0, 1e-6).otherwise(F.col("std"))
    return a.join(b, "feature").select("feature", (F.abs(F.col("m1") - F.col("m0")) / std).alias("drift"))


def needs_retraining(scores: DataFrame, gate: float = 0.15) -> DataFrame:
    return scores.agg(F.max("drift").alias("max_drift"), (F.coalesce(F.max("drift"), F.lit(0.0)) >= gate).alias("retrain"))


def feature_importance(model, names: list[str] | None = None) -> dict[str, float]:
    """By name; zeros if the model has none."""
    names = names or FEATURES
    found = getattr(model, "feature_importances_", None)
    if found is None and hasattr(model, "featureImportances"):
        found = model.featureImportances.toArray()
    return dict(zip(names, map(float, found if found is not None else np.zeros(len(names)))))


def top(table: dict[str, float], k: int = 10) -> list[tuple[str, float]]:
    return sorted(table.items(), key=lambda x: -x[1])[:k]


# training --------------------------------------------------------------------


def normalise_label(raw: Sql) -> Sql:
    """A number is clamped to 0..1 and cut at 0.2, 0.6 and 0.85; a word is looked up; anything else is LOW."""
    value = X.trim(raw.cast("string"))
    n = value.try_cast("double")
    by_number = X.when(n >= 0.85, "VERY_HIGH").when(n >= 0.6, "HIGH").when(n >= 0.2, "MEDIUM").otherwise("LOW")
    word = X.upper(value)
    by_word = X.when(word.isin("CRITICAL", "VERY HIGH", "VERY_HIGH"), "VERY_HIGH").when(word.isin("HIGH", "MEDIUM"), word).otherwise("LOW")
    return X.when(n.isNotNull(), by_number).otherwise(by_word)


def dedupe_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each set of equal keys; nulls are equal."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def repair_offsets(rows: DataFrame, text: str = "text", span_text: str = "span_text", spans: str | None = None) -> DataFrame:
    """Rows with span_start and span_end filled: as given, else where span_text stands, else the first of ``spans`` (an array) of the type; rows without any go."""
    at = F.expr(f"CASE WHEN length({span_text}) > 0 THEN instr({text}, {span_text}) ELSE 0 END")
    start, end = F.col("span_start").cast("double").cast("int"), F.col("span_end").cast("double").cast("int")
    given = start.isNotNull() & end.isNotNull()
    by_type = F.expr(f"get(filter({spans}, s -> s.pii_type = pii_type), 0)") if spans else F.lit(None).cast("struct<start:int,end:int>")
    s = F.when(given, start).when(at > 0, at - 1).otherwise(by_type["start"])
    e = F.when(given, end).when(at > 0, at - 1 + F.length(span_text)).otherwise(by_type["end"])
    return rows.withColumns({"__s": s, "__e": e}).withColumns({"span_start": F.col("__s"), "span_end": F.col("__e")}).drop("__s", "__e").where("span_start is not null and span_end is not null")


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation): of every label the rows with the lowest hash of ``key``, about ``share`` of them, validate."""
    roll = F.pmod(F.xxhash64(F.col(label), F.col(key), F.lit(seed)), F.lit(1 << 30))
    held = roll < int(share * (1 << 30))
    return rows.where(~held), rows.where(held)


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(label).pivot(predicted, list(LABELS)).count().na.fill(0)


def fit_classifier(rows: DataFrame, features: str = "features", label: str = "label", trees: int = 150, depth: int = 8, seed: int = 42):
    """A Spark ML forest over balanced classes; stands in for gradient-boosted trees of a library that isn't here."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    counts = rows.groupBy(label).agg(F.count("*").alias("__c"))
    total, kinds = counts.agg(F.sum("__c"), F.count("*")).first()
    weighted = rows.join(F.broadcast(counts), label).withColumn("__w", F.lit(float(total)) / (F.lit(float(kinds)) * F.col("__c"))).withColumn("__x", array_to_vector(features))
    steps = [StringIndexer(inputCol=label, outputCol="__y"), RandomForestClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=steps).fit(weighted)



"""The corpus pipeline against its stages taken one by one, and cases planted in its rows."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import CLASH, LONG, ODD, brute
from veilspark.llm import decontaminate, packing, quality, simhash, tokens, toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage drops rows only, and the last packs exactly what the others left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "decontaminate", "pack"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids and len(now) > 0.5 * len(ids), name
        ids = now
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    got = {}
    for b in bins:
        for p in b.pieces:
            got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    want = {r.doc_id: r.n_tokens for r in packing.token_lengths(docs).where("n_tokens > 0").collect()}
    assert got == want


def by_hand(spark, folder):
    """(bins as (tokens, documents, attention), ids kept) of the pipeline, row by row in plain Python; only the two models are fitted by the library."""
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    docs, labels, schema = [r.asDict() for r in read("documents").collect()], read("labels"), read("documents").schema
    table = lambda: spark.createDataFrame([tuple(d.values()) for d in docs], schema)

    model, kept = toxicity.train(table(), labels), []
    for d in docs:
        b, _ = toxicity.terms(pa.array([d["text"]], pa.string()))
        j = [model["slot"][x] for x in b if model["slot"][x] >= 0]
        v = model["v"][j].astype(float)
        logit = model["w0"] + model["w"][j].astype(float).sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum()
        if not len(b) or logit <= model["threshold"]:
            kept.append(d)
    docs, kept = kept, []
    model = quality.train(table(), labels)
    for d in docs:
        z = np.clip((quality.statistics(pa.array([d["text"]], pa.string()))[0] - model["mean"]) / model["scale"], -6, 6)
        score = np.append(np.sqrt(2 / len(model["b"])) * np.cos(z @ model["w"] + model["b"]), 1) @ model["beta"]
        if model["value"][min(int((model["upper"] < score).sum()), len(model["value"]) - 1)] >= quality.THRESHOLD:
            kept.append(d)
    docs = kept
    sig = simhash.signatures(pa.array([d["text"] for d in docs], pa.string()))
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for k in np.flatnonzero(np.bitwise_count(sig[i] ^ sig[:i]).sum(axis=1) <= simhash.RADIUS):
            group = [group[i] if g == group[k] else g for g in group]
    hashes = {r.row: r.h for r in spark.createDataFrame([(i, d["text"]) for i, d in enumerate(docs)], "row int, text string").selectExpr("row", "xxhash64(coalesce(text, '')) h").collect()}
    first = {}
    for i, d in enumerate(docs):
        key = (d["doc_id"] is None, d["doc_id"] or 0, hashes[i])
        first[group[i]] = min(first.get(group[i], (key, i)), (key, i))
    docs = [docs[i] for _, i in sorted(first.values())]
    items = [r.text for r in read("benchmark").collect()]
    leaked = {d for d, *_ in brute([d["text"] for d in docs], items, decontaminate.SHARE)}
    docs = [d for i, d in enumerate(docs) if i not in leaked]
    most, pieces = packing.largest_piece(), []
    for d in docs:
        n = len(tokens.encoding().encode_ordinary(d["text"] or ""))
        pieces += [(-min(most, n - a), d["doc_id"] is None, d["doc_id"] or 0, a) for a in range(0, n, most)]
    full = np.array([packing.TOKENS, packing.DOCS, packing.ATTENTION], float)
    bins, scale = [], np.array(packing.WEIGHTS) / full / full
    for size, *_ in sorted(pieces):
        need = np.array([-size, 1, size * (size - 1) / 2])
        fits = [(float(r @ (need * scale)), -i) for i, r in enumerate(bins) if (r >= need).all()]
        if not fits:
            bins.append(full.copy())
        bins[-max(fits)[1] if fits else -1] -= need
    return Counter(tuple((full - r).astype(int).tolist()) for r in bins), sorted(str(d["doc_id"]) for d in docs if d["text"] and len(tokens.encoding().encode_ordinary(d["text"])))


@pytest.mark.parametrize("odd", [False, True])
def test_run_equals_plain_python(spark, tmp_path, odd):
    """``run`` over a whole folder; also with nulls, empty, long and repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    if odd:
        more = [(None if d is None else d + 50_000, t, "en", "web", 0) for d, t in ODD if t != LONG]
        docs = docs.union(spark.createDataFrame(more, docs.schema)).withColumns({c: F.lit("x") for c in CLASH})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # labels of a larger table, moved to these ids, so that the models have something to learn
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    spare = docs.where("doc_id % 3 = 0").selectExpr("doc_id", "int(doc_id % 2 = 0) quality", "int(doc_id % 4 = 0 and doc_id % 5 = 0) toxic").select(labels.columns)
    labels.union(spare).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, ids = by_hand(spark, tmp_path)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.n_tokens, r.n_docs, r.attention) for r in rows) == want and len(want) > 5
    assert sorted({str(p.doc_id) for r in rows for p in r.pieces}) == sorted(set(ids))


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_planted(spark):
    """Copies and benchmark passages go, the documents around them stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [r for r in docs.where("n_chars between 1500 and 4000").orderBy("doc_id").collect()][:20]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rng, rows = random.Random(1), []
    for k, r in enumerate(base):
        words = r.text.split(" ")
        near = " ".join(w for w in words if rng.random() > 0.02)
        rows += [(900_000 + k, r.text, r.lang, r.source, len(r.text)), (910_000 + k, near, r.lang, r.source, len(near))]
    leaked = f"Some words before. {item} And some after it."
    rows.append((920_000, leaked, "en", "web", len(leaked)))
    more = docs.union(spark.createDataFrame(rows, docs.schema))
    left = {r.doc_id for r in corpus_pipeline.near_copies(spark, more, SF).select("doc_id").collect()}
    assert not {900_000 + k for k in range(20)} & left and len({910_000 + k for k in range(20)} & left) <= 2
    assert 920_000 not in {r.doc_id for r in corpus_pipeline.decontaminate(spark, more, SF).select("doc_id").collect()}


def test_queries_equal_sql(spark):
    import duckdb
    from veilspark.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in SQL.items():
        a = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
        b = con.execute(sql).df()[list(a.columns)]
        assert sorted(map(tuple, a.values.tolist())) == sorted(map(tuple, b.values.tolist())), name

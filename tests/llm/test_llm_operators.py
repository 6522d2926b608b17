"""The ten operators: odd input, and each against brute force, a round trip or held-out labels."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from veilspark.llm import containment, decontaminate, html_blocks, language_model, licenses, packing, quality, repetition, simhash, tokens, toxicity
from veilspark.llm.codes import words

SF = "/root/testdata/sf0.001"
CLASH = "y __y held __id __d __h __n __same sig node k score toxic good label group_id keep_id text_hash n_tokens start".split()
LONG = "alpha beta gamma delta " * 40_000


def docs_of(spark, rows, clash=False):
    schema = "doc_id bigint, text string, lang string" + "".join(f", {c} string" for c in CLASH if clash)
    return spark.createDataFrame([(d, t, "en") + tuple("x" for c in CLASH if clash) for d, t in rows], schema)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


ODD = [(1, None), (2, ""), (3, "one"), (4, "   \n\t "), (5, "same text here"), (5, "same text here"), (None, "same text here"), (None, None), (6, LONG), (7, "ünïcödé 🙂 текст 文字"), (8, "!!! ??? ..."), (9, "a\u0000b ퟿"), (10, "x" * 200_000)]

OPERATORS = {
    "toxicity": lambda d, l, b: toxicity.toxicity(d, l), "quality": lambda d, l, b: quality.quality(d, l), "licenses": lambda d, l, b: licenses.license_scan(d), "tokens": lambda d, l, b: tokens.token_store(d),
    "repetition": lambda d, l, b: repetition.quality_rules(d), "lm": lambda d, l, b: language_model.lm_scores(d), "near": lambda d, l, b: simhash.near_copies(d), "packing": lambda d, l, b: packing.packing(d),
    "leaks": lambda d, l, b: decontaminate.decontaminate(d, b), "drop_toxic": lambda d, l, b: toxicity.drop_toxic(d, l), "drop_bad": lambda d, l, b: quality.drop_bad(d, l), "drop_copies": lambda d, l, b: simhash.drop_copies(d), "drop_leaks": lambda d, l, b: decontaminate.drop_leaks(d, b),
}
PER_ROW = {"toxicity", "quality", "repetition", "lm", "near"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_input(spark, name):
    """Nulls, empty, long and repeated rows, columns with clashing names; a row for each where the result is by row."""
    docs = docs_of(spark, ODD, clash=True)
    labels = labels_of(spark, [(1, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (99, None, None), (6, 1, 0), (8, 0, 0)])
    bench = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (None, "one"), (2, None), (3, "")], "item_id bigint, text string")
    got = OPERATORS[name](docs, labels, bench).collect()
    if name in PER_ROW:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in ODD)
    if name == "drop_copies":
        assert len([r for r in got if r.text in (None, "")]) == 1 and len([r for r in got if r.text == "same text here"]) == 1
    if name == "drop_leaks":
        assert not [r for r in got if r.text in ("same text here", "one")] and len([r for r in got if not (r.text or "").strip()]) == 4
    if name.startswith("drop"):
        assert all(set(r.asDict()) == set(docs.columns) for r in got)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    docs, labels = docs_of(spark, []), labels_of(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert OPERATORS[name](docs, labels, bench).count() == 0
    if name not in ("tokens", "packing"):  # no labels or items: nothing is rejected
        kept = OPERATORS[name](docs_of(spark, [(1, "a b c"), (2, "d e f g")]), labels, bench).collect()
        assert len(kept) == (0 if name in ("licenses", "leaks") else 2)


# 1, 2 ------------------------------------------------------------------------


@pytest.mark.parametrize("rule", [lambda a, b: a and b, lambda a, b: a != b, lambda a, b: a == b], ids=["and", "xor", "xnor"])
@pytest.mark.parametrize("shares", [(0.4, 0.4), (0.5, 0.5)], ids=str)
def test_toxicity_learns_pairs(rule, shares):
    """Pairs of which neither term has a weight of its own (xor, xnor) as well as those of which both have."""
    rng = random.Random(1)
    texts, y = [], []
    for _ in range(6000):
        a, b = rng.random() < shares[0], rng.random() < shares[1]
        texts.append(" ".join(rng.choices([f"w{i}" for i in range(200)], k=12) + ["idiot"] * a + ["groupname"] * b))
        y.append(float(rule(a, b)))
    b, o = toxicity.terms(pa.array(texts))
    y, held = np.array(y), np.arange(6000) % 5 == 0
    model = toxicity.fit(b, o, y, held)
    said = toxicity.logits(model, b, o) > model["threshold"]
    assert (said[held] == (y[held] > 0)).mean() > 0.95


def test_toxicity_without_evidence_keeps_no_terms():
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=30)) for _ in range(3000)]
    b, o = toxicity.terms(pa.array(texts))
    y = np.array([float(rng.random() < 0.1) for _ in texts])
    assert len(toxicity.fit(b, o, y, np.arange(3000) % 5 == 0)["w"]) <= 9  # 3 deviations, 300 terms


def test_toxicity_logit_by_pairs():
    """The logit is the sum over terms and over all pairs of terms."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{i}" for i in rng.integers(0, 40, k)) for k in (0, 1, 2, 5, 40, 200)]
    b, o = toxicity.terms(pa.array(texts))
    known = np.unique(b)[::2]
    slot = np.full(1 << toxicity.BITS, -1, np.int32)
    slot[known] = np.arange(len(known))
    model = {"slot": slot, "w": rng.normal(size=len(known)), "v": rng.normal(size=(len(known), 8)), "w0": -1.5}
    for i, got in enumerate(toxicity.logits(model, b, o)):
        j = [slot[x] for x in b[o[i] : o[i + 1]] if slot[x] >= 0]
        assert got == pytest.approx(-1.5 + sum(model["w"][x] for x in j) + sum(model["v"][x] @ model["v"][y] for n, x in enumerate(j) for y in j[:n]))


def test_pair_gradients():
    """Terms flagged are those of a brute-force search over all pairs, whatever the size of a block."""
    rng = np.random.default_rng(4)
    x = rng.random((900, 40)) < 0.3
    err = np.where(x[:, 3] != x[:, 7], 0.6, -0.6) * (rng.random(900) < 0.8) + rng.normal(0, 0.1, 900)
    s, offsets = np.concatenate([np.flatnonzero(r) for r in x]), np.concatenate([[0], np.cumsum(x.sum(axis=1))])
    e2 = (err * err).astype(np.float32).astype(float)
    want = np.zeros(40, bool)
    for a in range(40):
        for b in range(40):
            both = x[:, a] & x[:, b]
            g, h = err[both].sum(), e2[both].sum()
            left, right = (g - h * err[x[:, k]].sum() / e2[x[:, k]].sum() for k in (a, b))
            want[[a, b]] |= a != b and min(abs(left), abs(right)) > max(toxicity.PAIR_L1, toxicity.PAIR_SIGMAS * h**0.5) and left * right > 0
    old = toxicity.BLOCK
    try:
        for toxicity.BLOCK in (7, 1024):
            got = toxicity.pairs_beyond_chance(s, offsets, np.arange(900), err, 40)
            assert (got == want).all() and want[[3, 7]].all()
    finally:
        toxicity.BLOCK = old


def test_held_out_labels(spark):
    """Trained on the labels, toxicity and quality reject few clean rows and find most others."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").groupBy("doc_id").agg({"toxic": "max", "quality": "max"}).toDF("doc_id", "t", "q")
    t = toxicity.toxicity(docs, even).join(odd, "doc_id").toPandas()
    hit, clean = t[t.t == 1].toxic.mean(), t[t.t == 0].toxic.mean()
    assert hit > 0.7 and clean < 0.01
    q = quality.quality(docs, even).join(odd, "doc_id").toPandas()
    assert q[q.q == 1].good.mean() > 0.9 and q[q.q == 0].good.mean() < 0.3


def test_quality_brute(spark):
    """Ridge weights and probabilities against one solve over all rows at once, with statistics counted in plain Python."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    label = {}
    for r in labels.where("doc_id is not null and quality is not null").collect():
        label[r.doc_id] = max(label.get(r.doc_id, 0), r.quality)
    rows = labelled_rows(spark, docs, label)
    x = np.array([r.x for r in rows])
    y, held = np.array([r.y for r in rows], float), np.array([r.held for r in rows])
    assert len(rows) == len({r.doc_id for r in docs.select("doc_id").collect()} & set(label))
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -6, 6)
    z = np.concatenate([np.sqrt(2 / quality.FEATURES) * np.cos(z @ model["w"] + model["b"]), np.ones((len(z), 1))], axis=1)
    beta = np.linalg.lstsq(np.concatenate([z[~held], np.sqrt(quality.RIDGE) * np.eye(z.shape[1])]), np.concatenate([y[~held], np.zeros(z.shape[1])]), rcond=None)[0]
    assert z @ beta == pytest.approx(z @ model["beta"], abs=1e-5)
    # the features imitate a Gaussian kernel
    a, b = z[:200, :-1], np.clip((x[:200] - model["mean"]) / model["scale"], -6, 6)
    kernel = np.exp(-((b[:, None] - b[None]) ** 2).sum(axis=2) / 2 / x.shape[1])
    assert np.abs(a @ a.T - kernel).mean() < 0.06
    # calibration: of all non-decreasing step functions none is nearer to the held-out labels
    order = np.argsort((z @ model["beta"])[held], kind="stable")
    fitted = quality.predict(model, x[held])[order]
    assert (np.diff(fitted) >= -1e-12).all() and fitted.mean() == pytest.approx(y[held].mean())
    best = [max(min(np.mean(y[held][order][i : j + 1]) for j in range(k, len(order))) for i in range(k + 1)) for k in range(0, len(order), max(1, len(order) // 12))]
    assert fitted[:: max(1, len(order) // 12)] == pytest.approx(best, abs=1e-9)


def labelled_rows(spark, docs, label):
    from pyspark.sql import functions as F
    from veilspark.llm.common import labelled

    @F.arrow_udf("array<double>")
    def describe(text: pa.Array) -> pa.Array:
        return pa.array(list(quality.statistics(text)), pa.list_(pa.float64()))

    return labelled(docs, spark.createDataFrame([(k, v, 0) for k, v in label.items()], "doc_id bigint, quality int, toxic int"), "quality", quality.SAMPLE, describe).collect()


def test_quality_statistics():
    """The statistics of a text, counted one by one."""
    text = "Hello WORLD, this is a #tag! 42 apples | {x}\nsame line here\nsame line here\nextraordinarily long wordings."
    w = ["hello", "world", "this", "is", "a", "tag", "42", "apples", "x", *["same", "line", "here"] * 2, "extraordinarily", "long", "wordings"]
    n = len(text)
    got = dict(zip(quality.STATS, quality.statistics(pa.array([text]))[0]))
    want = {
        "log_words": np.log1p(len(w)), "word_chars": np.mean(list(map(len, w))), "upper_share": sum(c.isupper() for c in text) / n, "digit_share": 2 / n, "punct_share": 3 / n, "symbol_share": 4 / n, "space_share": sum(c.isspace() for c in text) / n,
        "distinct_share": len(set(w)) / len(w), "top_word_share": 2 / len(w), "repeat_bigram_share": 1 - len(set(zip(w, w[1:]))) / (len(w) - 1), "log_line_chars": np.log1p(n / 4), "repeat_line_share": 0.25, "exclaim_per_word": 1 / len(w), "hash_per_word": 1 / len(w),
        "pipe_per_word": 1 / len(w), "long_word_share": 1 / len(w), "short_word_share": sum(len(x) < 4 for x in w) / len(w), "sentence_words": len(w) / 2, "upper_word_share": 1 / len(w), "brace_per_word": 2 / len(w),
    }
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_isotonic():
    upper, value = quality.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert list(upper) == [1, 3, 4] and list(value) == [0, 0.5, 1] and (np.diff(value) >= 0).all()


# 3, 10 -----------------------------------------------------------------------


def brute(texts, items, share, size=3):
    """(text, item, first, matched, runs) by looking at every window."""
    split = lambda t: [w.text(i, i + 1) for w in [words(pa.array([t or ""]))] for i in range(len(w.code))]
    runs = lambda w: [" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))]
    out = []
    for d, t in enumerate(texts):
        own = runs(split(t))
        for i, item in enumerate(items):
            w = split(item)
            s = set(runs(w))
            reach = max(0, len(w) - size)
            best = max(((len({r for r in own[p : p + reach + 1] if r in s}), -p) for p in range(len(own)) if own[p] in s), default=(0, 0))
            if s and best[0] >= max(1, int(np.ceil(share * len(s) - 1e-9))):
                out.append((d, i, -best[1], best[0], len(s)))
    return sorted(out)


def mutated(rng, text, share):
    return " ".join(rng.choice(["zz", w + "q"]) if rng.random() < share else w for w in text.split())


def test_decontamination_brute(spark):
    rng = random.Random(5)
    items = [" ".join(rng.choices([f"v{i}" for i in range(60)], k=k)) for k in (1, 2, 3, 5, 12, 30, 80)] + ["v1 v1 v1 v1 v1 v1"]
    texts = [" ".join([" ".join(rng.choices([f"v{i}" for i in range(60)], k=40)), mutated(rng, rng.choice(items), rng.choice([0, 0.05, 0.1, 0.3])), "tail here"]) for _ in range(150)] + ["", None, "v1", "v1 v1 v1 v1"]
    got = decontaminate.decontaminate(docs_of(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == brute(texts, items, decontaminate.SHARE)
    small = decontaminate.decontaminate(docs_of(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"), block=20).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, got))


def test_license_brute(spark):
    rng = random.Random(6)
    names, items = list(licenses.TEMPLATES), list(licenses.TEMPLATES.values())
    texts = [" ".join([*rng.choices(["the", "of", "software", "license", "a", "free"], k=rng.randint(0, 90)), mutated(rng, rng.choice(items), rng.choice([0, 0, 0.03, 0.1])), *rng.choices(["and", "or", "is"], k=50)]) for _ in range(250)]
    got = {(r.doc_id, r.license) for r in licenses.license_scan(docs_of(spark, list(enumerate(texts)))).collect()}
    want = {(d, names[i]) for d, i, *_ in brute(texts, items, licenses.SHARE)}
    own = {"long": " ".join(f"l{i}" for i in range(700)), "short": "a b c d", "none": ""}
    mine = licenses.license_scan(docs_of(spark, [(1, f"x {own['long']} y a b c d"), (2, own["long"][:2000]), (3, texts[0])]), templates=own).collect()
    assert {(r.doc_id, r.license) for r in mine} == {(1, "long"), (1, "short")} and {"mit-full", "bsd-3-clause-full"} <= {k for _, k in got}
    assert got <= want and len(got) >= 0.99 * len(want) and licenses.collision(licenses.LEAST) > 0.998


# 4, 9 ------------------------------------------------------------------------


def test_every_license_line(spark):
    """The bare notice too, in any place, and each license line of the tables."""
    rng = random.Random(7)
    fill = [f"word{i}" for i in range(500)]
    texts = ["All rights reserved.", "© 2020 ACME. all rights reserved"] + [" ".join([*rng.choices(fill, k=rng.randint(0, 60)), "All rights reserved.", *rng.choices(fill, k=rng.randint(0, 60))]) for _ in range(300)]
    got = licenses.license_scan(docs_of(spark, list(enumerate(texts)))).where("license = 'all-rights-reserved-notice'")
    assert sorted(r.doc_id for r in got.collect()) == list(range(len(texts)))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = {"all-rights-reserved-notice": "all rights reserved", "apache-2.0-short": "licensed under the apache license, version 2.0", "mit-short": "released under the mit license", "gpl-3.0-short": "this work is licensed under the gnu general public license, version 3", "cc-by-nc-4.0": "licensed under cc by-nc 4.0"}
    found = {(r.doc_id, r.license) for r in licenses.license_scan(docs).collect()}
    want = {(r.doc_id, k) for r in docs.collect() for k, v in lines.items() if r.text and v in r.text.lower()}
    assert want and want <= found


def test_token_store_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(docs_of(spark, ODD).select("doc_id", "text"))
    enc = tokens.encoding()
    want = sorted((str(r.doc_id), enc.encode_ordinary(r.text or "")) for r in docs.collect())
    got, bits, n = [], 0, 0
    for s in tokens.token_store(docs, shard_tokens=20_000).collect():
        shard = s.asDict() | {k: bytes(s[k]) for k in ("ids", "low", "high", "samples")}
        got += [(str(d), tokens.document(shard, i).tolist()) for i, d in enumerate(s.doc_ids)]
        bits += 8 * (len(s.low) + len(s.high) + len(s.samples))
        n += s.n_docs
    assert sorted(got) == want and bits < 32 * n + 1000


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 9], list(range(0, 100_000, 97)), [0] * 200 + [10**9]])
def test_select(values):
    shard = tokens.elias_fano(np.array(values)) | {"n_docs": len(values) - 1}
    assert [tokens.select(shard, i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        tokens.select(shard, len(values))


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_packing(spark, rule):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 1, 7, 300, 2000, 4096, 20_000]) for i in range(400)}
    bins = packing.pack_lengths(spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint"), rule=rule, group=200).collect()
    seen = {}
    for b in bins:
        assert b.n_tokens <= packing.TOKENS and b.n_docs <= packing.DOCS and b.attention <= packing.ATTENTION
        assert b.n_tokens == sum(p.length for p in b.pieces) and b.n_docs == len(b.pieces)
        for p in b.pieces:
            seen.setdefault(p.doc_id, []).append((p.start, p.start + p.length))
    for d, n in sizes.items():
        ends = sorted(seen.get(d, []))
        assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]][: len(ends)] and (ends[-1][1] if ends else 0) == n
    assert len({(b.pack_group, b.bin) for b in bins}) == len(bins)


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_pack_is_best_fit(rule):
    """Piece by piece the bin is the open one with the best score."""
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 900, 300))[::-1]
    cap = (1000, 5, 300_000)
    got = packing.pack(lengths, cap, rule=rule)
    rooms, scale = [], np.array(packing.WEIGHTS) / np.square(np.array(cap, float))
    for n, b in zip(lengths, got):
        need = np.array([n, 1, n * (n + 1) / 2])
        fits = [(float(r @ (need * scale)) if rule == "dot" else -float(((r - need) ** 2) @ scale), i) for i, r in enumerate(rooms) if (r >= need).all()]
        if b == len(rooms):
            assert not fits
            rooms.append(np.array(cap, float))
        else:
            assert dict((i, s) for s, i in fits)[b] == pytest.approx(max(fits)[0])
        rooms[b] = rooms[b] - need


def test_packing_spreads_one_id(spark):
    """Rows without an id, or of one id, fill groups of the usual size."""
    bins = packing.pack_lengths(spark.createDataFrame([(None if i % 2 else 7, 100) for i in range(3000)], "doc_id bigint, n_tokens bigint"), group=300).collect()
    size = Counter()
    for b in bins:
        size[b.pack_group] += b.n_docs
    assert len(size) == 10 and max(size.values()) < 450 and sum(size.values()) == 3000


# 5, 6, 7 ---------------------------------------------------------------------


def repeats(text, least):
    """(covered unit positions, longest) by comparing every pair of places."""
    u = text.split()
    n, longest, mark = len(u), 0, set()
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and u[i + k] == u[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                mark |= {*range(i, i + k), *range(j, j + k)}
    return mark, longest


def test_repetition_brute():
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 60))) for _ in range(60)] + ["a " * 50, "", "x y z " * 20 + "end"]
    got = repetition.repetition(pa.array(texts), 4)
    for i, t in enumerate(texts):
        mark, longest = repeats(t, 4)
        u = t.split()
        assert got["longest"][i] == longest and got["covered"][i] == pytest.approx(sum(len(u[k]) for k in mark) / max(1, sum(map(len, u))))


def units_of(text):
    """Runs without white space, characters of unspaced scripts apart."""
    import regex

    return regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\s\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+", text)


def maximal_repeats(u, least):
    """Distinct runs of at least ``least`` units that occur twice and can't be longer on either side, by listing all runs."""
    n, out = len(u), 0
    for size in range(least, n):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(u[i : i + size]), []).append(i)
        for at in places.values():
            before, after = [u[i - 1] if i else (i,) for i in at], [u[i + size] if i + size < n else (i,) for i in at]
            out += len(at) > 1 and len(set(before)) > 1 and len(set(after)) > 1
    return out


def test_repetition_units():
    """Long tokens, links and scripts without spaces against the same brute force."""
    rng = random.Random(9)
    filler = " ".join(f"w{i}" for i in range(30))
    links = [f"https://example.org/some/rather/long/path/of/a/page/with/an/id-{i:06d}.html" for i in range(2)]
    han = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(120))
    texts = [f"{filler} {links[0]} {links[1]}", han, han[:40] + han[:40] + han[60:], "日本語 text テスト " * 6, "x" * 5000, "x" * 300 + " y " + "x" * 300, " ".join(rng.choices("ab", k=70)), "a\u3000b\u00a0c " * 9]
    texts += [" ".join(rng.choices("abc", k=rng.randint(0, 50))) for _ in range(40)]
    got = repetition.repetition(pa.array(texts), 8)
    for i, t in enumerate(texts):
        u = units_of(t)
        mark, longest = set(), 0
        for a in range(len(u)):
            for b in range(a + 1, len(u)):
                k = 0
                while b + k < len(u) and u[a + k] == u[b + k]:
                    k += 1
                if k >= 8:
                    longest, mark = max(longest, k), mark | {*range(a, a + k), *range(b, b + k)}
        size = [len(x.encode()) for x in u]
        assert got["units"][i] == len(u) and got["longest"][i] == longest and got["covered"][i] == pytest.approx(sum(size[k] for k in mark) / max(1, sum(size))), t[:60]
        assert got["repeats"][i] == maximal_repeats(u, 8), t[:60]
    assert got["covered"][0] == got["covered"][1] == 0 and got["covered"][2] > 0.5


def test_words_equal_sql():
    """Words are those of the SQL's regular expression, whatever the script."""
    import duckdb
    from veilspark.llm.codes import sql_words

    rng = random.Random(3)
    marks = ["’", "—", "。", "，", "\u00a0", "\u3000", "¿", "«", "é", "ß", "文", "字", "テ", "ก", "ั", "🙂", "𠀀", "a", "B", "9", "_", " ", "\n", "-", "。", "中", "ﾃ", "ｱ", "！", "Ａ", "ー"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(500)] + [None, ""]
    want = duckdb.execute(f"SELECT regexp_extract_all(lower(coalesce(x, '')), '{sql_words()}') FROM (SELECT unnest(?) AS x)", [texts]).fetchall()
    w = words(pa.array(texts))
    assert [[w.text(i, i + 1) for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))] == [x for (x,) in want]


def test_lm_gradients_and_windows():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language_model.initial().items()}
    y = rng.integers(0, language_model.VOCABULARY - 1, (5, 3))
    x = np.concatenate([np.full((1, 3), language_model.START), y[:-1]])
    live, h = np.ones((5, 3), bool), np.zeros((3, language_model.HIDDEN))
    g, _, loss = language_model.gradients(p, x, y, live, h)
    assert language_model.gradients(p, x, y, live, h, True)[2] == pytest.approx(loss)
    kind = int(y[1, 2]) // language_model.CLASS_SIZE
    for name, at in (("wh", (2, 5)), ("wx", (3, 40)), ("b", (7,)), ("wc", (4, 1)), ("e", (int(x[2, 1]), 3)), ("bc", (kind,)), ("bo", (kind, int(y[1, 2]) % language_model.CLASS_SIZE)), ("wo", (kind, 5, int(y[1, 2]) % language_model.CLASS_SIZE))):
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][at] += 1e-5
        assert (language_model.gradients(moved, x, y, live, h)[2] - loss) / 1e-5 / 15 == pytest.approx(g[name][at], rel=2e-2, abs=1e-6)
    ids, first = rng.integers(0, 2000, 150).astype(np.int16), np.array([0, 70, 70, 150])
    p32 = language_model.initial()
    got = language_model.score(p32, ids, first)
    for i in range(3):
        own, h, total = ids[first[i] : first[i + 1]], np.zeros((1, language_model.HIDDEN), np.float32), 0.0
        for t, w in enumerate(own):
            prev = own[t - 1] if t else language_model.START
            h = language_model._step(p32["e"][[prev]] @ p32["wx"] + p32["b"], h, p32["wh"])[0]
            a = h[0] @ p32["wc"] + p32["bc"]
            c = int(w) // language_model.CLASS_SIZE
            b = h[0] @ p32["wo"][c] + p32["bo"][c]
            total += a[c] - np.log(np.exp(a).sum()) + b[int(w) % language_model.CLASS_SIZE] - np.log(np.exp(b).sum())
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_lm_training_by_hand(spark, monkeypatch):
    """Weights of a round are the mean over tasks, weighted by words, of one pass each; each span takes part once."""
    monkeypatch.setattr(language_model, "TASK_SPANS", 4)
    rng = random.Random(2)
    docs = docs_of(spark, [(i, " ".join(rng.choices([f"v{k}" for k in range(50)], k=rng.randint(1, 400)))) for i in range(12)])
    vocab = language_model.vocabulary(language_model.gather(docs))
    rows = language_model.spans(docs, vocab)
    total = rows.count()
    tasks = -(-total // 4)
    parts = [[(r.roll, np.frombuffer(r.ids, np.int16)) for r in p] for p in rows.repartition(tasks, "roll").rdd.glom().collect()]
    p, past, used = language_model.initial(), None, 0
    for number, rate in enumerate(language_model.RATES):
        done = []
        for part in parts:
            own = [s for roll, s in sorted(part, key=lambda x: x[0]) if (roll >> 7) % language_model.ROUNDS == number]
            used += len(own)
            if own:
                done.append(language_model.fit_spans(p, own, rate, number, past)[:3])
        if done:
            n = np.array([d[2] for d in done], float)
            p, past = ({k: sum(d[j][k] * (w / n.sum()) for d, w in zip(done, n)).astype(np.float32) for k in p} for j in (0, 1))
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)  # a task for each file
    try:
        got = language_model.train(docs)["p"]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert used == total and all(np.allclose(got[k], p[k], atol=2e-4) for k in p)


def test_lm_knows_what_occurs_twice(spark):
    """Of texts of words found nowhere else, those that occur twice score far above those that occur once."""
    rng = random.Random(6)
    made = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    common = [made() for _ in range(2500)]
    rows = [" ".join(rng.choices(common, k=120)) for _ in range(300)]
    once, twice = ([" ".join([*rng.choices(common, k=90), *(made() for _ in range(30))]) for _ in range(40)] for _ in range(2))
    docs = docs_of(spark, list(enumerate(rows + once + twice + twice)))
    got = {r.doc_id: r.log_likelihood / r.n_words for r in language_model.lm_scores(docs).collect()}
    assert max(got[i] for i in range(300, 340)) < min(got[i] for i in range(340, 420))


def test_lm_trains_on_every_span(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(200)) for i in range(8)]
    model = language_model.train(docs_of(spark, list(enumerate(texts))))
    start = language_model.initial()["e"]
    used = np.concatenate([np.setdiff1d(range(200), [127, 199]) + 200 * i for i in range(8)])  # the last word of a span is never an input
    ids = language_model.token_ids(words(pa.array(texts)).code[used], model["vocab"])
    assert (model["p"]["e"][ids] != start[ids]).any(axis=1).all()


def test_lm_scores_each_word(spark):
    """Words of one id aren't alike: P(word | id) sums to 1 over listed words, and falls for unseen strings."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(1984)]
    tail = [f"t{i}" for i in range(300)]
    texts = [" ".join(common)] * 3 + [" ".join(rng.choices(tail, k=400)) for _ in range(4)] + [" ".join(tail)] * 2  # each at least twice
    model = language_model.train(docs_of(spark, list(enumerate(texts))))
    ids, inside = language_model.word_ids(words(pa.array([" ".join(common + tail)])), model["vocab"])
    for k in set(ids):
        assert np.exp(inside[ids == k]).sum() == pytest.approx(1, rel=1e-4)
    assert np.exp(model["vocab"]["bytes"]).sum(axis=1) == pytest.approx(1)
    _, unseen = language_model.document_scores(pa.array(["t1x", "qzjxkvqwzzkqjx" * 3]), model)
    assert unseen[1] < unseen[0] - 20
    frequent, rare = language_model.document_scores(pa.array(["c0 " * 50, "qzjxkv " * 50]), model)[1]
    assert rare < frequent


def test_lm_beats_uniform_and_reports_whole_documents(spark):
    """The network's part of the likelihood, of ids, against a uniform choice of ids; the rest is the words' share of their ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_model.train(docs)
    r = language_model.lm_scores(docs, model).toPandas()
    w = words(pa.array([x.text for x in docs.collect()]))
    ids, inside = language_model.word_ids(w, model["vocab"])
    by_id = language_model.score(model["p"], ids, w.first).sum()
    assert len(r) == docs.count() and r.n_words.sum() == len(ids) and np.exp(-by_id / len(ids)) < 0.6 * language_model.VOCABULARY
    assert r.log_likelihood.sum() == pytest.approx(by_id + inside.sum(), rel=1e-4)


def test_html():
    page = "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Home</a> | <a>News</a></nav><h1>A headline of some words here</h1>" + "<p>" + "Real words of the article go on &amp; on. " * 8 + "</p><p>" + "More text in <b>bold</b> follows it here. " * 8 + "</p><footer>Copyright 2024 Example, all rights</footer><!-- gone -->"
    text, n, kept = html_blocks.extract([page])[0]
    assert "Real words" in text and "& on" in text and "Home" not in text and "var a" not in text and "gone" not in text and kept < n
    assert html_blocks.extract([None, "", "plain words only", "<div><p>unclosed", "<"])[0] == ("", 0, 0)
    table = np.array(html_blocks.TABLE, float)
    assert (html_blocks.decide(html_blocks.tree(), table[:, :-1]) == table[:, -1]).mean() > 0.97


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert html_blocks.extract_html(pages).where("n_content > 0").count() > 0.9 * pages.where("length(html) > 0").count()


def test_html_by_page(spark):
    """Words kept against those of each page's article."""
    import re

    def said(html):
        return re.sub(r"<[^>]*>", " ", html).split()

    f1 = []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if not article:
            continue
        want, got = Counter(said(html_blocks.entities.unescape(article[1]))), Counter(html_blocks.extract([r.html])[0][0].split())
        both = sum((want & got).values())
        f1.append(2 * both / max(1, sum(want.values()) + sum(got.values())))
    assert len(f1) > 100 and np.mean(f1) > 0.97 and np.mean(np.array(f1) > 0.9) > 0.95


def test_html_tree_on_held_out_rows():
    """Trees grown without a fifth of TABLE tell that fifth."""
    table = np.array(html_blocks.TABLE, float)
    hit = []
    for k in range(5):
        held = np.arange(len(table)) % 5 == k
        tree = html_blocks.grow(table[~held, :-1], table[~held, -1])
        hit += list(html_blocks.decide(tree, table[held, :-1]) == table[held, -1])
    assert np.mean(hit) > 0.8


def test_html_hostile_pages():
    """Time is linear in the page; elements that aren't closed lose only their tags."""
    for part in ("<script ", "<script>", "<!-", "</script ", "<style></styl", "<a <b", "<head>", "&amp", "<svg>", "<script></scripty>"):
        took = []
        for n in (100_000, 400_000):
            t = time.perf_counter()
            html_blocks.blocks(part * (n // len(part)))
            took.append(time.perf_counter() - t)
        assert took[1] < 20 * took[0] + 1, part
    words_ = "one two three four five six seven eight nine ten eleven twelve"
    for page in (f"<head><meta><body><p>{words_}</p>", f"<svg/><p>{words_}</p>", f"<script><p>{words_}</p>", f"<head><title>T</title><p>{words_}</p>", f"<p>{words_}<!-- x", f"<head></head><p>{words_}</p></script>"):
        assert html_blocks.extract([page])[0][0] == words_, page


def test_html_odd_input(spark):
    rows = [(1, None, "u"), (2, "", None), (None, "<p>one two three four five six</p>", None), (None, None, None), (3, "<p>same words</p>", "u"), (3, "<p>same words</p>", "u"), (4, "<div>" + "word " * 60_000, "u"), (5, "<a <b <c", "u")]
    pages = spark.createDataFrame([r + ("x", "y") for r in rows], "page_id bigint, html string, url string, text string, n_blocks string")
    got = html_blocks.extract_html(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows) and all(r.text == "" for r in got if r.page_id in (1, 2))
    assert max(len(r.text) for r in got) > 250_000 and html_blocks.extract_html(pages.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------


def copies(rng, n_groups=60):
    out = []
    for g in range(n_groups):
        base = [f"g{g}w{rng.randint(0, 5000)}" for _ in range(rng.randint(80, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            out.append(" ".join(w if rng.random() > 0.03 else "changed" + str(rng.randint(0, 99)) for w in base))
    return out


@pytest.mark.parametrize("forest", [{}, {"bound": 16}, {"bound": 4, "rounds": 1}, {"bound": 2, "rounds": 0}], ids=str)
def test_simhash_recall_and_forest(spark, forest):
    """The usual forest, one with dense nodes that climbs, one that leaves many rows to blocks, and blocks alone, which are exact."""
    texts = copies(random.Random(8))
    texts += [texts[0]] * 300 + [" ".join(random.Random(i).choices([f"z{j}" for j in range(9000)], k=100)) for i in range(300)]
    sig = simhash.signatures(pa.array(texts))
    n = len(texts)
    near = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(axis=2) <= simhash.RADIUS
    root = np.arange(n)
    for i in range(n):  # components by brute force
        for j in np.flatnonzero(near[i]):
            root[root == root[j]] = root[i]
    rows = simhash.near_copies(docs_of(spark, list(enumerate(texts))), **forest).collect()
    got = {r.doc_id: r.group_id for r in rows}
    i, j = np.nonzero(np.triu(near, 1))
    caught = np.mean([got[a] == got[b] for a, b in zip(i.tolist(), j.tolist())])
    assert caught == 1 if forest.get("rounds") == 0 else caught >= 0.9
    assert all(root[a] == root[got[a]] for a in got)
    different = near & (sig[:, None, :] != sig[None, :, :]).any(axis=2)
    assert all(0 <= r.links <= different[r.doc_id].sum() and (r.links > 0) == (len({tuple(sig[x]) for x in got if got[x] == r.group_id}) > 1) for r in rows)
    if not forest:
        kept = {r.doc_id for r in simhash.drop_copies(docs_of(spark, list(enumerate(texts)))).collect()}
        assert kept == {a for a in got if got[a] == a}


def test_forest_adapts_to_density(spark):
    """Prefixes are longer in a dense region only; no node but the last rounds' is beyond its bound; recall of each row is reached."""
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 2, (600, simhash.BITS))
    sig[300:] = sig[0]
    sig[300:] ^= rng.random((300, simhash.BITS)) < 0.08  # a cluster around one row
    words_ = np.packbits(sig.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    rows = spark.createDataFrame([(i, bytearray(w.tobytes()), 0.0) for i, w in enumerate(words_)], "node bigint, sig binary, miss double")
    dense = simhash.dense_nodes(rows, range(28), 20)
    for t in range(28):
        code, depth = simhash.leaves(sig.astype(np.uint8), t, dense)
        assert (depth[1:300] == simhash.SHORT).mean() > 0.9 and depth[300:].mean() > simhash.SHORT + 1
        assert np.unique(code, return_counts=True)[1].max() <= 20
    left = {r.node: r.miss for r in simhash.climb(rows, range(28), dense, simhash.RADIUS, 0.9).collect()}
    for i in range(600):
        miss = sum(np.log1p(-simhash.share(int(simhash.leaves(sig[i : i + 1].astype(np.uint8), t, dense)[1][0]))) for t in range(28))
        assert (i in left) == (miss > np.log(0.1) + 1e-9) and (i not in left or left[i] == pytest.approx(miss))
    near = np.bitwise_count(words_[:, None, :] ^ words_[None, :, :]).sum(axis=2) <= simhash.RADIUS
    root = {r.node: r.root for r in simhash.components(simhash.edges(rows.drop("miss"), bound=20)).collect()}
    i, j = np.nonzero(np.triu(near, 1))
    assert np.mean([a in root and root.get(a) == root.get(b) for a, b in zip(i.tolist(), j.tolist())]) >= 0.9


def test_drop_copies_in_blocks(spark, monkeypatch):
    texts = copies(random.Random(8))
    docs = docs_of(spark, list(enumerate(texts + texts[:50])) + [(0, texts[0])], clash=True)
    want = sorted(r.doc_id for r in simhash.drop_copies(docs).collect())
    for rows, times in ((7, 100), (7, 0)):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(simhash, "BROADCASTS", times)
        assert sorted(r.doc_id for r in simhash.drop_copies(docs).collect()) == want


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 302), (302, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a bigint, b bigint"), one_task).collect()}
    want = {i: 0 for i in range(51)} | {100: 100, 150: 100, 200: 100, 300: 300, 301: 300, 302: 300}
    assert {k: v for k, v in got.items() if k in want} == want


def test_tries_reach_recall():
    """Some pairs at the radius, drawn at random, against ``share``; a round without dense nodes suffices."""
    assert 1 - (1 - simhash.share(simhash.SHORT)) ** simhash.TRIES >= simhash.RECALL
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, (4000, simhash.BITS)).astype(np.uint8)
    b = a.copy()
    for r in b:
        r[rng.permutation(simhash.BITS)[: simhash.RADIUS]] ^= 1
    same = np.array([simhash.prefix_codes(a, t, 12) == simhash.prefix_codes(b, t, 12) for t in range(simhash.TRIES)])
    assert same.mean() == pytest.approx(simhash.share(12), abs=0.01) and same.any(axis=0).mean() >= simhash.RECALL
    assert (simhash.prefix_codes(a, 0, 96) == simhash.prefix_codes(a.copy(), 0, 96)).all() and len(np.unique(simhash.prefix_codes(a, 0, 96))) == 4000


def test_references_verify_text_not_only_hash():
    refs = containment.references(["a"], ["one two three four"])
    assert refs.distinct[0] == 2 and set(refs.texts) == {"one two three", "two three four"}

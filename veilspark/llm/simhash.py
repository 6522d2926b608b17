"""SimHash near-duplicates through an LSH forest.

A document's features are its distinct words and distinct runs of two words
(its bytes, if it has no word); BITS signs of summed feature hashes are its
signature.  Two documents are near copies if their signatures differ in at most
RADIUS bits; groups are the connected components, and the smallest doc_id of a
group is kept.

The forest has TRIES tries a round, each over its own random permutation of the
bits.  Prefix depth adapts to local density: a trie's root is cut at SHORT bits,
and only where a node holds more than NODE signatures is it cut again, at the
next of DEPTHS, so dense regions have long prefixes and sparse ones short.  All
signatures of a node are compared.  A pair at RADIUS is in the same node of a
depth with the probability ``share``; of every signature the nodes that it was
in thus give the recall reached.  Signatures whose recall is below RECALL climb:
they go through another round of tries whose nodes may be twice as large, so
that prefixes get shorter, until they reach it.  After ROUNDS rounds nodes grow
no more; what hasn't reached it then is compared block with block, exactly, or,
where so much is left that this would cost more, after further rounds, at most
four times ROUNDS in all.  So where nothing is dense, one round of
TRIES is all, whatever the size of the table; the number of copies of a
signature that are shuffled grows only in dense regions.  Every candidate is
verified on all BITS bits.

Equal signatures are one node from the start, so thousands of exact copies cost
one row.  Within a node only edges that join two components are written, so
``links`` of near_copies counts the verified links to other texts that join the
group, not all pairs.

Defined cases: null and empty texts are copies of each other; texts without
words are copies only of equal texts; a null doc_id sorts last and is carried;
of rows alike in doc_id and text one stays; an empty table gives no rows; other
columns pass through ``drop_copies`` untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import buffers, chunks, mix, plain, words
from .common import cut, fresh

BITS = 256
RADIUS = 44
RECALL = 0.9
#: Tries of a round: a few more than nodes of SHORT bits need to reach RECALL, so that some may be dense.
TRIES, SHORT = 28, 12
DEPTHS = (SHORT, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256)
#: Signatures of a node in the first round; twice as many in each that follows.
NODE, ROUNDS = 2_048, 6
#: Dense nodes listed at once; where there would be more, fewer tries are searched at once.
LISTED = 4_000_000
#: Copies of signatures that one task compares.
TASK_ROWS = 500_000
#: Edges up to which one task finds the components; beyond it they are found by rounds of joins.
ONE_TASK_EDGES = 4_000_000
#: Rows to drop that are broadcast at once, and how often; where there are more, texts are shuffled once.
BROADCAST_ROWS, BROADCASTS = 2_000_000, 16

_SPREAD = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8).copy().view(np.uint64).ravel()


def _features(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code, document) of the distinct features of each document, by document."""
    w = words(part)
    same = np.flatnonzero(w.doc[:-1] == w.doc[1:]) if len(w.doc) > 1 else np.zeros(0, np.int64)
    pair = mix(w.code[same] * np.uint64(0xD6E8FEB86659FD93) + w.code[same + 1]) if len(same) else w.code[:0]
    code, doc = np.concatenate([w.code, pair]), np.concatenate([w.doc, w.doc[same] if len(same) else w.doc[:0]])
    bare = np.flatnonzero(np.diff(w.first) == 0)
    if len(bare):
        import xxhash

        data, bounds = buffers(plain(part))
        code = np.concatenate([code, np.array([xxhash.xxh64_intdigest(data[bounds[i] : bounds[i + 1]].tobytes(), 9) for i in bare], np.uint64)])
        doc = np.concatenate([doc, bare])
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, bool)
    return code[new], doc[new]


def signatures(column: pa.Array) -> np.ndarray:
    """(rows, BITS / 64) words of signature."""
    out = [np.zeros((0, BITS // 64), np.uint64)]
    for _, part in chunks(column):
        n = len(part)
        code, doc = _features(part)
        count = np.bincount(doc, minlength=n)
        first = np.concatenate([[0], np.cumsum(count)])
        cuts = np.flatnonzero((np.arange(len(doc)) - first[doc]) % 255 == 0)  # bytes count to 255
        owner = doc[cuts]
        from_ = np.searchsorted(owner, np.arange(n))
        bits = np.zeros((n, BITS), bool)
        for k in range(BITS // 64):
            x = mix(code + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            s = np.add.reduceat(_SPREAD[x.view(np.uint8).reshape(-1, 8)], cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
            bits[:, k * 64 : k * 64 + 64] = 2 * np.add.reduceat(s, from_, axis=0, dtype=np.int32) > count[:, None]
        out.append(np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64))
    return np.concatenate(out)


def unpacked(sig: np.ndarray) -> np.ndarray:
    """(rows, BITS) of 0 and 1."""
    return np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), BITS // 8), axis=1, bitorder="little")


def prefix_codes(bits: np.ndarray, trie: int, depth: int) -> np.ndarray:
    """A 64-bit hash of (trie, depth, the first ``depth`` permuted bits)."""
    pick = np.random.default_rng(1000 + trie).permutation(BITS)[:depth]
    whole = np.zeros((len(bits), -(-depth // 64) * 64), np.uint8)
    whole[:, :depth] = bits[:, pick]
    packed = np.packbits(whole, axis=1, bitorder="little").view(np.uint64)
    code = np.full(len(bits), (trie * 512 + depth) * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
    for k in range(packed.shape[1]):
        code = mix(code ^ packed[:, k])
    return code


def share(depth: int, radius: int = RADIUS) -> float:
    """Probability that a pair ``radius`` bits apart has the same prefix of ``depth`` bits."""
    return math.prod((BITS - radius - i) / (BITS - i) for i in range(depth)) if depth <= BITS - radius else 0.0


def _among(known: np.ndarray | None, code: np.ndarray) -> np.ndarray:
    """Which codes are in the sorted ``known``."""
    if known is None or not len(known):
        return np.zeros(len(code), bool)
    return known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code


def leaves(bits: np.ndarray, trie: int, dense: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(code, depth) of each row's node: the first of DEPTHS at which its prefix isn't dense."""
    code, depth = prefix_codes(bits, trie, SHORT), np.full(len(bits), SHORT)
    at = np.flatnonzero(_among(dense.get(SHORT), code))
    for d in DEPTHS[1:]:
        if not len(at):
            break
        code[at], depth[at] = prefix_codes(bits[at], trie, d), d
        at = at[_among(dense.get(d), code[at])]
    return code, depth


def node_edges(key: np.ndarray, sig: np.ndarray, order: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of edges within ``radius`` that connect all such pairs of equal ``key``.

    ``order`` sorts rows within a node, so that rows of long common prefixes are
    neighbours and are compared first.
    """
    at = np.lexsort((order, key))
    key, sig = key[at], sig[at]
    n = len(key)
    last = np.searchsorted(key, key, "right") - 1
    label = np.arange(n)
    left, right = [], []
    live, step = np.arange(n), 1
    while True:
        live = live[live + step <= last[live]]
        if step & (step - 1) == 0 and len(live):  # a node of one component is done
            split = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            whole = np.minimum.reduceat(label, np.append(0, split[:-1] + 1)) == np.maximum.reduceat(label, np.append(0, split[:-1] + 1))
            live = live[~whole[np.searchsorted(split, live)]]
        if not len(live):
            break
        i = live[label[live] != label[live + step]]
        i = i[np.bitwise_count(sig[i] ^ sig[i + step]).sum(axis=1) <= radius]
        if len(i):
            j = i + step
            left.append(at[i])
            right.append(at[j])
            while True:
                a, b = label[i], label[j]
                apart = a != b
                if not apart.any():
                    break
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, sig) of every row."""

    @F.arrow_udf("binary")
    def signature(text: pa.Array) -> pa.Array:
        s = np.ascontiguousarray(signatures(text))
        return pa.Array.from_buffers(pa.binary(BITS // 8), len(s), [None, pa.py_buffer(s.tobytes())]).cast(pa.binary())

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), signature("text").alias("sig"))


def _batches(batches):
    """(node, sig as words, sig as binary, miss) of each batch of (node, sig, miss)."""
    for batch in batches:
        if len(batch):
            yield batch.column(0), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, BITS // 64), batch.column(1), batch.column(2).to_numpy()


def dense_nodes(rows: DataFrame, tries: range, bound: int) -> dict[int, np.ndarray]:
    """By depth, the sorted codes of the nodes of more than ``bound`` rows; a depth is looked at only within the dense nodes of the one before."""
    out: dict[int, np.ndarray] = {}
    for depth, above in zip(DEPTHS, (None, *DEPTHS)):
        shared = rows.sparkSession.sparkContext.broadcast(dict(out))

        def count(batches, depth=depth, above=above, shared=shared):
            code, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for _, sig, _, _ in _batches(batches):
                bits, found = unpacked(sig), [code]
                for t in tries:
                    if above is None:
                        found.append(prefix_codes(bits, t, depth))
                    else:
                        own, at_depth = leaves(bits, t, shared.value)
                        found.append(own[at_depth == depth])
                weight = np.concatenate([n, np.ones(sum(map(len, found[1:])), np.int64)])
                code, inverse = np.unique(np.concatenate(found), return_inverse=True)
                n = np.bincount(inverse, weight, len(code)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

        found = rows.mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > bound).select("code").toArrow()["code"].to_numpy()
        if not len(found):
            break
        out[depth] = np.sort(found.view(np.uint64))
    return out


def _compare(rows: DataFrame, spread, copies: int, radius: int) -> DataFrame:
    """(a, b) edges among the rows of equal k, of (k, node, sig) as ``spread`` makes them."""

    def join(batches):
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        sig, node = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint64).reshape(-1, BITS // 64), t["node"].to_numpy()
        i, j = node_edges(t["k"].to_numpy(), sig, sig[:, 0], radius)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    return rows.mapInArrow(spread, "k bigint, node bigint, sig binary").repartition(max(1, -(-copies // TASK_ROWS)), "k").mapInArrow(join, "a bigint, b bigint")


def search(rows: DataFrame, tries: range, dense: dict[int, np.ndarray], count: int, radius: int) -> DataFrame:
    """Edges of ``count`` rows within the nodes of the tries."""
    shared = rows.sparkSession.sparkContext.broadcast(dense)

    def spread(batches):
        for node, sig, raw, _ in _batches(batches):
            bits = unpacked(sig)
            for t in tries:
                yield pa.RecordBatch.from_arrays([pa.array(leaves(bits, t, shared.value)[0].view(np.int64)), node, raw], ["k", "node", "sig"])

    return _compare(rows, spread, count * len(tries), radius)


def climb(rows: DataFrame, tries: range, dense: dict[int, np.ndarray], radius: int, recall: float) -> DataFrame:
    """The rows whose recall is still below ``recall`` after the tries; miss is the logarithm of what it lacks."""
    if not dense:
        more = len(tries) * math.log1p(-share(SHORT, radius))
        return rows.select("node", "sig", (F.col("miss") + more).alias("miss")).where(F.col("miss") > math.log(1 - recall) + 1e-9)
    shared = rows.sparkSession.sparkContext.broadcast(dense)
    gain = np.zeros(BITS + 1)
    gain[list(DEPTHS)] = [math.log1p(-share(d, radius)) for d in DEPTHS]

    def run(batches):
        for node, sig, raw, miss in _batches(batches):
            bits, miss = unpacked(sig), miss.copy()
            for t in tries:
                miss += gain[leaves(bits, t, shared.value)[1]]
            left = pa.array(miss > math.log(1 - recall) + 1e-9)
            yield pa.RecordBatch.from_arrays([node.filter(left), raw.filter(left), pa.array(miss).filter(left)], ["node", "sig", "miss"])

    return rows.mapInArrow(run, "node bigint, sig binary, miss double")


def edges(nodes: DataFrame, radius: int = RADIUS, recall: float = RECALL, tries: int = TRIES, bound: int = NODE, rounds: int = ROUNDS) -> DataFrame:
    """(a, b) pairs of (node, sig) rows within ``radius`` found by the forest, a < b; they connect every pair that it finds."""
    rows, out, first = nodes.select("node", "sig", F.lit(0.0).alias("miss")), None, 0
    count = rows.count()
    # after the last doubling, rounds go on at that size while they cost less than comparing all that is left
    most = bound << max(rounds - 1, 0)
    while count and first < (rounds if count <= tries * most else 4 * rounds) * tries:
        room = min(bound << (first // tries), most)
        now = range(first, min(first + max(1, min(tries, LISTED * room // count)), (first // tries + 1) * tries))
        dense = dense_nodes(rows, now, room)
        found = cut(search(rows, now, dense, count, radius), "edges")
        out = found if out is None else out.unionByName(found)
        rows = cut(climb(rows, now, dense, radius, recall), "climbing")
        count, first = rows.count(), now.stop
    if count:  # what is left, exactly: every block with every block
        parts = max(1, -(-count * 2 // (bound << rounds)))

        def spread(batches):
            for node, _, raw, _ in _batches(batches):
                own = (mix(node.to_numpy().view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                for k in range(parts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, k) * parts + np.maximum(own, k)), node, raw], ["k", "node", "sig"])

        found = cut(_compare(rows, spread, count * parts, radius), "edges")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else nodes.sparkSession.createDataFrame([], "a bigint, b bigint")


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every node of the edges."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return node, node[label]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


def components(pairs: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) of every node of ``pairs`` (a, b); root is the least node of its component."""
    if pairs.count() <= one_task:

        def run(batches):
            parts = list(batches)
            t = pa.Table.from_batches(parts) if parts else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            node, root = _union(t["a"].to_numpy(), t["b"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])

        return pairs.repartition(1).mapInArrow(run, "node bigint, root bigint")
    # large star, small star: every round halves the distance to the least node; each is written, so lineage stays short
    now = pairs.where("a <> b")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large-star")
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
        small = cut(small, "small-star")
        if small.groupBy("a").count().where("count > 1").isEmpty() and small.join(small.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").isEmpty():
            roots = small.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        now = small


def groups(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, one_task: int = ONE_TASK_EDGES, **forest: int) -> DataFrame:
    """(doc_id, text_hash, keep_id, keep_hash, links) of every row: its group is that of the row kept."""
    signed = cut(sign(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = signed.groupBy("sig").agg(first)
    nodes = cut(nodes.select("sig", "first", F.monotonically_increasing_id().alias("node")), "nodes")
    found = edges(nodes, radius, recall, **forest)
    links = found.where("a <> b").distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    joined = nodes.join(components(found, one_task), "node", "left").join(links, "node", "left").select("sig", "first", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    kept = joined.groupBy("root").agg(F.min("first").alias("kept"))
    known = joined.select("sig", "root", "links").join(kept, "root").select("sig", F.col("kept.doc_id").alias("keep_id"), F.col("kept.text_hash").alias("keep_hash"), "links")
    return signed.join(known, "sig").select("doc_id", "text_hash", "keep_id", "keep_hash", "links")


def near_copies(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, **forest: int) -> DataFrame:
    """(doc_id, group_id, kept, links) of every row; group_id is the doc_id of the row kept.

    Of rows alike in doc_id and text, all show kept; ``drop_copies`` leaves one.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    return groups(docs, radius, recall, **forest).select("doc_id", F.col("keep_id").alias("group_id"), kept.alias("kept"), "links")


def drop_copies(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, **forest: int) -> DataFrame:
    """One row of ``docs`` of each group, with its columns.

    Ids and hashes are shuffled, texts are not: the rows to drop are broadcast,
    BROADCAST_ROWS at once.  Only where there are more than BROADCASTS times as
    many (beyond which one shuffle costs less), and for rows alike in doc_id and
    text, of which one must stay, are texts shuffled.
    """
    found = cut(groups(docs, radius, recall, **forest), "groups")
    key = ["doc_id", "text_hash"]
    away = ~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash")))
    d, h, code = fresh(docs, "d", "h", "code")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    # one 64-bit code stands for both, so that a broadcast row is small; equal codes are looked at again
    gone = cut(found.where(away).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.xxhash64("doc_id", "text_hash").alias(code)).distinct(), "gone")
    twice = found.where(~away).groupBy(*key).count().where("count > 1").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (text_hash == F.col(h))
    blocks = -(-gone.count() // BROADCAST_ROWS)
    left = docs
    if blocks <= BROADCASTS:
        for k in range(blocks):
            own = gone.where(F.pmod(F.col(code), F.lit(blocks)) == k) if blocks > 1 else gone
            left = left.join(F.broadcast(own), (F.xxhash64("doc_id", text_hash) == F.col(code)) & same, "left_anti")
    else:
        left = left.join(gone, (F.xxhash64("doc_id", text_hash) == F.col(code)) & same, "left_anti")
    if twice.isEmpty():
        return left
    small = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    # any of them: combined before the shuffle, so that many repeats of one row don't meet in a task
    again = left.join(small, same, "left_semi").groupBy("doc_id", text_hash.alias(h)).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(d)).select(f"{d}.*")
    return left.join(small, same, "left_anti").unionByName(again)

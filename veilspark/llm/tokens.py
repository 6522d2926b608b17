"""Token ids: a concatenated id array with Elias-Fano document boundaries.

Each partition tokenizes its documents with a public byte-level BPE vocabulary
(a parameter; never trained) and writes shards of about SHARD_TOKENS ids.  A
shard's n+1 document boundaries are a non-decreasing sequence below u, kept as
``low`` (the lower l = floor(log2(u/n)) bits of each) and ``high`` (the upper
parts in unary): about 2 + log2(u/n) bits a document.  ``samples`` holds, as
32-bit numbers, the place in ``high`` of every SAMPLE-th one, so that select
reads at most a few bytes; no table of 64-bit offsets exists.

Defined cases: a null or empty text has no ids, so its boundaries are equal; a
null doc_id is carried; repeated rows are stored as often as they come; a long
text is tokenized whole, in one shard; an empty table gives no shards; other
columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .codes import _powers, buffers, chunks, mix, plain

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Public pre-tokenization pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_TOKENS = 4_000_000
SAMPLE = 64
CACHE = 2_000_000

SCHEMA = "n_docs int, n_tokens bigint, doc_ids array<bigint>, id_bytes int, ids binary, low_bits int, low binary, high binary, samples binary"


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizer:
    """Ids of whole texts, each distinct stretch encoded once.

    A text is cut before every space or newline that follows a character which
    isn't white space: the pattern never joins the two sides, so the ids of the
    stretches, in order, are the ids of the text.
    """

    def __init__(self, path: str = VOCABULARY):
        self.encoding = encoding(path)
        self.width = np.array([len(self.encoding.decode_single_token_bytes(i)) for i in range(self.encoding.n_vocab)])
        self._reset()

    def _reset(self) -> None:
        self.codes = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, codes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw = data.tobytes()
        # joined, stretches that begin with the cut and end in a character of one byte that isn't white keep their ids
        plain_ = ((data[start] == 32) | (data[start] == 10)) & (data[end - 1] > 32) & (data[end - 1] < 127) & (end - start > 1)
        order = np.argsort(~plain_, kind="stable")
        codes, start, end = codes[order], start[order], end[order]
        k = int(plain_.sum())
        joined = self.encoding.encode_to_numpy(b"".join(raw[s:e] for s, e in zip(start[:k].tolist(), end[:k].tolist())).decode("utf-8"), disallowed_special=()) if k else np.zeros(0, np.uint32)
        upto = np.searchsorted(np.cumsum(self.width[joined]), np.cumsum(end[:k] - start[:k])) + 1
        rest = [self.encoding.encode_ordinary(raw[s:e].decode("utf-8", "replace")) for s, e in zip(start[k:].tolist(), end[k:].tolist())]
        size = np.concatenate([np.diff(upto, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))]).astype(np.int64)
        slots = np.arange(len(self.at) - 1, len(self.at) - 1 + len(size))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, joined, np.fromiter((i for g in rest for i in g), np.uint32)])
        again = np.argsort(codes)
        codes, slots = codes[again], slots[again]
        place = np.searchsorted(self.codes, codes)
        self.codes = np.insert(self.codes, place, codes)
        self.slots = np.insert(self.slots, place, slots)

    def stretches(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cache slot of each stretch, stretches before each text)."""
        data, bounds = buffers(plain(column))
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        space = (data == 32) | (data == 10)
        white = space | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
        wide = np.zeros(n, bool)  # may end a white character of several bytes
        wide[1:] = (data[:-1] == 0xC2) & ((data[1:] == 0xA0) | (data[1:] == 0x85))
        wide[2:] |= (data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81)) | ((data[:-2] == 0xE3) | (data[:-2] == 0xE1)) & (data[2:] == 0x80)
        cutting = np.zeros(n, bool)
        cutting[1:] = space[1:] & ~(white | wide)[:-1]
        cutting[bounds[:-1][np.diff(bounds) > 0]] = True
        start = np.flatnonzero(cutting)
        end = np.append(start[1:], n)
        power, inverse = _powers(1 << max(12, int(n).bit_length()))
        h = np.empty(n + 1, np.uint64)
        h[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=h[1:])
        code = mix((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))
        uniq, first, inv = np.unique(code, return_index=True, return_inverse=True)
        if len(self.codes) > CACHE:
            self._reset()
        at = np.minimum(np.searchsorted(self.codes, uniq), max(len(self.codes) - 1, 0))
        new = self.codes[at] != uniq if len(self.codes) else np.ones(len(uniq), bool)
        if new.any():
            self._learn(uniq[new], data, start[first[new]], end[first[new]])
        return self.slots[np.searchsorted(self.codes, uniq)][inv], np.searchsorted(start, bounds)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = [np.zeros(0, np.int64)]
        for _, part in chunks(column):
            slot, first = self.stretches(part)
            total = np.concatenate([[0], np.cumsum(np.diff(self.at)[slot])])
            out.append(total[first[1:]] - total[first[:-1]])
        return np.concatenate(out)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, part in chunks(column):
            slot, first = self.stretches(part)
            size = np.diff(self.at)[slot]
            total = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(self.at[slot] - total[:-1], size) + np.arange(total[-1])
            ids.append(self.ids[take])
            counts.append(total[first[1:]] - total[first[:-1]])
        return np.concatenate(ids), np.concatenate(counts)


@lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """One for each Python worker, so that its cache outlives a task."""
    return Tokenizer(path)


def elias_fano(values: np.ndarray) -> dict:
    """The non-decreasing ``values`` (the last is the largest) as low_bits, low, high and samples."""
    n, u = len(values), int(values[-1]) + 1
    low_bits = max(0, int(np.floor(np.log2(u / n)))) if u > n else 0
    bits = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
    ones = (values >> low_bits) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    return {"low_bits": low_bits, "low": np.packbits(bits.ravel(), bitorder="little").tobytes(), "high": np.packbits(high, bitorder="little").tobytes(), "samples": ones[::SAMPLE].astype(np.uint32).tobytes()}


def select(shard: dict, i: int) -> int:
    """Boundary i of a shard: where its document i begins, and document i-1 ends."""
    if not 0 <= i <= shard["n_docs"]:
        raise IndexError(i)
    at = int(np.frombuffer(shard["samples"], np.uint32)[i // SAMPLE])
    left = i % SAMPLE
    high = shard["high"]
    byte, word = at // 8, high[at // 8] >> (at % 8) << (at % 8)
    while left >= word.bit_count():
        left -= word.bit_count()
        byte += 1
        word = high[byte]
    for _ in range(left):
        word &= word - 1
    place = byte * 8 + ((word & -word).bit_length() - 1)
    low_bits, value = shard["low_bits"], 0
    if low_bits:
        b = i * low_bits
        value = int.from_bytes(shard["low"][b // 8 : (b + low_bits + 7) // 8], "little") >> (b % 8) & ((1 << low_bits) - 1)
    return (place - i) << low_bits | value


def document(shard: dict, i: int) -> np.ndarray:
    """The ids of document i of a shard."""
    a, b = select(shard, i), select(shard, i + 1)
    size = shard["id_bytes"]
    return np.frombuffer(shard["ids"], np.uint16 if size == 2 else np.uint32)[a:b]


def token_store(docs: DataFrame, path: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row a shard (SCHEMA) holding every document of ``docs``; a narrow pass."""

    def run(batches):
        tok = tokenizer(path)
        wide = tok.encoding.max_token_value > 0xFFFF

        def shard(ids, counts, keys):
            counts = np.concatenate(counts)
            values = np.concatenate([[0], np.cumsum(counts)])
            row = {"n_docs": len(counts), "n_tokens": int(values[-1]), "doc_ids": keys, "id_bytes": 4 if wide else 2, "ids": b"".join(ids)} | elias_fano(values)
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        ids, counts, keys, held = [], [], [], 0
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for at, part in chunks(text):
                i, c = tok.encode(part)
                ids.append(i.astype(np.uint32 if wide else np.uint16).tobytes())
                counts.append(c)
                keys += key.slice(at, len(part)).to_pylist()
                held += len(i)
                if held >= shard_tokens:
                    yield shard(ids, counts, keys)
                    ids, counts, keys, held = [], [], [], 0
        if keys:
            yield shard(ids, counts, keys)

    return docs.selectExpr("cast(doc_id as bigint)", "text").mapInArrow(run, SCHEMA)


ARROW = pa.schema([("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])

"""Byte-level byte-pair encoding: token counts by rank-synchronous array merging; encoding and decoding with offsets.

Both are maps over rows without a shuffle. The vocabulary file is read on each executor; its path is a parameter. A
worker keeps the results of pre-tokens it has met, up to CACHE of them, and then starts anew; results don't depend on it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import text_chunks
from tidemark.llm.pretokens import boundaries, slices

CACHE = 400_000
GENERATION = 220_000
LONG_TOKEN = 48  # bytes from which merges are kept in a heap


# --- counts -----------------------------------------------------------------------------------------------------------


class MergeTable:
    """Merges of a tokenizers .json file as arrays: rank and result of a pair of symbol ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = max(vocab.values()) + 1
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.width + right
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.rank, self.made = keys, first.astype(np.int64), made[first]
        self.byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or [] if t.get("special")]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or a number above all ranks, place in the table)."""
        if not len(self.keys):
            return np.full(len(left), 1 << 60), np.zeros(len(left), np.int64)
        k = left * self.width + right
        i = np.searchsorted(self.keys, k)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == k, self.rank[i], 1 << 60), i


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + spare)
            spare += 1
    return [out[b] for b in range(256)]


@functools.lru_cache(2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def merged_counts(tokens: list[bytes], table: MergeTable) -> np.ndarray:
    """Symbols left of each pre-token. All are merged at once: in each round every sequence applies its own
    lowest-rank pair at all its places, from left to right; sequences without a pair leave the arrays."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    counts = sizes.copy()
    symbols = table.byte[np.frombuffer(b"".join(tokens), np.uint8)]
    seq = np.repeat(np.arange(len(tokens)), sizes)
    rank = np.full(len(symbols), 1 << 60)
    place = np.zeros(len(symbols), np.int64)
    stale = np.ones(len(symbols), bool)  # pairs whose rank is to be looked up
    while len(symbols):
        stale[-1] = False
        rank[-1] = 1 << 60
        i = np.flatnonzero(stale)
        i = i[seq[i] == seq[i + 1]]
        rank[stale] = 1 << 60
        rank[i], place[i] = table.ranks(symbols[i], symbols[i + 1])
        starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        lowest = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.concatenate([starts, [len(symbols)]]))
        counts[seq[starts]] = lengths
        best = np.repeat(lowest, lengths)
        hit = (rank == best) & (best < 1 << 60)
        # of pairs that overlap (a a a), every other one from the left
        both = hit[1:] & hit[:-1]
        if both.any():
            at = np.flatnonzero(hit)
            run = np.cumsum(np.concatenate([[True], np.diff(at) != 1]))
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            odd = (np.arange(len(at)) - first[run - 1]) % 2 == 1
            hit[at[odd]] = False
        symbols[hit] = table.made[place[hit]]
        stale = hit.copy()
        stale[:-1] |= hit[1:]  # the pair before a merge
        gone = np.zeros(len(symbols), bool)
        gone[1:] = hit[:-1]
        keep = ~gone & (best < 1 << 60)
        symbols, seq, rank, place, stale = symbols[keep], seq[keep], rank[keep], place[keep], stale[keep]
    return counts


def _segments(data: bytes, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts at special strings: (offsets of segments, row of each, whether it is a special string)."""
    cuts: list[tuple[int, int]] = []
    for s in special:
        i = data.find(s)
        while i >= 0:
            row = int(np.searchsorted(offsets, i, "right")) - 1
            if i + len(s) <= offsets[row + 1]:
                cuts.append((i, i + len(s)))
            i = data.find(s, i + len(s))
    rows = np.arange(len(offsets) - 1)
    if not cuts:
        return offsets, rows, np.zeros(len(rows), bool)
    edges = np.array(sorted([*((int(o), 0, 0) for o in offsets[:-1]), *((a, 1, 1) for a, _ in cuts), *((b, 1, 0) for _, b in cuts)]), np.int64)
    begin, flag = edges[:, 0], edges[:, 2].astype(bool)
    row = np.cumsum(edges[:, 1] == 0) - 1
    # a cut that ends where the next text begins belongs to the text before: it is empty and counts nothing
    return np.concatenate([begin, [len(data)]]), row, flag


class Counter:
    def __init__(self, path: str) -> None:
        self.table, self.known = merge_table(path), {}

    def count(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        where, row, special = _segments(data, offsets, self.table.special)
        begin, first = boundaries(data, where, "tokenizers")
        tokens = slices(data, begin)
        distinct = set(tokens)
        new = distinct.difference(self.known)
        if len(new) + len(self.known) > CACHE:
            self.known, new = {}, distinct
        if new:
            new = list(new)
            self.known.update(zip(new, merged_counts(new, self.table).tolist()))
        each = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        sums = np.concatenate([[0], np.cumsum(each)])
        by_segment = np.where(special, 1, sums[first[1:]] - sums[first[:-1]])
        return np.bincount(row, by_segment, len(offsets) - 1).astype(np.int64)


_WORKER: dict = {}


def _held(kind: type, path: str):
    """One object for each worker process and file."""
    if (kind, path) not in _WORKER:
        _WORKER[kind, path] = kind(path)
    return _WORKER[kind, path]


def token_counts(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of `documents`: id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    A null text is empty, with 0 tokens. Special strings inside a text are one token each, as the tokenizers library
    takes them. Repeated ids stay rows of their own; other columns are ignored whatever their names.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _held(Counter, path)
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                n = counter.count(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


# --- encoding and decoding --------------------------------------------------------------------------------------------


class Codec:
    """Encoder and decoder for a file of ranks (base64 token, rank)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.names = [str(i) for i in range(max(self.ranks.values()) + 1)]
        tokens = [b""] * len(self.names)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        #: Ids as little-endian 32-bit integers: of each token, and of the pre-tokens met in this generation and the last.
        self.code = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merge(self, token: bytes) -> bytes:
        """Ids of one pre-token: the lowest-rank pair, the leftmost of equals, until none is left."""
        ranks = self.ranks
        if (whole := self.code.get(token)) is not None:
            return whole
        if len(token) >= LONG_TOKEN:
            return self._merge_long(token)
        parts = [token[i : i + 1] for i in range(len(token))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < 1 << 60:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return b"".join([self.code[p] for p in parts])

    def _merge_long(self, token: bytes) -> bytes:
        """The same with a heap and links, in n log n steps."""
        ranks, n = self.ranks, len(token)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            m = end[i]
            if not m or m >= n or end[m] != j:
                continue
            end[i], end[m] = j, 0
            if j < n:
                before[j] = i
                if (r := ranks.get(token[i : end[j]])) is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            if (p := before[i]) >= 0 and (r := ranks.get(token[p:j])) is not None:
                heapq.heappush(heap, (r, p, j))
        out, i = [], 0
        while i < n:
            out.append(self.code[token[i : end[i]]])
            i = end[i]
        return b"".join(out)

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and for each text the index of its first (one entry more at the end)."""
        begin, first = boundaries(data, offsets)
        tokens = slices(data, begin)
        distinct = set(tokens)
        new = distinct.difference(self.known)
        if len(new) + len(self.known) > GENERATION:  # of what was known before, only what is met again stays
            self.known, self.older, new = {}, self.known, distinct
        older, known, merge = self.older.get, self.known, self.merge
        for t in new:
            known[t] = older(t) or merge(t)
        each = list(map(known.__getitem__, tokens))
        ids = np.frombuffer(b"".join(each), "<i4").astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) >> 2)])
        return ids, sums[first]

    def decode(self, ids: np.ndarray, index: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(bytes of all texts, their offsets, the byte offset of each id): a gather from one array of all tokens."""
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(at[-1]) + np.repeat(self.at[ids] - at[:-1], size)
        return self.bytes[source].tobytes(), at[index], at


def encoded(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `documents`: id, ids (array of int), offsets (byte offset of each id in its text).

    A null text is empty and has no ids. No special tokens; special strings are ordinary text.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _held(Codec, path)
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                ids, index = codec.encode(data, offsets)
                _, where, at = codec.decode(ids, index)
                at = at[:-1] - np.repeat(where[:-1], np.diff(index))
                lists = [pa.ListArray.from_arrays(pa.array(index, pa.int32()), pa.array(x, pa.int32())) for x in (ids, at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *lists], ["id", "ids", "offsets"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, ids array<int>, offsets array<int>").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id, text (binary) of an array of ids; null for null."""
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _held(Codec, path)
        for batch in batches:
            out = [None if x is None else codec.decode(np.array(x, np.int64), np.array([0, len(x)]))[0] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text binary").withColumnRenamed("id", id_col)


def round_trip(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode, then decode the ids: id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.

    Columns named in `keep` come along unchanged. A null text is empty.
    """
    keep = keep or []
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _held(Codec, path)
        names = codec.names
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                ids, index = codec.encode(data, offsets)
                text, where, _ = codec.decode(ids, index)
                words = [names[i] for i in ids.tolist()]
                bounds = list(zip(index.tolist(), index[1:].tolist()))
                a = [hashlib.sha256(",".join(words[i:j]).encode()).hexdigest() for i, j in bounds]
                b = [hashlib.sha256(text[i:j]).hexdigest() for i, j in zip(where.tolist(), where[1:].tolist())]
                cut = [batch.column(c).slice(first, last - first) for c in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([cut[0], pa.array(np.diff(index), pa.int64()), pa.array(a), pa.array(b), *cut[1:]], ["_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("_id", "_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (f", {schema}" if schema else ""))
    return out if id_col in keep else out.withColumnRenamed("_id", id_col)

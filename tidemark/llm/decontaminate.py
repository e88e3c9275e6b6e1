"""Benchmark decontamination by winnowing.

A text is lower-cased (A-Z) and cut into words. Of every window of `window` words the least hash of its `window - k + 1`
k-grams is its fingerprint (the rightmost of equals). The choice depends on the window's words alone, so a document's
window that equals a benchmark window has the same fingerprint: every shared span of `window` words is found. Documents'
fingerprints are joined to the benchmark's; each hit is extended to its window and compared word by word.

The benchmark goes to the executors in broadcast blocks of at most `block_bytes` of text, however large it is. A block's
index is a few arrays: 8 bytes for each word, and for each window 24 at most, so 16 times the text at the very worst (words
of one letter). Where there are several, a worker holds one at a time: it gathers ROUND_BYTES of documents and takes them
through every block. No shuffle of documents. Words are compared as 64-bit hashes, each word of a window by itself.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import byte_words, gram_hashes, member, slice_hashes, text_chunks, window_minima

BLOCK_BYTES = 8 << 20
ROUND_BYTES = 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


class Fingerprints:
    """What one block of the benchmark holds: its words, fingerprints, and the places and items of each window."""

    def __init__(self, items: list[tuple[object, str]], window: int, k: int) -> None:
        self.window, self.k = window, k
        self.ids = list(dict.fromkeys(i for i, _ in items))
        number = {x: i for i, x in enumerate(self.ids)}
        words, starts, owners = [], defaultdict(list), defaultdict(list)
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        size = 0
        for item, text in items:
            hashes = _hashes(text)
            if not len(hashes):
                continue
            n = min(window, len(hashes))
            starts[n].append(size + np.arange(len(hashes) - n + 1, dtype=np.int32))
            owners[n].append(np.full(len(hashes) - n + 1, number[item], np.int32))
            if n < window:
                prints[n].append(gram_hashes(hashes, n))
            else:
                grams = gram_hashes(hashes, k)
                prints[n].append(grams[window_minima(grams, window - k + 1)])
            words.append(hashes)
            size += len(hashes)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.prints = {n: np.unique(np.concatenate(x)) for n, x in prints.items()}
        #: For each length the hashes of its distinct windows, the place of the first of each, and the items of window i
        #: as items[at[i] : at[i + 1]].
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in starts:
            place, owner = np.concatenate(starts[n]), np.concatenate(owners[n])
            h = gram_hashes(self.words, n)[place]
            order = np.lexsort((owner, h))
            h, place, owner = h[order], place[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            self.windows[n] = h[new], place[new], np.append(new, len(h)).astype(np.int32), owner

    def hits(self, hashes: np.ndarray, row_of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, starts of the benchmark's windows, their rows, for each start which window it is)."""
        for n, table in self.prints.items():
            if len(hashes) < n:
                continue
            whole = gram_hashes(hashes, n)
            if n < self.window:
                at = np.flatnonzero(member(whole, table))
            else:
                grams = gram_hashes(hashes, self.k)
                minima = window_minima(grams, self.window - self.k + 1)
                chosen = np.unique(minima)
                hit = np.zeros(len(grams), bool)
                hit[chosen[member(grams[chosen], table)]] = True
                at = np.flatnonzero(hit[minima])
            at = at[row_of[at] == row_of[at + n - 1]]
            known, place, _, _ = self.windows[n]
            which = np.minimum(np.searchsorted(known, whole[at]), len(known) - 1)
            same = known[which] == whole[at]
            at, which = at[same], which[same]
            steps = np.arange(n)
            same = (hashes[at[:, None] + steps] == self.words[place[which][:, None] + steps]).all(axis=1)
            yield n, at[same], row_of[at[same]], which[same]

    def items(self, n: int, rows: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, object]]:
        """Each (row, item) once."""
        _, _, at, owner = self.windows[n]
        sizes = at[which + 1] - at[which]
        rows = np.repeat(rows, sizes)
        mine = owner[np.repeat(at[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(rows))]
        for r, i in np.unique(np.column_stack([rows, mine]), axis=0).tolist():
            yield r, self.ids[i]


def _hashes(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    raw, starts, ends, _ = byte_words(data, np.array([0, len(data)]), _WORD)
    return slice_hashes(_LOWER[raw], starts, ends)


@dataclass
class Chunk:
    """Rows of a batch: their words, and what has been found in them."""

    batch: pa.RecordBatch
    first: int
    last: int
    data: bytes
    offsets: np.ndarray

    def __post_init__(self) -> None:
        raw, self.starts, self.ends, self.rows = byte_words(self.data, self.offsets, _WORD)
        self.hashes = slice_hashes(_LOWER[raw], self.starts, self.ends)
        self.row_of = np.repeat(np.arange(self.last - self.first), np.diff(self.rows))
        self.cover = np.zeros(len(self.starts) + 1, np.int32)
        self.items: list[set] = [set() for _ in range(self.last - self.first)]

    def search(self, index: Fingerprints) -> None:
        for n, at, rows, which in index.hits(self.hashes, self.row_of):
            np.add.at(self.cover, at, 1)
            np.add.at(self.cover, at + n, -1)
            for row, item in index.items(n, rows, which):
                self.items[row].add(item)

    @property
    def hit(self) -> np.ndarray:
        return np.cumsum(self.cover[:-1]) > 0


def _scanned(batches: Iterator[pa.RecordBatch], column: int, blocks: list) -> Iterator[Chunk]:
    """The chunks of all batches, searched for every block."""

    def searched(chunks: list[Chunk]) -> list[Chunk]:
        for block in blocks:
            # of several blocks none is kept: at most one is in memory
            index = block.value if len(blocks) == 1 else block.load_from_path(block._path)
            for c in chunks:
                c.search(index)
        return chunks

    held, size = [], 0
    for batch in batches:
        for part in text_chunks(batch.column(column)):
            held.append(Chunk(batch, *part))
            size += len(held[-1].data)
            if size >= ROUND_BYTES or len(blocks) == 1:
                yield from searched(held)
                held, size = [], 0
    yield from searched(held)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, k: int, block_bytes: int) -> list:
    """The benchmark's indexes, each of a bounded size, as broadcast variables; the driver makes one at a time. An item
    longer than a block is a block of its own with those that share its part."""
    b = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    size = b.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    parts = max(1, -(-int(size) // block_bytes))
    context = b.sparkSession.sparkContext
    out = []
    for part in range(parts):
        mine = b if parts == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        out.append(context.broadcast(Fingerprints([(r["item"], r["text"]) for r in mine.toLocalIterator()], window, k)))
    return out


def contamination(
    documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    benchmark_text_col: str = "text", window: int = 8, k: int = 4, min_items: int = 2, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of `documents`: id, n_words, n_hit, n_items, items (array), contaminated, cleaned.

    A benchmark item of fewer words than `window`, but not none, is one window. `cleaned` is the text without the hit
    words (from each hit run's first byte to its last), null where nothing is hit. A null text has no words; an item
    whose id or text is null is left out; an empty benchmark hits nothing; repeated ids and rows are each a row of
    their own; other columns are ignored whatever their names.
    """
    blocks = _blocks(benchmark, item_col, benchmark_text_col, window, k, block_bytes)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _scanned(batches, 1, blocks):
            hit, rows = c.hit, c.rows
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_hit = sums[rows[1:]] - sums[rows[:-1]]
            cleaned: list[str | None] = [None] * (c.last - c.first)
            for i in np.flatnonzero(n_hit):
                a, b = rows[i], rows[i + 1]
                flags = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                at, keep = int(c.offsets[i]), []
                for x, y in zip(np.flatnonzero(flags == 1) + a, np.flatnonzero(flags == -1) + a - 1):
                    keep.append(c.data[at : c.starts[x]])
                    at = int(c.ends[y])
                cleaned[i] = b"".join([*keep, c.data[at : c.offsets[i + 1]]]).decode()
            found = [sorted(x, key=str) for x in c.items]
            yield pa.RecordBatch.from_arrays(
                [c.batch.column(0).slice(c.first, c.last - c.first), pa.array(np.diff(rows), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array(found, pa.list_(kind)), pa.array([len(x) >= min_items for x in found], pa.bool_()), pa.array(cleaned, pa.string())],
                ["id", "n_words", "n_hit", "n_items", "items", "contaminated", "cleaned"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_words long, n_hit long, n_items long, items array<{item_type}>, contaminated boolean, cleaned string"
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def flagged(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", benchmark_text_col: str = "text", window: int = 8, k: int = 4, min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `documents` with all their columns, and contaminated: whether windows of `min_items` items occur. A column
    of `documents` of that name is replaced; nulls, empty tables and repeated rows as in contamination()."""
    blocks = _blocks(benchmark, item_col, benchmark_text_col, window, k, block_bytes)
    docs = documents.drop("contaminated")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _scanned(batches, at, blocks):
            flags = pa.array([len(x) >= min_items for x in c.items], pa.bool_())
            yield pa.RecordBatch.from_arrays([*c.batch.slice(c.first, c.last - c.first).columns, flags], [*names, "contaminated"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema + ", contaminated boolean")


def items_digest(items: str = "items"):
    """sha256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


def brute_force(rows: list[tuple], benchmark: list[tuple], window: int = 8) -> list[tuple]:
    """The contract word by word, for tests: (id, n_words, n_hit, n_items, digest, contaminated)."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for doc, text in rows:
        ws, hit, found = words(text), set(), set()
        for item, passage in benchmark:
            ps = words(passage)
            n = min(window, len(ps))
            for j in range(len(ps) - n + 1) if ps else []:
                for i in range(len(ws) - n + 1):
                    if ws[i : i + n] == ps[j : j + n]:
                        hit |= set(range(i, i + n))
                        found.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(found), digest, len(found) >= 2))
    return out

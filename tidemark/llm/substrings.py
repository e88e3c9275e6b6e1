"""Substring dedup: words inside any window of `window` words that a document with a smaller id also holds.

1. Candidate search. Of every window the least k-gram hash is its anchor; all windows that choose one anchor form its
   span (`window` words at least, twice that at most). A window's anchor depends on its words alone, so equal windows
   lie in spans of equal anchor. Spans are summed by (anchor, content): a span whose very content has a smaller document
   is covered whole; of each content only the first document goes on, and only where an anchor has several contents.
2. Matching. The contents of one anchor are a reference shard of bounded size. In ascending order of document each is
   streamed through the suffix automaton of those before it; where the matching statistic reaches `window`, the state
   tells the smallest document that holds these words. Then the content is added to the automaton.
3. An anchor with more than `shard` contents (a passage that stands in different surroundings in very many documents)
   would make an automaton of mostly unshared words. A sketch of fixed size, merged over all tasks, tells which windows
   may stand twice; only those are summed, and what two documents really hold is the anchor's reference, as long as what
   is shared, not as the number of documents. It goes to every block of the anchor's contents: each is streamed through
   the suffix automaton of the reference, which decides by words.
4. What is removed comes back to the texts, of which only those with a covered or open span are shuffled.

The automata are not broadcast to all executors: shards of all documents have no size bound, and streaming every
document through every shard is work in the square of the corpus. A shard goes to the tasks that hold spans of its
anchor instead. Words are compared as 64-bit hashes; whole spans of one anchor by a hash of 64 bits beside the anchor's 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.folders import scratch
from tidemark.llm.graph import BROADCAST_IDS, with_ids
from tidemark.llm.kernels import U64, _tables, byte_words, gram_hashes, mix, slice_hashes, text_chunks, window_minima

WINDOW = 50
GRAM = 8
SHARD = 200
BLOCK = 500  # contents of an anchor that meet its reference in one unit of work
SKETCH_BITS = 25

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


class SuffixAutomaton:
    """Of the texts added so far, in ascending order of document; every state knows its first document."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def add(self, words: list, doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in words:
            p, q = last, nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[p] + 1 else self._split(p, q, c)
                continue
            last = len(nxt)
            nxt.append({})
            length.append(length[p] + 1)
            link.append(0)
            first.append(doc)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = last
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[last] = q if length[q] == length[p] + 1 else self._split(p, q, c)

    def _split(self, p: int, q: int, c) -> int:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        first.append(first[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def covered(self, words: list, doc: int, window: int) -> list[int]:
        """Starts of the windows of `words` that a document before `doc` holds."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        out, v, n = [], 0, 0
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            while n >= window and length[link[v]] >= window:
                v = link[v]
                n = length[v]
            if n >= window and first[v] < doc:
                out.append(i - window + 1)
        return out


def run_hashes(words: np.ndarray):
    """A function of starts and ends: hashes of those runs of words, whatever stands around them."""
    up, down = _tables(len(words))
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return lambda a, b: mix((total[b] - total[a]) * down[a] + (b - a).astype(U64))


class Spans:
    """The words of a chunk of texts and their anchors' spans."""

    def __init__(self, data: bytes, offsets: np.ndarray, window: int, gram: int) -> None:
        raw, self.starts, self.ends, self.rows = byte_words(data, offsets, _WORD)
        self.words = slice_hashes(raw, self.starts, self.ends)
        hashed = run_hashes(self.words)
        grams = gram_hashes(self.words, gram)
        at = window_minima(grams, window - gram + 1)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.rows))
        windows = np.flatnonzero(row[: len(at)] == row[window - 1 :]) if len(at) else np.zeros(0, np.int64)
        chosen = at[windows]
        # a new span where the anchor changes; windows of one row and anchor are consecutive
        edge = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)])) if len(windows) else np.zeros(0, np.int64)
        self.a = windows[edge]
        self.b = windows[np.concatenate([edge[1:], [len(windows)]]) - 1] + window if len(edge) else self.a
        self.anchor = grams[chosen[edge]].view(np.int64)
        self.content = hashed(self.a, self.b).view(np.int64)
        self.row = row[self.a] if len(edge) else self.a


def _scan(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """id, anchor, content of the spans of each text, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                s = Spans(data, offsets, window, gram)
                o = np.lexsort((s.content, s.anchor, s.row))
                new = np.ones(len(o), bool)
                new[1:] = (np.diff(s.row[o]) != 0) | (s.anchor[o][1:] != s.anchor[o][:-1]) | (s.content[o][1:] != s.content[o][:-1])
                o = o[new]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + s.row[o])), pa.array(s.anchor[o]), pa.array(s.content[o])], ["id", "anchor", "content"])

    return docs.mapInArrow(run, "id long, anchor long, content long")


def _open_spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Words of the spans whose content is in the text's list `open` or `hot`, and whether in the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                s = Spans(data, offsets, window, gram)
                ids = batch.column(0).slice(first, last - first).to_pylist()
                wanted = [[set(x or ()) for x in batch.column(c).slice(first, last - first).to_pylist()] for c in (2, 3)]
                out, seen = [], set()
                for row, anchor, content, a, b in zip(s.row.tolist(), s.anchor.tolist(), s.content.tolist(), s.a.tolist(), s.b.tolist()):
                    hot = content in wanted[1][row]
                    if (hot or content in wanted[0][row]) and (row, anchor, content) not in seen:
                        seen.add((row, anchor, content))
                        out.append((ids[row], anchor, content, s.words[a:b].tobytes(), hot))
                columns = list(zip(*out)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "anchor", "content", "words", "hot"])

    return docs.select("id", "text", "open", "hot").mapInArrow(run, "id long, anchor long, content long, words binary, hot boolean")


def _matched(spans: DataFrame, window: int) -> DataFrame:
    """(id, content, starts): what the automaton of each anchor's smaller documents covers. Sorted by anchor, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, waiting, out = None, None, None, []

        def flush():
            columns = list(zip(*out)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.list_(pa.int32())])], ["id", "content", "starts"])

        for batch in batches:
            for doc, anchor, content, raw in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.frombuffer(raw, np.int64).tolist()
                if anchor != now:
                    now, automaton, waiting = anchor, SuffixAutomaton(), None
                if waiting:
                    automaton.add(*waiting)  # only once another content follows
                waiting = (words, doc)
                if starts := automaton.covered(words, doc, window):
                    out.append((doc, content, starts))
                if len(out) >= 5000:
                    yield flush()
        yield flush()

    return spans.select("id", "anchor", "content", "words").mapInArrow(run, "id long, content long, starts array<int>")


class Sketch:
    """Which of 2^bits slots one hash, and which two hashes or more have fallen in: two bits a slot, whatever the input."""

    def __init__(self, once: bytes | None = None, twice: bytes | None = None) -> None:
        unpack = lambda x: np.zeros(1 << SKETCH_BITS >> 3, np.uint8) if x is None else np.frombuffer(bytearray(zstandard.decompress(x)), np.uint8)
        self.once, self.twice = unpack(once), unpack(twice)

    def packed(self) -> tuple[bytes, bytes]:
        return tuple(zstandard.compress(x.tobytes(), 1) for x in (self.once, self.twice))

    @staticmethod
    def _get(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 > 0

    @staticmethod
    def _set(bits: np.ndarray, slots: np.ndarray) -> None:
        """Slots in ascending order."""
        if len(slots):
            at = slots >> 3
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            bits[at[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (slots & 7).astype(np.uint8), first)

    def add(self, hashes: np.ndarray) -> None:
        slots, n = np.unique((hashes >> U64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
        self._set(self.twice, slots[(n > 1) | self._get(self.once, slots)])
        self._set(self.once, slots)

    def merge(self, other: Sketch) -> None:
        self.twice |= other.twice | self.once & other.once
        self.once |= other.once

    def twofold(self, hashes: np.ndarray) -> np.ndarray:
        return self._get(self.twice, (hashes >> U64(64 - SKETCH_BITS)).astype(np.int64))


def _windows(words: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all words of these spans, hash of each window, its span, its start in the words)."""
    raw = [np.frombuffer(x, U64) for x in words.to_pylist()]
    sizes = np.array([len(x) for x in raw], np.int64)
    flat = np.concatenate(raw) if raw else np.zeros(0, U64)
    span = np.repeat(np.arange(len(raw)), sizes - window + 1)
    begin = np.cumsum(sizes) - sizes
    n = np.cumsum(sizes - window + 1)
    start = begin[span] + np.arange(len(span)) - (n - sizes + window - 1)[span]
    return flat, run_hashes(flat)(start, start + window), span, start


def _sketched(spans: DataFrame, window: int) -> Sketch:
    """Of the windows of all spans. Each task hands on one sketch, merged in groups and then in one task."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch, rows = Sketch(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                sketch.add(_windows(batch.column(0).slice(i, 5000), window)[1])
            rows += batch.num_rows
        if rows:
            yield row(TaskContext.get().partitionId(), sketch)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for i in range(batch.num_rows):
                part = Sketch(*(batch.column(c)[i].as_py() for c in (1, 2)))
                if whole is None:
                    whole = part
                else:
                    whole.merge(part)
        if whole is not None:
            yield row(0, whole)

    def row(part: int, sketch: Sketch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in sketch.packed())], ["part", "once", "twice"])

    schema = "part int, once binary, twice binary"
    each = spans.select("words").mapInArrow(of_task, schema)
    groups = max(1, int(spans.rdd.getNumPartitions() ** 0.5))
    one = each.repartition(groups).mapInArrow(merged, schema).repartition(1).mapInArrow(merged, schema).collect()
    return Sketch(one[0]["once"], one[0]["twice"]) if one else Sketch()


def _reference(spans: DataFrame, sketch, window: int) -> DataFrame:
    """anchor, low, words: runs of words whose windows two documents hold, from the smallest of those documents. Only windows
    that the sketch has twice are summed, in each task before any is shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}

        def flush():
            rows = [(h, *x) for h, x in known.items()]
            known.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], ["h", "high", "anchor", "low", "content", "at", "words"])

        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                ids, anchors, contents = (part.column(c).to_pylist() for c in range(3))
                flat, hashes, span, start = _windows(part.column(3), window)
                begin = np.searchsorted(span, np.arange(part.num_rows))
                for j in np.flatnonzero(sketch.value.twofold(hashes)).tolist():
                    h, s = int(hashes[j].view(np.int64)), int(span[j])
                    x = known.get(h)
                    high = ids[s] if x is None else max(x[0], ids[s])
                    if x is None or ids[s] < x[2]:
                        known[h] = [high, anchors[s], ids[s], contents[s], j - int(begin[s]), flat[start[j] : start[j] + window].tobytes()]
                    else:
                        x[0] = high
                if len(known) > 50_000:
                    yield flush()
        yield flush()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for anchor, low, content, at, words in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (anchor, low, content, at - 1):
                    if held:
                        out.append((*now[:2], b"".join(held)))
                    held = [words]
                else:
                    held.append(words[-8:])
                now = anchor, low, content, at
        if held:
            out.append((*now[:2], b"".join(held)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.binary()))], ["anchor", "low", "words"])

    summed = spans.select("id", "anchor", "content", "words").mapInArrow(sums, "h long, high long, anchor long, low long, content long, at int, words binary")
    shared = summed.groupBy("h").agg(F.max("high").alias("high"), F.min(F.struct("low", "anchor", "content", "at", "words")).alias("x")).where("x.low < high").select("x.*")
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = shared.select("anchor", "low", "content", "at", "words").repartition(parts, "anchor", "content").sortWithinPartitions("anchor", "low", "content", "at")
    return placed.mapInArrow(runs, "anchor long, low long, words binary")


def _hot_matched(spans: DataFrame, window: int, block: int) -> DataFrame:
    """(id, content, starts) of windows that a smaller document holds, for anchors of many contents."""
    context = spans.sparkSession.sparkContext
    sketch = context.broadcast(_sketched(spans, window))  # of a fixed size
    reference = _reference(spans, sketch, window).checkpoint()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                _, hashes, span, _ = _windows(part.column(3), window)
                keep = np.zeros(part.num_rows, bool)
                keep[span[sketch.value.twofold(hashes)]] = True
                yield part.filter(pa.array(keep))

    # blocks of an anchor's contents; its reference goes to each
    likely = spans.select("id", "anchor", "content", "words").mapInArrow(some, "id long, anchor long, content long, words binary")
    blocks = likely.groupBy("anchor").agg(F.ceil(F.count("*") / block).alias("blocks"))
    mine = likely.join(blocks, "anchor").select("anchor", F.pmod(F.xxhash64("content"), "blocks").alias("block"), F.lit(1).alias("kind"), "id", "content", "words")
    given = reference.join(blocks, "anchor").select("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("low").alias("id"), F.lit(None).cast("long").alias("content"), "words")
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = given.unionByName(mine).repartition(parts, "anchor", "block").sortWithinPartitions("anchor", "block", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, None
        for batch in batches:
            out = []
            for anchor, b, kind, doc, content, raw in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.frombuffer(raw, np.int64).tolist()
                if now != (anchor, b):
                    now, automaton = (anchor, b), SuffixAutomaton()
                if not kind:
                    automaton.add(words, doc)
                elif starts := automaton.covered(words, doc, window):
                    out.append((doc, content, starts))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["id", "content", "starts"])

    return units.mapInArrow(run, "id long, content long, starts array<int>")


def _kept(docs: DataFrame, window: int, gram: int, listed: bool) -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                n = last - first
                if listed:
                    s = Spans(data, offsets, window, gram)
                    starts, ends, rows = s.starts, s.ends, s.rows
                    cover = np.zeros(len(starts) + 1, np.int64)
                    whole = [set(x or ()) for x in batch.column(2).slice(first, n).to_pylist()]
                    some = [{y["content"]: y["starts"] for y in x or ()} for x in batch.column(3).slice(first, n).to_pylist()]
                    for row, content, a, b in zip(s.row.tolist(), s.content.tolist(), s.a.tolist(), s.b.tolist()):
                        if content in whole[row]:
                            cover[a] += 1
                            cover[b] -= 1
                        for i in some[row].get(content, ()):
                            cover[a + i] += 1
                            cover[a + i + window] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                else:
                    _, starts, ends, rows = byte_words(data, offsets, _WORD)
                    gone = np.zeros(len(starts), bool)
                sums = np.concatenate([[0], np.cumsum(gone)])
                left = np.flatnonzero(~gone)
                words = [data[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist())]
                at = (rows - sums[rows]).tolist()
                kept = [b" ".join(words[i:j]).decode() for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(rows), pa.int64()), pa.array(sums[rows[1:]] - sums[rows[:-1]], pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return docs.mapInArrow(run, "id long, n_words long, n_removed long, kept string")


def remove_repeats(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD,
    block: int = BLOCK, folder: str | None = None, broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """One row per row of `documents`: id, n_words, n_removed, kept.

    Words are runs of bytes other than space and 09-0D. A null text has none. Rows of one id are one document: they don't
    remove each other's words. Rows with a null id keep all words and remove none. Texts of fewer than `window` words
    keep all. Other columns are ignored whatever their names.
    """
    spark = documents.sparkSession
    base = folder or scratch(spark, "repeats")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = written(_scan(docs.where("id is not null"), window, gram), "spans")
    contents = spans.groupBy("anchor", "content").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # anchors that two documents hold: of each content the first document, and how many contents there are
    contents = contents.join(contents.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("last").alias("high")).where("low < high").select("anchor", "n"), "anchor")
    shared = spans.join(contents.select("anchor", "content", "first", "n"), ["anchor", "content"]).where("id > first or n > 1")
    lists = shared.groupBy("id").agg(
        F.collect_set(F.when(F.col("id") > F.col("first"), F.col("content"))).alias("whole"),
        F.collect_set(F.when((F.col("id") == F.col("first")) & (F.col("n") <= shard), F.col("content"))).alias("open"),
        F.collect_set(F.when((F.col("id") == F.col("first")) & (F.col("n") > shard), F.col("content"))).alias("hot"),
    )
    lists = written(lists, "lists")
    ids = lists.select("id")
    touched = with_ids(docs, ids, "id", "left_semi", broadcast_ids)
    looked = with_ids(docs, lists.where("size(open) + size(hot) > 0").select("id"), "id", "left_semi", broadcast_ids)
    open_spans = written(_open_spans(looked.join(lists, "id"), window, gram), "open")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sharded = open_spans.where("not hot").repartition(parts, "anchor").sortWithinPartitions("anchor", "id")
    found = _matched(sharded, window)
    hot = _hot_matched(open_spans.where("hot"), window, block)
    some = found.unionByName(hot).groupBy("id").agg(F.collect_list(F.struct("content", "starts")).alias("some"))
    marked = lists.select("id", "whole").join(some, "id", "left").select("id", "whole", "some")
    out = _kept(touched.join(marked, "id").select("id", "text", "whole", "some"), window, gram, True)
    rest = _kept(with_ids(docs, ids, "id", "left_anti", broadcast_ids).select("id", "text"), window, gram, False)
    return out.unionByName(rest).withColumnRenamed("id", id_col)


def brute_force(rows: list[tuple], window: int = WINDOW) -> dict:
    """The contract window by window, for tests: id -> (n_words, n_removed, sha256)."""
    import re

    first: dict[tuple, int] = {}
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    for d, w in split.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out

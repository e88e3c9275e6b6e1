"""Join of near-duplicate texts: Jaccard similarity of word 5-grams, by a MinHash LSH forest with exact verification.

A document's signature is `trees` sequences of least hashes. A tree of the forest is the sorted list of one sequence of
every document, a prefix trie in the order of its leaves: documents that share a prefix stand together, in a run. Matching
begins with the full sequences. After each length the pairs that share a prefix are verified, and the links found say what
share of all links that length finds: a link of similarity s is found with probability 1 - (1 - s^length)^trees, so it
stands for one over that. The prefix is shortened by one until the estimate reaches `recall`, or until a pair at the very
threshold is found with that probability, whatever has been found.

Pairs of runs up to `all_pairs` documents are rows, at most trees * (all_pairs - 1) for a document. Longer runs are large groups of near copies, whose pairs would be too
many rows: at the last length, runs that share documents are one group, and a group is dealt in blocks. Each two blocks are one unit of work,
which compares all their pairs by the full shingle sets and hands on how many links each document has and a spanning
forest of them. The work grows with the square of a group, the rows with the number of its blocks. Copies of one text are
one entry. Every candidate pair is verified on the texts' full shingle sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.folders import shared_folder
from tidemark.llm.graph import BROADCAST_IDS, components, dealt_anew, release, with_ids
from tidemark.llm.kernels import U64, byte_words, gram_hashes, mix, slice_hashes, text_chunks

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.9995
VALUE = 4  # bytes that are kept of each least hash
ALL_PAIRS = 32
BLOCK = 400  # texts of a block on average
BLOCK_BYTES = 1 << 23  # of their shingle hashes

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def found_with(similarity, length: int, trees: int):
    """Probability that a pair meets in some tree at this prefix length."""
    return 1 - (1 - similarity**length) ** trees


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability `recall`; 1 at least."""
    return next((k for k in range(depth, 0, -1) if found_with(threshold, k, trees) >= recall), 1)


def estimated_recall(links: DataFrame, length: int, trees: int) -> float:
    """Share of all links that this length finds, by the similarities of those found; 0 without any."""
    p = found_with(F.greatest(F.least("similarity", F.lit(1.0)), F.lit(1e-3)), length, trees)
    n, whole = links.agg(F.count("*"), F.sum(1 / p)).first()
    return n / whole if n else 0.0


def shingles(data: bytes, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word k-grams of each text, and for each text the index of its first (one entry more at the end).
    A text of fewer words, but not none, has one shingle of all of them."""
    raw, starts, ends, rows = byte_words(data, offsets, _WORD)
    words = slice_hashes(raw, starts, ends)
    counts = np.diff(rows)
    grams = gram_hashes(words, k)
    fits = np.arange(len(grams)) + k <= np.repeat(rows[1:], counts)[: len(grams)]
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    index = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(index[-1], U64)
    owner = np.repeat(np.arange(len(counts)), n)
    long = counts[owner] >= k
    out[long] = grams[fits]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[index[i]] = mix(np.array([xxhash.xxh64_intdigest(words[rows[i] : rows[i + 1]].tobytes())], U64))[0]
    return out, index


def signatures(hashes: np.ndarray, index: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Least hashes under trees * depth permutations, for texts that have shingles."""
    some = np.flatnonzero(np.diff(index))
    out = np.zeros((len(some), trees * depth), U64)
    random = np.random.default_rng(20).integers(1, 2**63, (trees * depth, 2), np.uint64)
    for j, (a, b) in enumerate(random):
        out[:, j] = np.minimum.reduceat(hashes * (a | U64(1)) + b, index[some]) if len(some) else 0
    return out


def _signed(docs: DataFrame, k: int, trees: int, depth: int) -> DataFrame:
    """id, key (of the text), and its sequences one after the other, VALUE bytes for each least hash; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                hashes, index = shingles(data, offsets, k)
                raw = (mix(signatures(hashes, index, trees, depth)) >> U64(64 - 8 * VALUE)).astype(f"<u{VALUE}")
                rows = iter(raw)
                sequences = [next(rows).tobytes() if n else None for n in np.diff(index).tolist()]
                o = offsets.tolist()
                keys = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(o, o[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(keys, pa.binary()), pa.array(sequences, pa.binary())], ["id", "key", "sequences"])

    return docs.mapInArrow(run, "id long, key binary, sequences binary")


def _runs(firsts: DataFrame, length: int, trees: int, depth: int) -> DataFrame:
    """head, id, n, least: every document of every run of two or more at this prefix length, the run's size and its
    smallest id. A prefix that one document has goes before anything is sorted."""
    head = lambda t: F.xxhash64(t, F.substr("sequences", t * (VALUE * depth) + 1, F.lit(VALUE * length)))
    forest = firsts.where("sequences is not null").select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), head)).alias("head"))
    sizes = forest.groupBy("head").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    return forest.join(dealt_anew(sizes), "head").select("head", "id", "n", "least")


def _short_pairs(runs: DataFrame) -> DataFrame:
    """Pairs (a, b) of each run, whose rows stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, members = None, []

        def flush():
            a, b = zip(*out) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for head, doc in zip(*(c.to_pylist() for c in batch.columns)):
                if head != now:
                    now, members = head, []
                out.extend((x, doc) for x in members if x != doc)
                members.append(doc)
                if len(out) > 20_000:
                    yield flush()
        yield flush()

    return runs.mapInArrow(run, "a long, b long")


def _shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """id, set: the distinct shingle hashes of each text, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                hashes, index = shingles(data, offsets, k)
                sets = [np.unique(hashes[i:j]).tobytes() for i, j in zip(index.tolist(), index[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sets, pa.binary())], ["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, set binary")


def similarities(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of every set of x to every set of y, which may be x itself; no set is empty."""
    sets = x if y is x else x + y
    sizes = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(at, minlength=len(values)) > 1  # the others are in no two sets
    at, owner = (np.cumsum(shared) - 1)[at[shared[at]]], owner[shared[at]]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((len(x), len(y)), np.float32)
    for c in range(0, int(shared.sum()), 2048):
        i, j = np.searchsorted(at, [c, c + 2048])
        m = np.zeros((len(sets), 2048), np.float32)
        m[owner[i:j], at[i:j] - c] = 1
        common += m[: len(x)] @ m[len(sets) - len(y) :].T
    common = common.astype(float)
    same = common if y is not x else common * (1 - np.eye(len(x))) + np.diag(sizes)
    return same / (sizes[: len(x), None] + sizes[len(sets) - len(y) :] - same)


def spanning(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph."""
    left, edges = np.ones(len(adjacent), bool), []
    for start in np.flatnonzero(adjacent.any(axis=1)).tolist():
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            u = todo.pop()
            new = np.flatnonzero(adjacent[u] & left).tolist()
            left[new] = False
            edges += [(u, v) for v in new]
            todo += new
    return edges


def _units(sets: DataFrame, groups: DataFrame, parts: int, block: int, block_bytes: int) -> DataFrame:
    """component, i, j, block, id, set: every set once for each block of its group, rows of one unit (i, j) together."""
    sizes = sets.select("id", F.length("set").alias("bytes")).join(groups, "id").groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = sizes.select("component", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).alias("blocks"))
    placed = groups.join(dealt_anew(blocks), "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = placed.select("component", "id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    units = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id").join(sets, "id")
    return units.select("component", "i", "j", "block", "id", "set").repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "block", "id")


def _compared(units: DataFrame, threshold: float, whole: bool) -> DataFrame:
    """(a, b, similarity, n) of all pairs of each unit: with `whole` its links (n null); without, a spanning forest of
    them (n and similarity null) and for each end a of links their number n (b null)."""

    def unit(i, j, rows):
        ids = np.array([r[1] for r in rows])
        sets = [np.frombuffer(r[2], U64) for r in rows]
        n = sum(r[0] == i for r in rows)
        x, y = (slice(0, n), slice(0, n)) if i == j else (slice(0, n), slice(n, len(rows)))
        if n == 0 or n == len(rows) and i != j:
            return
        left = sets[x]
        s = similarities(left, left if i == j else sets[y])
        linked = (s >= threshold) & (ids[x, None] != ids[y])
        if whole:
            for a, b in zip(*np.nonzero(np.triu(linked) if i == j else linked)):
                p, q = int(ids[x][a]), int(ids[y][b])
                yield min(p, q), max(p, q), float(s[a, b]), None
            return
        if i != j:
            full = np.zeros((len(rows), len(rows)), bool)
            full[x, y], full[y, x] = linked, linked.T
            linked = full
        names = ids.tolist()
        yield from ((names[a], names[b], None, None) for a, b in spanning(linked))
        yield from ((names[a], None, None, d) for a, d in enumerate(linked.sum(axis=1).tolist()) if d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            now, rows = None, []
            for batch in batches:
                for *key, block, doc, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if key != now:
                        if rows:
                            yield from unit(*now[1:], rows)
                        now, rows = key, []
                    rows.append((block, doc, data))
            if rows:
                yield from unit(*now[1:], rows)

        found = results()
        while part := list(itertools.islice(found, 20_000)):
            arrays = [pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "similarity", "n"])

    return units.mapInArrow(run, "a long, b long, similarity double, n long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose shingle sets have at least this Jaccard similarity."""
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, _, data, offsets in text_chunks(column):
            hashes, index = shingles(data, offsets, k)
            out += [np.unique(hashes[i:j]) for i, j in zip(index.tolist(), index[1:].tolist())]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                left, values = part.column(0).to_pylist(), []
                for row, y in enumerate(sets(part.column(3))):
                    if left[row] != last[0]:
                        last = left[row], sets(part.column(2).slice(row, 1))[0]
                    x = last[1]
                    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                        values.append(0.0)
                        continue
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    values.append(common / (len(x) + len(y) - common) if len(x) else 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values)], ["a", "b", "similarity"])

    return joined.mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def near_duplicates(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD,
    trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, all_pairs: int = ALL_PAIRS, block: int = BLOCK, broadcast_ids: int = BROADCAST_IDS,
) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    classes: one row per row of `documents` with an id: id, copy_of (smallest id with the very same text), class_id
    (smallest id that links and copies lead to), n_links (links of its text to different texts, plus its other copies).
    links: (a, b, similarity) between the first copies of different texts; those of groups with runs of more than
    `all_pairs` texts are computed when they are read, and may be as many as the pairs of the group.

    A null text is an empty one; texts without words are classed by being equal only. Rows of one id are one document.
    """
    shared_folder(documents.sparkSession)  # for checkpoints
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    signed = _signed(docs, shingle, trees, depth).checkpoint()
    # copies are summed in each task, however many one text has
    texts = signed.groupBy("key").agg(F.min("id").alias("copy_of"), F.count("*").alias("n_copies"), F.min_by("sequences", "id").alias("sequences")).checkpoint()
    firsts, texts = texts.select(F.col("copy_of").alias("id"), "sequences"), texts.drop("sequences")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = few = None
    for length in range(depth, 0, -1):
        runs = _runs(firsts, length, trees, depth).checkpoint()
        pairs = _short_pairs(runs.where(F.col("n") <= all_pairs).select("head", "id").repartition(parts, "head").sortWithinPartitions("head", "id")).distinct()
        pairs = (pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")).checkpoint()
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        new = verified(pairs, with_ids(docs, ends, "id", "left_semi", broadcast_ids), shingle, threshold).checkpoint()
        # in as few tasks as one length has, however many there are
        seen, few = (new_ if old is None else old.unionByName(new_).coalesce(parts) for old, new_ in ((seen, pairs), (few, new)))
        release(documents.sparkSession)
        if length <= prefix_length(threshold, trees, depth, recall) or estimated_recall(few, length, trees) >= recall:
            break
    groups = components(runs.where((F.col("n") > all_pairs) & (F.col("id") != F.col("least"))).select(F.col("id").alias("a"), F.col("least").alias("b"))).checkpoint()
    # pairs of one group are compared there
    few = few.join(groups.select(F.col("id").alias("a"), F.col("component").alias("_a")), "a", "left").join(groups.select(F.col("id").alias("b"), F.col("component").alias("_b")), "b", "left")
    few = few.where("_a is null or _b is null or _a <> _b").select("a", "b", "similarity").checkpoint()
    sets = _shingle_sets(with_ids(docs, groups.select("id"), "id", "left_semi", broadcast_ids), shingle).where("length(set) > 0").checkpoint()
    units = _units(sets, groups, parts, block, BLOCK_BYTES)
    dense = _compared(units, threshold, False).checkpoint()
    links = few.unionByName(_compared(units, threshold, True).select("a", "b", "similarity"))
    ones = few.select(F.col("a").alias("copy_of"), F.lit(1).cast("long").alias("n")).union(few.select("b", F.lit(1).cast("long")))
    degree = ones.union(dense.where("b is null").select("a", "n")).groupBy("copy_of").agg(F.sum("n").alias("degree"))
    edges = few.select("a", "b").union(dense.where("b is not null").select("a", "b"))
    roots = components(edges).withColumnRenamed("id", "copy_of")
    info = texts.join(degree, "copy_of", "left").join(roots, "copy_of", "left")
    classes = signed.select("id", "key").join(info, "key").select(
        "id", "copy_of", F.coalesce("component", "copy_of").alias("class_id"), (F.coalesce("degree", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")
    )
    return classes.withColumnRenamed("id", id_col), links

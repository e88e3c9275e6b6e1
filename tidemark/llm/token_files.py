"""Token ids as files of independent zstandard frames with a seek table.

A file is: one zstandard frame for each document (its ids as little-endian integers of `width` bytes, with zstandard's own
content checksum); a skippable frame with each document's id; a skippable frame with the seek table of zstandard's
published seekable format (compressed size, size, xxh64 checksum of every frame, then the number of frames). A reader
takes the end of the file, then only the frames it wants; each is verified before use.

Writing: documents are dealt by range of id, at most MOST_RANGES ranges; each task encodes its range in order and begins a
new file every `rows_per_file` documents. A task that runs twice writes two files of different names; the manifest, a
table that Spark commits, names only those whose task succeeded, and readers go by the manifest.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import _held, byte_letters

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

CACHE = 1_000_000
ROWS_PER_FILE = 10_000
MOST_RANGES = 20_000
_STOP = re.compile(r"[a-z0-9À-ÖØ-öø-ÿ][.,]\Z")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MARK = "\x01"
#: Characters that str.split() takes for white space and the vocabularies' normaliser doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_GAP = re.compile("[\t-\r \x85\xa0  -     　]+")


class Encoder:
    """The tokenizers library, asked once for each distinct run of non-space. Right for vocabularies that drop white
    space between pre-tokens, take A-Z as a-z and have no special string with white space; checked when the file is
    read, else whole texts go to the library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = [self.whole(t) for t in ("a b,", "A", "b ,", " a\n\t b ,")]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.whole(MARK)
        fine = len(self.mark) == 1 and self.whole(f"a {MARK} b {MARK}") == [*probe[1], *self.mark, *self.whole("b"), *self.mark]
        self.by_words = fine and probe[0] == probe[1] + probe[2] == probe[3] and not any(_GAP.search(t) for t in special)
        #: A text with one of these isn't lower-cased, nor its words put together.
        self.special = [os.path.commonprefix(special)] if os.path.commonprefix(special) else [t for t in special if t]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = {b: c for b, c in enumerate(byte_letters()) if b > 127}
        self.by_letters = self.by_words and all(self.whole(w) == [t.id for t in self.tokenizer.model.tokenize(w.encode().decode("latin-1").translate(self.letters))] for w in ("a", "straßen", "zzyxça", "éèÿþ"))
        self.stops = {c: np.array(self.whole(c), "<u4").tobytes() for c in ".,"}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def holds_special(self, text: str) -> bool:
        return any(t in text for t in self.special)

    def words(self, text: str) -> list[str]:
        """Runs of non-space that are encoded by themselves; fewer differ if A-Z are lower-cased."""
        if not self.holds_special(text):
            text = text.encode().translate(_LOWER).decode()
        return [w for w in _GAP.split(text) if w] if _ODD.search(text) else text.split()

    def learn(self, new: list[str]) -> None:
        """Many words in one call, each followed by a word that is one id and occurs nowhere else."""
        plain = [w for w in new if MARK not in w and not self.holds_special(w)]
        for w in set(new).difference(plain):
            self.known[w] = np.array(self.whole(w), "<u4").tobytes()
        # a comma or full stop after a letter is a pre-token of its own at the end of a word
        ends = [w for w in plain if _STOP.search(w)]
        plain = {w for w in {w[:-1] for w in ends}.union(set(plain).difference(ends)) if w not in self.known}
        if self.by_letters:  # a word of letters that the normaliser leaves alone is one pre-token: the model itself takes it
            model, known, put = self.tokenizer.model.tokenize, self.known, struct.Struct
            for w in filter(_LETTERS.fullmatch, plain):
                ids = [t.id for t in model(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))]
                known[w] = put(f"<{len(ids)}I").pack(*ids)
        plain = [w for w in plain if w not in self.known]
        step = 256
        for i in range(0, len(plain), step * 64):
            groups = [plain[j : j + step] for j in range(i, min(i + step * 64, len(plain)), step)]
            texts = [f" {MARK} ".join(g) for g in groups]
            for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cut = np.flatnonzero(ids == self.mark[0]).tolist()
                raw = ids.tobytes()
                if len(cut) != len(g) - 1:
                    raise ValueError("words and ids don't match")
                for w, x, y in zip(g, [0, *(c + 1 for c in cut)], [*cut, len(ids)]):
                    self.known[w] = raw[4 * x : 4 * y]
        for w in ends:
            self.known[w] = self.known[w[:-1]] + self.stops[w[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        words = [self.words(t or "") for t in texts]
        distinct = set().union(*words)
        new = distinct.difference(self.known)
        if len(new) + len(self.known) > CACHE // 2:  # words of the last two generations are known
            self.known, self.older, new = {}, self.known, distinct
        for w in new & self.older.keys():
            self.known[w] = self.older[w]
        if new := new.difference(self.known):
            self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


def seek_table(sizes: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0x80, SEEKABLE)
    return struct.pack("<II", SEEK_TABLE, len(body)) + body


def doc_index(ids: list[int | None]) -> bytes:
    valid = np.array([i is not None for i in ids], np.uint8).tobytes()
    body = np.array([i or 0 for i in ids], "<i8").tobytes() + valid
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


class TokenFile:
    """Reader of one file: ids of the documents, in order, and the ids of any of them."""

    def __init__(self, uri: str) -> None:
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"{uri}: no seek table")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.sizes = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        head = self._at(int(self.at[-1]) + 8, 9 * n)
        ids, valid = np.frombuffer(head[: 8 * n], "<i8"), np.frombuffer(head[8 * n :], np.uint8)
        self.doc_ids = [int(i) if v else None for i, v in zip(ids, valid)]
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def tokens(self, i: int, width: int) -> np.ndarray:
        data = self.unpack.decompress(self._at(int(self.at[i]), int(self.sizes[i, 0])), max_output_size=int(self.sizes[i, 1]) or 1)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sizes[i, 2]:
            raise ValueError(f"frame {i}: checksum differs")
        return np.frombuffer(data, f"<u{width}")


def write_tokens(
    documents: DataFrame, path: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1,
    rows_per_file: int = ROWS_PER_FILE, level: int = 1,
) -> DataFrame:
    """Encode every text, append `end_id`, write the files under `folder`; returns the manifest.

    Ids are written in ascending order of the document id: null ids first, rows of one id in the order of a hash of their
    texts. A null text is empty (its frame holds the end id alone). An empty table writes no file. Other columns are
    ignored whatever their names. Manifest: file (long, in order of ids; the range it is of in its upper half), uri,
    n_docs, n_tokens, width (bytes of an id).
    """
    spark = documents.sparkSession
    run_folder = f"{folder}/tokens-{uuid.uuid4().hex}"
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges = min(MOST_RANGES, max(1, -(-docs.count() // rows_per_file)))
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, pack = _held(Encoder, path), zstandard.ZstdCompressor(level=level, write_checksum=True)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        part, out, done = TaskContext.get().partitionId(), None, []

        def close():
            out["stream"].write(doc_index(out["ids"]) + seek_table(out["sizes"]))
            out["stream"].close()
            done.append(((part << 32) + len(done), out["uri"], len(out["ids"]), out["tokens"], width))

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                for doc, raw in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist())):
                    raw += end
                    if width == 2:
                        raw = np.frombuffer(raw, "<u4").astype("<u2").tobytes()
                    if out and len(out["ids"]) >= rows_per_file:
                        close()
                        out = None
                    if out is None:
                        uri = f"{run_folder}/{part:08d}-{len(done):08d}-{uuid.uuid4().hex}.zst"
                        system, where = _open(uri)
                        system.create_dir(os.path.dirname(where), recursive=True)
                        out = {"uri": uri, "stream": system.open_output_stream(where, compression=None), "ids": [], "sizes": [], "tokens": 0}
                    frame = pack.compress(raw)
                    out["stream"].write(frame)
                    out["ids"].append(doc)
                    out["sizes"].append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                    out["tokens"] += len(raw) // width
        if out:
            close()
        names = ["file", "uri", "n_docs", "n_tokens", "width"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

    order = [F.asc_nulls_first("id"), F.xxhash64("text")]
    placed = docs.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed.mapInArrow(write, "file long, uri string, n_docs long, n_tokens long, width int").write.parquet(f"{run_folder}/manifest")
    return spark.read.parquet(f"{run_folder}/manifest")


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), tokens (array), crc32 (of the ids as little-endian unsigned 32-bit
    integers), read from the files. With `wanted`, only those documents' frames are read."""
    spark = manifest.sparkSession
    m = manifest.withColumn("range", F.shiftright("file", 32))
    sums = sorted((r["range"], r["n"]) for r in m.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect())  # MOST_RANGES at most
    bases = spark.createDataFrame([(r, sum_ - n) for (r, n), sum_ in zip(sums, accumulate(n for _, n in sums))], "range long, base long")
    w = Window.partitionBy("range").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = m.join(F.broadcast(bases), "range").withColumn("before", F.col("base") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    placed = placed.select("uri", "width", "before").repartition(max(1, min(MOST_RANGES, manifest.count())))
    only = None if wanted is None else set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source, width = TokenFile(row["uri"]), row["width"]
                starts = row["before"] + np.concatenate([[0], np.cumsum(source.sizes[:, 1] // width)])
                chosen = [i for i, d in enumerate(source.doc_ids) if only is None or d in only]
                for k in range(0, len(chosen), 256):
                    part = chosen[k : k + 256]
                    tokens = [source.tokens(i, width) for i in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([source.doc_ids[i] for i in part], pa.int64()), pa.array(starts[part], pa.int64()), pa.array([len(t) for t in tokens], pa.int64()), pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64()), pa.array([t.astype(np.int64) for t in tokens], pa.list_(pa.int64()))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "tokens"],
                    )

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, tokens array<long>")

"""Line dedup by a log-template tree.

Every line goes down a tree of fixed depth: by its number of tokens, then by its first `depth` tokens (a token with a
digit is a variable field, <*>). In a leaf, tokens that stand at their place in fewer than `min_docs` documents become
variable fields too; what is left of a line is its template. A template that occurs in `min_docs` documents or more
recurs, where all lines of the leaf count that have its constants. Its lines are dropped from every document but the one
with the smallest id; a line of several such templates goes with the one of most constants.

Shuffles carry one row for each distinct line and document, counted before they move; leaves that too few documents
reach end there, so tokens are only counted in the few leaves that can hold a template. Only templates and their lines
come back to the texts: as a broadcast table while there are at most `broadcast_rows` of them, else by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.folders import scratch

MIN_DOCS = 10
DEPTH = 3
CONSTANT = 0.6  # least share of a template's tokens that are not variable fields
BROADCAST_ROWS = 500_000
BLOCK = 500  # lines or templates of a leaf that are compared at once

_FIELD = re.compile(r"\S*\d\S*")
_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")


def parse(line: str, depth: int = DEPTH) -> tuple[int, int, str] | None:
    """(leaf, hash, line with <*> for tokens that hold a digit, tokens apart by one space); None for a blank line. A line
    without any constant word, of numbers and marks only, stands as it is."""
    tokens = line.split()
    if not tokens:
        return None
    masked = " ".join(tokens)
    if _DIGIT.search(masked) and any(_LETTER.search(t) and not _DIGIT.search(t) for t in tokens):
        masked = _FIELD.sub("<*>", masked)
    leaf = f"{len(tokens)} " + " ".join(masked.split(" ", depth)[:depth])
    return _hash(leaf), _hash(masked), masked


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _lines(docs: DataFrame, depth: int, leaves=None, texts: bool = False) -> DataFrame:
    """id, leaf, line (hash), and with `texts` the masked line: each line once for each row. `leaves`: a broadcast set of
    the leaves that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = leaves.value if leaves else None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                out = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = {x[1]: x for line in (text or "").split("\n") if (x := parse(line, depth)) and (wanted is None or x[0] in wanted)}
                    out += [(doc, *x) for x in found.values()]
                columns = list(zip(*out)) or [()] * 4
                kinds = [part.column(0).type, pa.int64(), pa.int64(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays[: 3 + texts], ["id", "leaf", "line", "text"][: 3 + texts])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, leaf long, line long" + ", text string" * texts)


def _forms(shapes: DataFrame, rare) -> DataFrame:
    """leaf, line, template, constants: every line with every template of a rare line of its leaf whose constants it has.
    Lines and templates of a leaf are dealt in blocks, and each block of lines meets each block of templates."""
    size = lambda rows: rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    kinds = shapes.where(rare).dropDuplicates(["template"])
    lines = shapes.join(size(shapes).withColumnRenamed("blocks", "own"), "leaf").join(size(kinds).withColumnRenamed("blocks", "other"), "leaf")
    kinds = kinds.join(size(kinds).withColumnRenamed("blocks", "own"), "leaf").join(size(shapes).withColumnRenamed("blocks", "other"), "leaf")

    def dealt(rows: DataFrame, key: str, place: str, against: str, kind: int) -> DataFrame:
        rows = rows.withColumn(place, F.pmod(F.xxhash64(key), "own")).withColumn(against, F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1)))
        return rows.select("leaf", "i", "j", F.lit(kind).alias("kind"), F.col(key).alias("key"), "size", "places", "tokens")

    units = dealt(kinds, "template", "j", "i", 0).union(dealt(lines, "line", "i", "j", 1))
    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(parts, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, templates = None, []
        for batch in batches:
            out = []
            for leaf, i, j, kind, key, size, places, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (leaf, i, j) != now:
                    now, templates, table = (leaf, i, j), [], None
                if not kind:
                    templates.append((key, places, tokens))
                    continue
                if not templates:
                    continue
                if table is None:
                    table, free = np.zeros((len(templates), size), np.int64), np.ones((len(templates), size), bool)
                    for row, (_, p, t) in enumerate(templates):
                        table[row, p], free[row, p] = t, False
                    constants = (~free).sum(axis=1)
                has, at = np.zeros(size, np.int64), np.zeros(size, bool)
                has[places], at[places] = tokens, True
                out += [(leaf, key, templates[r][0], int(constants[r])) for r in np.flatnonzero((free | at & (table == has)).all(axis=1))]
            arrays = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["leaf", "line", "template", "constants"])

    return units.mapInArrow(run, "leaf long, line long, template long, constants int")


def recurring(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, depth: int = DEPTH, constant: float = CONSTANT, broadcast_rows: int = BROADCAST_ROWS, folder: str | None = None,
) -> DataFrame:
    """line (hash of the masked line), template, first (smallest id), n_docs: every line of every recurring template. In
    n_docs, documents with several forms of a template count once for each form that is frequent by itself."""
    spark = docs.sparkSession
    base = folder or scratch(spark, "lines")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    docs = docs.where("id is not null")
    known = written(_lines(docs, depth).groupBy("leaf", "line").agg(F.count("*").alias("n_docs"), F.min("id").alias("first")), "known")
    frequent = known.where(F.col("n_docs") >= min_docs).select("line", F.col("line").cast("string").alias("template"), "first", "n_docs")
    # only lines in leaves that enough documents reach are looked at again, and none in leaves of frequent lines alone
    rare = F.col("n_docs") < min_docs
    leaves = known.groupBy("leaf").agg(F.sum("n_docs").alias("n"), F.max(rare).alias("rare")).where((F.col("n") >= min_docs) & F.col("rare")).select("leaf")
    if leaves.count() <= broadcast_rows:
        table = spark.sparkContext.broadcast({r["leaf"] for r in leaves.collect()})
        texts = _lines(docs, depth, table, True)
    else:
        texts = _lines(docs, depth, None, True).join(leaves, "leaf")
    texts = written(texts, "texts")
    near = texts.groupBy("leaf", "line").agg(F.first("text").alias("text"), F.count("*").alias("n_docs"), F.min("id").alias("first"))
    cells = near.select("leaf", "line", "n_docs", F.posexplode(F.split("text", " ")).alias("place", "token"))
    # which tokens are constant at their place
    tokens = cells.groupBy("leaf", "place", "token").agg(F.sum("n_docs").alias("n")).where((F.col("n") >= min_docs) & (F.col("token") != "<*>"))
    kept = cells.join(tokens.select("leaf", "place", "token"), ["leaf", "place", "token"])
    shapes = (
        kept.groupBy("leaf", "line").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("shape"))
        .join(near.select("leaf", "line", "n_docs", "first", F.size(F.split("text", " ")).alias("size")), ["leaf", "line"])
        .where(F.size("shape") >= constant * F.col("size"))
    )
    shapes = written(shapes, "shapes")
    # a line is a form of its own template, and of those of other lines of the leaf that have fewer constants and else the same
    hashed = shapes.select("leaf", "line", "n_docs", "first", "size", F.col("shape.place").alias("places"), F.transform("shape", lambda x: F.xxhash64(x["token"])).alias("tokens"))
    hashed = hashed.withColumn("template", F.xxhash64("leaf", "places", "tokens"))
    forms = written(_forms(hashed, rare).join(hashed.select("leaf", "line", "n_docs", "first"), ["leaf", "line"]), "forms")
    # how many documents: exactly of rare forms, none of which has min_docs of its own, so no key here is large before it is
    # summed; a frequent form is enough by itself, and its sum is added
    members = texts.select("id", "leaf", "line").join(forms.where(rare).select("leaf", "line", "template"), ["leaf", "line"]).select("template", "id").distinct()
    counts = members.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("id").alias("first"))
    counts = counts.union(forms.where(~rare).groupBy("template").agg(F.sum("n_docs"), F.min("first"))).groupBy("template").agg(F.sum("n_docs").alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") >= min_docs)
    # of several recurring templates the one with most constants has the line
    best = forms.where(rare).select("line", "template", "constants").join(counts, "template").groupBy("line").agg(F.min(F.struct(-F.col("constants"), "first", F.col("template").cast("string").alias("template"), "n_docs")).alias("x"))
    return frequent.unionByName(best.select("line", "x.template", "x.first", "x.n_docs"))


def drop_recurring(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH,
    constant: float = CONSTANT, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows of `documents` with the lines of recurring templates dropped, and n_lines and n_dropped.

    Every row stays, with all its columns (any of its own of those two names are replaced). Blank lines stay. A null
    text stays null, with no lines. Rows with a null id keep their text and count for nothing. Rows of one id
    count as so many documents, and all keep a template's line if the id is the smallest.
    """
    docs = documents.drop("n_lines", "n_dropped")
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = recurring(light, min_docs=min_docs, depth=depth, constant=constant, broadcast_rows=broadcast_rows).select("line", "first").checkpoint()
    names = docs.columns
    at = names.index(id_col), names.index(text_col)

    def clean(batch: pa.RecordBatch, first_of) -> pa.RecordBatch:
        """first_of(row, line): smallest id of the line's template, or None."""
        texts, sums = [], []
        for row, (doc, text) in enumerate(zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist())):
            keep, n, gone = [], 0, 0
            for line in (text or "").split("\n"):
                p = parse(line, depth)
                n += p is not None
                first = first_of(row, p[1]) if p and doc is not None else None
                if first is not None and first < doc:
                    gone += 1
                else:
                    keep.append(line)
            texts.append(text if not gone else "\n".join(keep))
            sums.append((n, gone))
        columns = [batch.column(i) for i in range(len(names))]
        columns[at[1]] = pa.array(texts, columns[at[1]].type)
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1))], [*names, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
    if found.count() <= broadcast_rows:
        rows = found.select("line", "first").toPandas()
        table = docs.sparkSession.sparkContext.broadcast({int(a): int(b) for a, b in zip(rows["line"], rows["first"])})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = table.value.get
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    yield clean(batch.slice(i, 512), lambda _, line: get(line))

        return docs.mapInArrow(run, schema)

    dropped = _lines(light.where("id is not null"), depth).join(found, "line").where("first < id")
    by_doc = dropped.groupBy("id").agg(F.collect_set("line").alias("_lines")).withColumnRenamed("id", "_id")
    joined = docs.join(by_doc, docs[id_col] == by_doc["_id"], "left").select(*names, "_lines")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = [set(x or ()) for x in part.column(len(names)).to_pylist()]
                yield clean(part, lambda row, line: -np.inf if line in sets[row] else None)  # noqa: B023

    return joined.mapInArrow(run_joined, schema)

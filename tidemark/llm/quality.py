"""Quality classifier by co-training.

Two views of a document: what its text is like (shares of shouted, repeated or garbled words, and words that labelled
poor documents hold far more often than others) and its metadata (source, language, length). A logistic classifier for
each view is fitted on labelled rows and calibrated on rows held back. In each round a view labels the rows of an
unlabelled pool that it is sure of, and hands them to the other view as training rows. In the end a logistic
combination of the two calibrated views, fitted on the rows held back, scores every document.

Fitting uses a bounded sample: at most `labelled` labelled ids and `pool` other ids, the first by a hash of the id, one row
of each, of texts up to `sample_bytes` and up to `total_bytes` together. Scoring is one map over all rows and whole texts.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.folders import shared_folder

LABELLED = 4000
POOL = 3000
ROUNDS = 3
CONFIDENT = 0.98
PER_ROUND = 300
SAMPLE_BYTES = 60_000
TOTAL_BYTES = 64_000_000
KEEP = 0.5
LEXICON = 400
CHANCE = 0.004  # that a word of the lexicon is no more frequent in bad documents
SLOTS = 32  # of the hashed source and language

_MARKS = re.compile(r"[^\w\s]+")
_WORDS = re.compile(r"\w+")
DENSE = 10


def text_features(text: str) -> tuple[list[float], list[str]]:
    """Dense features of a text, and its distinct words in lower case."""
    tokens = text.split()
    n = max(1, len(tokens))
    marks = _MARKS.findall(text)
    words = set(_WORDS.findall(text.lower()))
    return [
        sum(len(m) > 1 for m in marks) / n,
        sum(map(set(marks).__contains__, tokens)) / n,
        sum(map(str.isupper, tokens)) / n,
        sum(map(eq, tokens, tokens[1:])) / n,
        len(set(tokens)) / n,
        sum(map(str.isdigit, tokens)) / n,
        min(3.0, len(marks) / n),
        min(40.0, len(text) / n) / 10,
        np.log1p(len(tokens)) / 5,
        float(len(tokens) < 20),
    ], list(words)


def meta_features(source: str | None, lang: str | None, size: int) -> list[float]:
    row = [0.0] * (2 * SLOTS + 2)
    row[xxhash.xxh32_intdigest(source or "") % SLOTS] = 1.0
    row[SLOTS + xxhash.xxh32_intdigest(lang or "") % SLOTS] = 1.0
    row[2 * SLOTS] = np.log1p(size) / 10
    row[2 * SLOTS + 1] = float(size < 200)
    return row


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    penalty = np.full(len(b), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ b)
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - penalty * b)
        b = b + step * min(1.0, 10 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _linear(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x @ b[:-1] + b[-1]


@dataclass
class Model:
    lexicon: dict[str, int]
    text: np.ndarray
    meta: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray

    def text_row(self, dense: list[float], words: list[str]) -> np.ndarray:
        out = np.zeros(DENSE + len(self.lexicon) + 1)
        out[:DENSE] = dense
        hits = self.lexicon.keys() & words
        for h in hits:
            out[DENSE + self.lexicon[h]] = 1.0
        out[-1] = min(3, len(hits))
        return out

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Probability that a document is good."""
        views = [_linear(_linear(x, b)[:, None], c) for x, b, c in ((text, self.text, self.calibration[0]), (meta, self.meta, self.calibration[1]))]
        return _sigmoid(_linear(np.clip(np.column_stack(views), -12, 12), self.combined))


def telling_words(words: list[list[str]], bad: np.ndarray, most: int = LEXICON) -> dict[str, int]:
    """Words that bad documents hold more often than chance would have it: by the exact binomial probability of as many
    bad documents or more among those that hold the word, at most CHANCE; 3 at least."""
    every, poor = Counter(), Counter()
    for ws, b in zip(words, bad):
        every.update(ws)
        if b:
            poor.update(ws)
    p = bad.mean()
    if not 0 < p < 1:
        return {}
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(bad) + 1)))])  # of factorials

    def tail(c: int, n: int) -> float:
        k = np.arange(c, n + 1)
        return float(np.logaddexp.reduce(logs[n] - logs[k] - logs[n - k] + k * np.log(p) + (n - k) * np.log1p(-p)))

    scored = ((tail(c, every[w]), w) for w, c in poor.items() if c >= 3 and c > every[w] * p)
    chosen = sorted(x for x in scored if x[0] <= np.log(CHANCE))[:most]
    return {w: i for i, (_, w) in enumerate(chosen)}


def co_train(dense: np.ndarray, words: list[list[str]], meta: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """`good`: 1, 0, or -1 for rows of the pool. None if the labelled rows are all of one kind."""
    known = np.flatnonzero(good >= 0)
    if len(np.unique(good[known])) < 2:
        return None
    held = known[np.arange(len(known)) % 5 == 0]
    if len(np.unique(good[held])) < 2:
        held = known
    train = np.setdiff1d(known, held) if len(held) < len(known) else known
    if len(np.unique(good[train])) < 2:
        train = known
    model = Model(telling_words([words[i] for i in train], good[train] == 0), *[np.zeros(1)] * 2, (np.zeros(2), np.zeros(2)), np.zeros(3))
    x = [np.array([model.text_row(d, w) for d, w in zip(dense, words)]), meta]
    given = [dict(zip(train.tolist(), good[train].tolist())) for _ in x]  # rows and labels of each view
    pool = set(np.flatnonzero(good < 0).tolist())
    weights, calibration = [None, None], [None, None]
    for turn in range(rounds + 1):
        for v in (0, 1):
            rows = np.array(sorted(given[v]))
            y = np.array([given[v][i] for i in rows.tolist()], float)
            own = np.where(good[rows] >= 0, 1.0, 0.3)
            weights[v] = logistic(x[v][rows], y, own)
            calibration[v] = logistic(_linear(x[v][held], weights[v])[:, None], good[held].astype(float), np.ones(len(held)), 0.1)
        if turn == rounds:
            break
        for v in (0, 1):
            left = np.array(sorted(pool - given[1 - v].keys()), int)
            if not len(left):
                continue
            p = _sigmoid(_linear(_linear(x[v][left], weights[v])[:, None], calibration[v]))
            sure = np.flatnonzero((p >= CONFIDENT) | (p <= 1 - CONFIDENT))
            for i in sure[np.argsort(-np.abs(p[sure] - 0.5), kind="stable")][:PER_ROUND].tolist():
                given[1 - v][int(left[i])] = int(p[i] > 0.5)
    views = np.column_stack([_linear(_linear(x[v][held], weights[v])[:, None], calibration[v]) for v in (0, 1)])
    model.text, model.meta = weights
    model.calibration = tuple(calibration)
    model.combined = logistic(np.clip(views, -12, 12), good[held].astype(float), np.ones(len(held)), 0.1)
    return model


def fit(
    documents: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS,
    sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES,
) -> Model | None:
    """Fit on a bounded sample. A document is good if its quality is 1 and it isn't toxic; rows of `labels` without id or
    quality are left out, of several for one id the lowest counts. Of several documents of one id, the one whose text
    comes first in order is looked at; a null text is an empty one."""
    session = documents.sparkSession
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    sample = {r["doc_id"]: r["good"] for r in marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()}
    rest = documents.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(pool + len(sample)).collect()
    others = [r["doc_id"] for r in rest if r["doc_id"] not in sample][:pool]
    if not sample:
        return None
    order = {d: i for i, d in enumerate([*sample, *others])}
    ids = session.createDataFrame([(int(d),) for d in order], "doc_id long")
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = documents.select("doc_id", text, "source", "lang").where(F.octet_length("text") <= sample_bytes).join(F.broadcast(ids), "doc_id", "left_semi")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "source", "lang")).alias("x")).select("doc_id", "x.*").checkpoint()
    fitting, size = [], 0
    for d, n in sorted(((r["doc_id"], r["n"]) for r in rows.select("doc_id", F.octet_length("text").alias("n")).collect()), key=lambda x: order[x[0]]):
        size += n
        if size <= total_bytes:
            fitting.append(int(d))
    if len(fitting) < rows.count():
        rows = rows.join(F.broadcast(session.createDataFrame([(d,) for d in fitting], "doc_id long")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, source, lang in zip(*(c.to_pylist() for c in batch.columns)):
                dense, words = text_features(text or "")
                out.append((doc, dense, " ".join(sorted(words)), meta_features(source, lang, len(text or ""))))
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "dense", "words", "meta"])

    found = rows.mapInArrow(run, "doc_id long, dense array<double>, words string, meta array<double>").toArrow().to_pydict()
    at = sorted(range(len(found["doc_id"])), key=lambda i: found["doc_id"][i])
    if not at:
        return None
    good = np.array([sample.get(found["doc_id"][i], -1) for i in at])
    return co_train(np.array([found["dense"][i] for i in at]), [list(map(sys.intern, found["words"][i].split())) for i in at], np.array([found["meta"][i] for i in at]), good, rounds)


def scored(
    documents: DataFrame, labels: DataFrame, *, keep: float = KEEP, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS,
    sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """The rows of `documents` with all their columns, and score and keep (score >= `keep`). `labels`: doc_id, quality, toxic.

    A null text counts as empty, a null source or language as an empty name; rows without an id are scored like others.
    Repeated ids stay rows of their own. Without labels of both kinds every score is 1. Columns named score or keep are
    replaced; an empty table gives no rows.
    """
    view = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"))
    shared_folder(documents.sparkSession)  # for checkpoints
    model = fit(view, labels, labelled=labelled, pool=pool, rounds=rounds, sample_bytes=sample_bytes, total_bytes=total_bytes)
    docs = documents.drop("score", "keep")
    names = docs.columns
    at = [names.index(c) for c in (text_col, source_col, lang_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts, sources, langs = (part.column(c).to_pylist() for c in at)
                if model is None:
                    p = np.ones(part.num_rows)
                else:
                    x = np.array([model.text_row(*text_features(t or "")) for t in texts])
                    p = np.round(model.score(x, np.array([meta_features(s, g, len(t or "")) for t, s, g in zip(texts, sources, langs)])), 6)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array(p >= keep)], [*names, "score", "keep"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema + ", score double, keep boolean")

"""The training-data operators against brute force, the libraries they must equal, round trips and held-out accuracy."""

import base64
import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, graph, html_text, kernels, line_templates, neardup, pretokens, quality, substrings, token_files, topk

os.environ["TOKENIZERS_PARALLELISM"] = "false"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "x", "word " * 3000, "é漢😀\x00\x1f  ", "a b c d e f g h", "A,B.c'd \r\n\x0b\x0c z", "same text here", "same text here"]


def docs(spark, texts, ids=None, **extra):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS).repartition(3)


def prose(rng, n, words=60):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


VOCAB = ["".join("abcdefghijklmnop"[int(c, 16)] for c in f"{i * 7919 % 65536:04x}") for i in range(3000)]


# --- tokenizers -------------------------------------------------------------------------------------------------------


def fuzz(n=1500, seed=5):
    rng = random.Random(seed)
    letters = "a b'stmdrevl  \n\t1²½é漢😀\"!?.  \x85\x1c ćⅧ"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)] + ["aaaa" * 60, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a<|endoftext|>", "<|endoftext", " 's 't'll''s", "ab" * 400]


def test_scan_is_associative():
    _, table, _, _, identity = pretokens._monoid()
    k = len(table)
    for a in range(k):
        assert table[a, identity] == table[identity, a] == a
        for b in range(k):
            assert (table[table[a, b]] == table[a, table[b]]).all()


def test_byte_bpe_equals_library():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, texts = bpe.Codec(path), fuzz()
    at = 0
    for _, _, data, offsets in kernels.text_chunks(pa.array(texts), 700):
        ids, index = codec.encode(data, offsets)
        text, where, _ = codec.decode(ids, index)
        assert text == data and (where == offsets).all()
        for i, j in zip(index, index[1:]):
            assert ids[i:j].tolist() == library.encode_ordinary(texts[at]), repr(texts[at])
            at += 1
    assert at == len(texts)


def test_every_code_point():
    """Classes of all code points are the libraries' own, whatever Python's Unicode version is."""
    import tiktoken
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library, codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(path)
    counter, tokenizer = bpe.Counter(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (not 0x40000 <= c < 0xE0000 or c % 0x10000 < 64)]  # planes 4 to 13 hold nothing
    forms = ["a{0}7a", "1{0}1 {0}", "!{0}! {0}b", "{0}{0} {0}"]
    for i in range(0, len(points), 4096):
        texts = [" ~ ".join(f.format(chr(c)) for f in forms) for c in points[i : i + 4096]]
        for _, _, data, offsets in kernels.text_chunks(pa.array(texts)):
            ids, index = codec.encode(data, offsets)
            got = [ids[x:y].tolist() for x, y in zip(index, index[1:])]
            assert counter.count(data, offsets).tolist() == [len(e.ids) for e in tokenizer.encode_batch_fast(texts[: len(got)], add_special_tokens=False)]
            assert got == library.encode_ordinary_batch(texts[: len(got)], num_threads=2)
            texts = texts[len(got) :]


def test_counts_equal_library(spark):
    from tokenizers import Tokenizer

    texts = fuzz(800) + ODD
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    out = bpe.token_counts(docs(spark, texts), P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in out] == want
    assert [r["n_bytes"] for r in out] == [len((t or "").encode()) for t in texts]
    assert [r["over_limit"] for r in out] == [n > 1024 for n in want]


def test_encode_decode_frames(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encoded(docs(spark, ODD), path)
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(out, path).collect()}
    assert [bytes(back[i]).decode() for i in range(len(ODD))] == [t or "" for t in ODD]
    r = out.where("doc_id = 4").first()
    assert r["offsets"] == sorted(r["offsets"]) and r["offsets"][0] == 0
    kept = bpe.round_trip(docs(spark, ODD), path, keep=["lang", "text"]).collect()
    assert all(r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in kept)
    assert bpe.round_trip(docs(spark, []), path).count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, *fuzz(60), "İ. ﬁ, Ǆ_, THE end. <|endoftext|>x"]
    manifest = token_files.write_tokens(docs(spark, texts), path, f"file://{tmp_path}", rows_per_file=17)
    assert manifest.count() > 1
    start = 0
    for (i, t), r in zip(enumerate(texts), token_files.read_tokens(manifest).orderBy("doc_id").collect()):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["tokens"], r["ids_crc32"]) == (i, start, ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r["doc_id"] for r in token_files.read_tokens(manifest, [3]).collect()] == [3]
    uri = manifest.orderBy("file").first()["uri"].removeprefix("file://")
    raw = open(uri, "rb").read()
    source = token_files.TokenFile(uri)
    first, n = int(source.sizes[0, 0]), len(source.sizes)
    for place, error, message in ((first - 1, zstandard.ZstdError, "checksum"), (len(raw) - 9 - 12 * n + 8, ValueError, "checksum differs"), (len(raw) - 1, ValueError, "no seek table")):
        broken = bytearray(raw)
        broken[place] ^= 255  # the frame's own checksum, that of the seek table, its last byte
        open(uri, "wb").write(broken)
        with pytest.raises(error, match=message):
            token_files.TokenFile(uri).tokens(0, 2)
    open(uri, "wb").write(raw)
    assert len(token_files.TokenFile(uri).tokens(0, 2)) == 1
    assert token_files.read_tokens(token_files.write_tokens(docs(spark, []), path, f"file://{tmp_path}")).count() == 0
    twice = token_files.read_tokens(token_files.write_tokens(docs(spark, ["a", "b", None], [5, 5, 1]), path, f"file://{tmp_path}"))
    assert sorted(r["start"] for r in twice.collect()) == [0, 1, 3]


def test_files_of_a_range_follow_each_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "MOST_RANGES", 2)
    texts = [f"word {i} and more" for i in range(100)]
    manifest = token_files.write_tokens(docs(spark, texts).withColumn("id", F.lit("x")), P.path("word_bpe_49k.json"), f"file://{tmp_path}", rows_per_file=7)
    assert manifest.count() > 10
    rows = token_files.read_tokens(manifest).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(100))
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()


def test_special_strings_without_a_common_prefix():
    encoder = token_files.Encoder(P.path("word_bpe_49k.json"))
    encoder.special = ["[A]", "<B>"]
    assert encoder.words("x [A] Y") == ["x", "[A]", "Y"] and encoder.words("X Y") == ["x", "y"]


# --- decontamination --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_decontamination(spark, block_bytes):
    rng = random.Random(1)
    passages = [prose(rng, n) for n in (20, 8, 3, 1, 9)]
    bench = list(enumerate(passages)) + [(9, None), (None, "zz yy"), (2, passages[0]), (7, "... !")]
    texts = [prose(rng, 30) + " " + passages[i % 5].upper() + "! " + passages[(i * 3) % 5] + " " + prose(rng, 5) for i in range(12)] + ODD + [passages[0][:60], " ".join(passages)]
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = decontaminate.contamination(docs(spark, texts), b, block_bytes=block_bytes)
    got = sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("d"), "contaminated").collect())
    assert got == sorted(decontaminate.brute_force(list(enumerate(texts)), [x for x in bench if x[0] is not None]))
    cleaned = {r["doc_id"]: r["cleaned"] for r in out.collect()}
    assert passages[0].upper() not in cleaned[0]
    assert decontaminate.contamination(docs(spark, texts), b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.flagged(docs(spark, ["a", passages[1]]), b, min_items=1).where("contaminated").count() == 1


# --- lines ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [1000, 0])
def test_line_templates(spark, rows):
    rng = random.Random(2)
    fixed, texts = "all rights are kept by us", []
    for i in range(12):
        name = prose(rng, 1)
        texts.append("\n".join([prose(rng, 9), fixed if i % 2 else f"this is page {i} of the book", f"written for you by {name} in town", "", prose(rng, 7)]))
    out = {r["doc_id"]: r for r in line_templates.drop_recurring(docs(spark, texts + ODD), min_docs=5, broadcast_rows=rows).collect()}
    assert len(out) == len(texts) + len(ODD)
    assert fixed in out[1]["text"] and "this is page 0 of" in out[0]["text"] and "written for you" in out[0]["text"]
    for i in range(2, 12):
        want = [x for k, x in enumerate(texts[i].split("\n")) if k in (0, 3, 4)]
        assert out[i]["text"].split("\n") == want and out[i]["n_dropped"] == 2 and out[i]["n_lines"] == 4
    assert out[12]["text"] is None and out[13]["text"] == ""
    same = line_templates.drop_recurring(docs(spark, ["same words"] * 6, [None, 1, 1, 1, 1, 2]), min_docs=5)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in same.collect()) == [(0, "same words"), *[(1, "same words")] * 4, (2, "")]
    assert line_templates.drop_recurring(docs(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [1000, 0])
def test_frequent_and_rare_forms_of_a_template(spark, rows):
    names = ["bob"] * 20 + ["ann"] * 3 + ["eve", "joe", "sue"]
    texts = [f"written for you by {name} in town\nline {chr(97 + i)} x{chr(97 + i)} end" for i, name in enumerate(names)]
    out = {r["doc_id"]: r for r in line_templates.drop_recurring(docs(spark, texts), min_docs=10, broadcast_rows=rows).collect()}
    assert [out[i]["n_dropped"] for i in range(len(texts))] == [0] + [1] * 25
    assert "by bob in" in out[0]["text"] and all(out[i]["text"] == texts[i].split("\n")[1] for i in range(1, 26))
    few = line_templates.drop_recurring(docs(spark, texts[20:]), min_docs=10, broadcast_rows=rows)
    assert few.agg(F.sum("n_dropped")).first()[0] == 0


def template_tree(rows, min_docs, depth=3, share=line_templates.CONSTANT):
    """The definition line by line: id -> (n_lines, n_dropped, text). Rows of one id count as so many documents."""
    number, letter = re.compile(r"\d"), re.compile(r"[^\W\d_]")

    def masked(line):
        tokens = line.split()
        if any(letter.search(t) and not number.search(t) for t in tokens):
            tokens = ["<*>" if number.search(t) else t for t in tokens]
        return tuple(tokens)

    lines = [{masked(x) for x in (t or "").split("\n")} - {()} if d is not None else set() for d, t in rows]
    at = defaultdict(list)  # documents of each masked line
    for (d, _), found in zip(rows, lines):
        for x in found:
            at[x].append(d)
    leaves = defaultdict(list)
    for x in at:
        leaves[len(x), x[:depth]].append(x)
    first = {x: min(ds) for x, ds in at.items() if len(ds) >= min_docs}
    for members in leaves.values():
        stands = Counter()
        for x in members:
            for place, token in enumerate(x):
                stands[place, token] += len(at[x])
        shape = {x: {(p, t) for p, t in enumerate(x) if t != "<*>" and stands[p, t] >= min_docs} for x in members}
        shape = {x: c for x, c in shape.items() if len(c) and len(c) >= share * len(x)}
        forms = {}
        for x, c in shape.items():
            if len(at[x]) < min_docs:
                having = [y for y, other in shape.items() if c <= other]
                rare = [i for i in range(len(rows)) if any(y in lines[i] for y in having if len(at[y]) < min_docs)]
                n = len(rare) + sum(len(at[y]) for y in having if len(at[y]) >= min_docs)
                if n >= min_docs:
                    forms[frozenset(c)] = min(min(at[y]) for y in having)
        for x, c in shape.items():
            if len(at[x]) < min_docs and (fits := [(-len(f), low) for f, low in forms.items() if f <= c]):
                first[x] = min(fits)[1]
    out = []
    for d, t in rows:
        kept, n = [], 0
        for line in (t or "").split("\n"):
            x = masked(line)
            n += x != ()
            if d is None or x not in first or first[x] >= d:
                kept.append(line)
        gone = len((t or "").split("\n")) - len(kept)
        out.append((d, n, gone, t if not gone else "\n".join(kept)))
    return out


@pytest.mark.parametrize("seed,rows", [(1, 1000), (2, 1000), (3, 0)])
def test_template_tree_against_brute_force(spark, seed, rows):
    rng = random.Random(seed)
    words = [prose(rng, 1) for _ in range(40)]
    shapes = [[rng.choice(words) for _ in range(rng.randrange(1, 9))] for _ in range(8)]

    def line():
        out = list(rng.choice(shapes))
        for _ in range(rng.choice([0, 0, 1, 2])):
            out[rng.randrange(len(out))] = rng.choice([*words[:6], "7", "x9", str(rng.randrange(99)), "é1"])
        return (rng.choice([" ", "  "])).join(out)

    texts = ["\n".join(rng.choice([line(), line(), "", " ", prose(rng, 5), "1 2 3"]) for _ in range(rng.randrange(9))) for _ in range(70)] + ODD
    ids = [*range(len(texts) - 3), None, 4, 4]
    got = line_templates.drop_recurring(docs(spark, texts, ids), min_docs=5, broadcast_rows=rows).collect()
    want = template_tree(list(zip(ids, texts)), 5)
    key = lambda r: (r[0] is None, r[0] or 0, r[3] or "")
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 40


def test_footers_of_mostly_fields(spark):
    footers = ["Page {0} of 40", "Page {0}", "Updated: 2020-01-{0} 12:{0}"]
    texts = ["\n".join([*(f.format(10 + i) for f in footers), f"{i} | {i + 1}"]) for i in range(12)]
    out = {r["doc_id"]: r for r in line_templates.drop_recurring(docs(spark, texts)).collect()}
    assert out[0]["text"] == texts[0] and [out[i]["text"] for i in range(1, 12)] == [f"{i} | {i + 1}" for i in range(1, 12)]


# --- search -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block,round_bytes,head_bytes", [(64, 1 << 20, 1 << 20), (7, 2000, 0)])
def test_top_k(spark, block, round_bytes, head_bytes):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 6)).round(2)
    x[::9] = x[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1010, [1.0, None, 0.0]), (1020, [float("nan")] * 6), (1030, [1.0, 2.0]), (1040, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    out = topk.top_k(df, F.col("vec_id") % 50 == 0, block=block, round_bytes=round_bytes, head_bytes=head_bytes)
    codes = np.floor(256 * x).astype(int)
    want = set()
    for q in range(0, 300, 50):
        best = sorted((-int(codes[j] @ codes[q]), j) for j in range(300) if j != q)[:5]
        want |= {(q, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {tuple(r) for r in out.collect()} == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_of_repeated_and_huge_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1e300, 0.0]), (4, [-1e300, 1.0]), (5, [2.0**40, 2.0**40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=3, block=2).collect())
    n, far = 256 * 256, 1 << 62
    ups = [(0, 1, 3, (1 << 63) - 1), (0, 2, 5, 3 * 2**56), (0, 3, 1, 3 * n)]
    downs = [(0, 1, 4, (1 << 63) - 1), (0, 2, 2, 0), (0, 3, 2, 0)]
    assert got == sorted(ups + downs) and far > 0


def test_blocks_that_no_query_needs():
    rng = np.random.default_rng(1)
    long, short = rng.integers(-500, 500, (50, 8)), rng.integers(-2, 3, (900, 8))
    search = topk.Search(np.arange(3) + 5000, long[:3] + 1, None, 5)
    search.take(np.arange(50), long)
    assert not len(search.alive(topk._lengths(short).max()))


# --- near duplicates --------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[a] == root(a) for e in edges for a in e if e[0] != e[1])


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


@pytest.mark.parametrize("all_pairs", [12, 3])
def test_near_duplicates(spark, all_pairs):
    rng = random.Random(6)
    bases = [prose(rng, rng.randrange(80, 300)) for _ in range(30)]
    texts = [x for b in bases for x in (b, b, edited(rng, b, 1), edited(rng, b, 2), edited(rng, b, 25))] + ["a b", "a b", "a b c", *ODD]
    hot = prose(rng, 400)
    texts += [edited(rng, hot, 1) for _ in range(40)]
    sets = [set(zip(*[iter(())])) or {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if (t := x or "").split() else set() for x in texts]
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                links += (texts[i] or "") != (texts[j] or "")
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    classes, found = neardup.near_duplicates(docs(spark, texts), all_pairs=all_pairs)
    got = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert got == {i: root(i) for i in range(len(texts))} and links > 60
    assert all(r["similarity"] >= 0.8 for r in found.collect())
    empty, _ = neardup.near_duplicates(docs(spark, []))
    assert empty.count() == 0


def star(rng, n, words=200, edits=4):
    """An original and n copies of it, near it but mostly not near each other."""
    w = prose(rng, words).split()
    out = [" ".join(w)]
    for _ in range(n):
        c = list(w)
        for at in rng.sample(range(words), edits):
            c[at] = rng.choice(VOCAB)
        out.append(" ".join(c))
    return out


@pytest.mark.parametrize("block", [400, 60])
def test_near_duplicates_of_a_star(spark, block):
    texts = star(random.Random(11), 400)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 400 and len(want) < 0.1 * 400 * 399 / 2
    classes, links = neardup.near_duplicates(docs(spark, texts), block=block)
    rows = classes.collect()
    assert {r["class_id"] for r in rows} == {0}
    assert {(r["a"], r["b"]) for r in links.collect()} == want
    assert {r["doc_id"]: r["n_links"] for r in rows} == {i: sum(i in p for p in want) for i in range(len(texts))}


def test_prefix_length(spark):
    assert neardup.prefix_length(0.8, 16, 8, 0.998) == 5
    assert neardup.prefix_length(0.1, 1, 8, 0.999) == 1
    near = spark.createDataFrame([(1.0,)] * 9 + [(0.99,)], "similarity double")
    far = spark.createDataFrame([(0.8,)] * 10, "similarity double")
    assert neardup.estimated_recall(near, 8, 16) > 0.9999 > 0.95 > neardup.estimated_recall(far, 8, 16)
    assert neardup.estimated_recall(far, 5, 16) == pytest.approx(neardup.found_with(0.8, 5, 16)) and neardup.estimated_recall(far.limit(0), 8, 16) == 0


@pytest.mark.parametrize("copies,edits", [(250, 8), (5000, 8)])
def test_near_duplicates_of_one_text(spark, copies, edits):
    """One group of copies with 1 to `edits` words changed, all pairs against brute force."""
    rng = random.Random(17)
    base = prose(rng, 400)
    texts = list(dict.fromkeys(edited(rng, base, 1 + i % edits) for i in range(copies)))
    words = [t.split() for t in texts]
    plain = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    number = {g: i for i, g in enumerate(set().union(*plain))}
    sets = [np.sort([number[g] for g in x]) for x in plain]
    s = np.concatenate([neardup.similarities(sets[i : i + 500], sets) for i in range(0, len(sets), 500)])
    for _ in range(3000):
        i, j = rng.randrange(len(sets)), rng.randrange(len(sets))
        assert s[i, j] == pytest.approx(len(plain[i] & plain[j]) / len(plain[i] | plain[j]))
    linked = (s >= 0.8) & ~np.eye(len(sets), dtype=bool)
    want = {}
    for i in range(len(sets)):
        todo = [] if i in want else [i]
        while todo:
            j = todo.pop()
            if j not in want:
                want[j] = i
                todo += np.flatnonzero(linked[j]).tolist()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.near_duplicates(docs(spark, texts))[0].collect()}
    assert got == {i: (want[i], int(linked[i].sum())) for i in range(len(sets))}


# --- repeats ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard,limit", [(200, 1000), (1, 1000), (1, 0)])
def test_repeats(spark, shard, limit):
    rng = random.Random(7)
    passage, short = prose(rng, 90), prose(rng, 49)
    texts = [prose(rng, rng.randrange(5, 60)) + " " + rng.choice([passage, short, passage[30:], passage[:300]]) + "  " + prose(rng, 20) for _ in range(25)]
    texts += [*ODD, texts[3], passage, passage + " " + passage, "r " * 120, "r " * 70, edited(rng, passage, 1)]
    want = substrings.brute_force(list(enumerate(texts)))
    out = substrings.remove_repeats(docs(spark, texts), shard=shard, broadcast_ids=limit).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("k"))
    assert {r["doc_id"]: tuple(r)[1:] for r in out.collect()} == want
    assert sum(n for _, n, _ in want.values()) > 500


def test_repeats_without_ids(spark):
    text = prose(random.Random(8), 60)
    out = substrings.remove_repeats(docs(spark, [text, text, text, text], [None, 4, 4, 9]))
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out.collect()) == [(0, 0), (4, 0), (4, 0), (9, 60)]
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def test_automaton_against_search():
    rng = random.Random(9)
    for _ in range(40):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(5)]
        a = substrings.SuffixAutomaton()
        for doc, t in enumerate(texts):
            got = a.covered(t, doc, 4)
            before = {tuple(x[i : i + 4]) for x in texts[:doc] for i in range(len(x) - 3)}
            assert got == [i for i in range(len(t) - 3) if tuple(t[i : i + 4]) in before]
            a.add(t, doc)


# --- pages and quality ------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T {0}</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home page</a></li></ul></nav><!-- ad -->
<div class="ad">buy this now and more {0}</div><article><h1>Head {0}</h1><p>First <b>bold</b>ly &amp; so
on<br>next {0}.<p>More words stand here for the text.</p></article><footer>&copy; all of us here</footer></body></html>"""


def test_pages(spark):
    pages = [PAGE.format(i) for i in range(20)] + [None, "", "only words", "<nav>a b", "<<>", "<p " * 30]
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_text.extract(df).collect()}
    for i in range(20):
        assert out[i]["text"] == f"Head {i} First boldly & so on next {i}. More words stand here for the text."
        assert out[i]["n_chars"] == len(out[i]["text"]) and out[i]["url"] == f"u{i}"
    assert [out[i]["text"] for i in (20, 21, 22)] == ["", "", "only words"]
    assert html_text.extract(df.limit(0)).count() == 0
    twice = df.where("page_id < 3").union(df.where("page_id < 2").withColumn("html", F.lit(None).cast("string"))).withColumn("text", F.lit(1))
    assert sorted((r["page_id"], r["text"] != "") for r in html_text.extract(twice).collect()) == [(0, False), (0, True), (1, False), (1, True), (2, True)]


def test_pages_as_authors_write_them():
    weights = html_text.learn([PAGE.format(i) for i in range(20)])
    text = lambda inside, after="": html_text.main_text(f"<html><body><nav>a b</nav><article><h1>Head</h1><p>One two three four five.{inside}<p>Six seven eight.</article>{after}<footer>c d</footer></body></html>", weights)
    whole = "Head One two three four five. Six seven eight."
    assert text("") == whole
    assert text("<p class='share'>Tell your friends") == whole
    assert text("<ul class=comments><li>First!<li>Second <b>one</ul>") == whole
    assert text("", "<section id='comments'><p class=comment>Great read of the whole long text I think<p>Me too and more and more words</section>") == whole
    assert text("<div class='ad-box'>buy <div>now</div> here</div>") == whole
    assert text("<div class='related-work'><p>Others did so.</div>") == "Head One two three four five. Others did so. Six seven eight."
    assert text("<h2 id='comments'>On comments</h2>") == "Head One two three four five. On comments Six seven eight."
    assert text("<div class='sidebar'>never closed") == "Head One two three four five. never closed Six seven eight."
    assert text("<a title='1 > 0'>link</a>") == "Head One two three four five.link Six seven eight."
    assert html_text.main_text("<body><p>one two three four<div class=sidebar>five six", weights) == "one two three four five six"
    assert html_text.main_text("<table><tr><td class=ad>x<td>one two<tr><td>three four</table>", weights) == "one two three four"
    assert [html_text.says_aside(x) for x in ("sidebar", "acme-sidebar", "ads", "ad_300x250", "social-history", "share-price", "commentary", "adventure", "site-footer")] == [True] * 4 + [False] * 4 + [True]


def test_names_of_labelled_pages():
    w = html_text.learn([f"<body><div class='zone7 row'>x y z {i}</div><article><div class='row'>a b c d</div></article></body>" for i in range(9)])
    assert w.outside == {"zone7"}
    assert html_text.main_text("<div class=zone7>one two three</div><div class=other>four five six</div>", html_text.Weights(outside={"zone7"})) == "four five six"


@pytest.mark.parametrize("unit", ['<a b="', "<a b='>\"", "<p class=share>", "<div>", "</span>", "<!--", "<p><button><div>", "<script>", "<ul><li>", "&#", '<a b=">" ', "<", "<a", "<!"])
def test_malformed_pages_in_linear_time(unit):
    import time

    weights = html_text.Weights()
    began = time.process_time()
    html_text.main_text("word " + unit * ((1 << 20) // len(unit)), weights)
    assert time.process_time() - began < 8


def test_best_region():
    rng = random.Random(23)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, 0.5, 1.0, 2.0]) for _ in range(rng.randrange(14))]
        i, j = html_text.best_region(scores)
        best = max([0.0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
        assert sum(scores[i:j]) == best


def test_rare_telling_words():
    bad = np.arange(400) % 4 == 0
    words = [["common", *(["rare"] if i in (0, 40, 80, 120) else [])] for i in range(400)]
    assert list(quality.telling_words(words, bad)) == ["rare"]


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    out = quality.scored(d, train).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert out[out.quality == 0].keep.mean() < 0.1
    assert out[(out.quality == 1) & (out.toxic == 0)].keep.mean() > 0.95
    assert quality.scored(d.limit(5), labels.limit(0)).where("score = 1 and keep").count() == 5
    odd = quality.scored(docs(spark, ODD).withColumn("keep", F.lit("x")).withColumn("source", F.lit(None).cast("string")), labels)
    assert odd.count() == len(ODD)


def test_quality_of_odd_rows(spark):
    rng = random.Random(29)
    good = [" ".join(rng.choice(VOCAB) for _ in range(40)) + "." for _ in range(150)]
    bad = [" ".join(["BUY", "!!!", rng.choice(VOCAB).upper()] * 9) for _ in range(150)]
    texts = [x for pair in zip(good, bad) for x in pair] + [None, "", None, good[0]]
    ids = [*range(300), 300, 301, None, 0]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(200)] + [(300, 0, 0), (None, 1, 0), (5, None, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, texts, ids).withColumnsRenamed({"doc_id": "k", "text": "body"}).withColumn("text", F.lit("clash")).withColumn("score", F.lit(7))
    out = quality.scored(d, labels, id_col="k", text_col="body").collect()
    assert len(out) == len(texts) and set(out[0].asDict()) == {"k", "body", "lang", "source", "n_chars", "text", "score", "keep"}
    kept = {r["k"]: r["keep"] for r in out if r["k"] is not None and r["k"] < 300}
    assert sum(kept[i] == (i % 2 == 0) for i in range(200, 300)) > 95
    few = quality.fit(d.select(F.col("k").alias("doc_id"), F.col("body").alias("text"), "source", "lang"), labels, labelled=40, pool=5, total_bytes=6000)
    assert few is not None and quality.fit(d.select(F.col("k").alias("doc_id"), F.col("body").alias("text"), "source", "lang"), labels, total_bytes=0) is None
    assert quality.scored(docs(spark, []), labels).count() == 0


def test_pipeline_keeps_its_promises(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    before, kept = {r["doc_id"] for r in d.collect()}, d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).checkpoint()
        assert kept.columns == d.columns, name
        after = {r["doc_id"] for r in kept.collect()}
        assert after <= before, name
        if name == "line dedup":
            assert after == before
        before = after
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) > 100 and len({t for _, t in rows}) == len(rows)
    assert all(x[3] == 0 for x in decontaminate.brute_force(rows[:30], bench))
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert all(r["round_trip"] for r in last) and {r["doc_id"] for r in last} == before


def test_pipeline_keeps_one_of_a_star(spark, sf):
    import corpus_pipeline

    texts = star(random.Random(12), 300) + [prose(random.Random(13), 90)]
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    assert sorted(r["doc_id"] for r in stage(spark, docs(spark, texts), sf).collect()) == [0, 301]


@pytest.mark.parametrize("rows", ["odd", "none", "one"])
def test_pipeline_run_on_odd_tables(spark, sf, tmp_path, rows):
    import corpus_pipeline

    rng = random.Random(41)
    texts = [prose(rng, 60) for _ in range(30)]
    near = edited(rng, texts[0], 1)
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 80").first()["text"]
    table = [(i, t) for i, t in enumerate(texts)] + [(40, texts[0]), (41, near), (42, f"{texts[3]} {passage} {texts[4]}"), (None, texts[5]), (None, None), (43, None), (44, ""), (7, texts[7]), (7, prose(rng, 70))]
    table = {"odd": table, "none": [], "one": [(1, None)]}[rows]
    names = ["score", "keep", "contaminated", "n_lines", "n_dropped", "id", "heads", "tokens", "_id", "class_id"]
    d = spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "web", len(t or "")) for i, t in table], DOCS)
    d.withColumns({n: F.lit("clash") for n in names}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, None) for i in range(20)] + [(None, 0, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "round_trip"]
    got = out.collect()
    assert all(r["round_trip"] for r in got)
    ids = sorted((r["doc_id"] for r in got), key=lambda x: (x is None, x or 0))
    # labels of one kind reject nothing; copies, near copies and texts with benchmark passages go, rows without an id stay
    assert ids == {"odd": sorted([*range(30), 7, 7, 43]) + [None, None], "none": [], "one": [1]}[rows]


def test_tables_of_hashes():
    raw = np.frombuffer(b"ab ab cd", np.uint8)
    h = kernels.slice_hashes(raw, np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert h[0] == h[1] != h[2]
    g = np.array([5, 3, 3, 9, 1], np.uint64)
    assert kernels.window_minima(g, 3).tolist() == [2, 2, 4]
    assert pd.Series(kernels.member(g, np.array([3, 9], np.uint64))).sum() == 3


@pytest.mark.parametrize("name", ["op1_benchmark_decontamination", "op4_exact_top_k", "op5_jaccard_join", "op7_substring_dedup"])
def test_queries_against_sql(spark, sf, name):
    import duckdb

    from tidemark.llm import queries

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = c.execute(queries.SQL[name]).df()[df.columns].values.tolist()
    assert sorted(map(tuple, want)) == sorted(tuple(r) for r in df.collect())


def test_hot_keys_of_joins_with_own_sums(spark):
    """A third of all rows under one key: the join with the key's sums is split, and a star is one component."""
    values = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "20"}
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        rows = spark.range(60_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("u"), F.col("id").alias("v")).checkpoint()
        joined = rows.join(graph.dealt_anew(rows.groupBy("u").agg(F.min("v").alias("m"))), "u")
        joined.write.format("noop").mode("overwrite").save()
        parts = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(parts) == 60_000 and max(parts) < 20_000  # rows of the hot key alone
        star = spark.range(1, 2000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        assert {(r["component"], r["count"]) for r in graph.components(star).groupBy("component").count().collect()} == {(0, 2000)}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles(spark) -> tuple[int, set[int]]:
    """How many there were so far, and those whose files are there."""
    context = spark.sparkContext._jsc.sc()
    folders = [f.getPath() for f in context.env().blockManager().diskBlockManager().localDirs()]
    return context.newShuffleId(), {int(f.name.split("_")[1]) for d in folders for f in Path(d).glob("*/shuffle_*.data")}


def test_few_links_make_no_rounds(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 2000 + i) for i in range(60)]
    links = spark.createDataFrame(edges, "a long, b long")
    began = shuffles(spark)[0]
    few = {tuple(r) for r in graph.components(links).select("id", "component").collect()}
    assert shuffles(spark)[0] - began < 6
    assert few == {tuple(r) for r in graph.components(links, limit=0).select("id", "component").collect()}
    assert {i for i, _ in few} == {i for e in edges for i in e if e[0] != e[1]}
    assert graph.components(links.where("a > 10000")).collect() == []


def test_release(spark):
    """Shuffle files of tables that nothing holds go, though the session lives on."""
    old = shuffles(spark)[1]
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().checkpoint()
    made = shuffles(spark)[1] - old
    spark.range(1000).groupBy("id").count().collect()  # threads hold their last task's
    graph.release(spark)
    for _ in range(100):  # Spark removes them in a thread of its own
        if not made & shuffles(spark)[1]:
            break
        time.sleep(0.1)
    assert made and not made & shuffles(spark)[1]
    assert df.count() == 7

"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, html_text, line_templates, neardup, quality, substrings, token_files, topk
from tidemark.llm.folders import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"), "contaminated")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))[0].select("doc_id", "class_id", "n_links")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "token-files"))
    return token_files.read_tokens(manifest).drop("tokens")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.scored(docs, _table(spark, sf_dir, "labels")).select("doc_id", "score", "keep")


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_line_templates, op3_token_counts, op4_exact_top_k, op5_jaccard_join, op6_html_text, op7_substring_dedup, op8_byte_bpe, op9_token_files, op10_quality)}

# Words of a text with their places, and runs of n of them as strings.
_WORDS = """{0}w AS (
    SELECT r, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM (SELECT row_number() OVER () AS r, {1} AS id, regexp_extract_all({2}, '{3}') AS ws FROM {4}))"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _runs(source: str, n: int | str, columns: str = "r, id, j") -> str:
    """Every run of n consecutive words, with the place of its first."""
    return f"SELECT {columns}, string_agg(w, ' ') OVER o AS g, count(*) OVER o AS n FROM {source} WINDOW o AS (PARTITION BY r ORDER BY j ROWS BETWEEN CURRENT ROW AND {n} - 1 FOLLOWING)"


def _benchmark_runs() -> str:
    """Windows of the items: of 8 words, or of all words of an item that has fewer; document runs of each such length."""
    own = "SELECT DISTINCT id, g, n FROM (SELECT id, g, n, count(*) OVER (PARTITION BY r) AS size FROM bg) WHERE n = least(8, size)"
    lengths = " UNION ALL ".join(f"SELECT r, id, j, g, n FROM ({_runs('dw', n)}) WHERE n = {n}" for n in range(1, 9))
    return f"bg AS ({_runs('bw', 8)}), b AS ({own} AND id IS NOT NULL), d AS ({lengths})"


SQL: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
        WITH {_WORDS.format('d', 'doc_id', _LOWER, _LETTERED, 'documents')}, {_WORDS.format('b', 'item_id', _LOWER, _LETTERED, 'benchmark')},
        {_benchmark_runs()},
        h AS (SELECT d.r, d.j, d.n, b.id AS item FROM d JOIN b ON b.g = d.g AND b.n = d.n),
        c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(j, j + n)) AS k FROM h) GROUP BY r),
        i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item AS VARCHAR) AS item FROM h) GROUP BY r),
        t AS (SELECT row_number() OVER () AS r, doc_id FROM documents), n AS (SELECT r, count(*) AS n_words FROM dw GROUP BY r)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM t LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN i USING (r)
    """,
    "op5_jaccard_join": f"""
        WITH RECURSIVE f AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY 1),
        {_WORDS.format('d', 'id', 'text', _SPACED, 'f')}, g AS ({_runs('dw', 5)}),
        s AS (SELECT DISTINCT id, g FROM (SELECT id, j, g, n, count(*) OVER (PARTITION BY r) AS size FROM g) WHERE n = least(5, size) AND (n = 5 OR j = 1)),
        z AS (SELECT id, count(*) AS size FROM s GROUP BY id),
        l AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id JOIN z x ON x.id = a.id JOIN z y ON y.id = b.id
            GROUP BY a.id, b.id HAVING count(*) >= 0.8 * (any_value(x.size) + any_value(y.size) - count(*))),
        c AS (SELECT id AS a, id AS b FROM f UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
        m AS (SELECT a AS id, min(b) AS class_id FROM c GROUP BY a), k AS (SELECT a AS id, count(*) AS links FROM l GROUP BY a)
        SELECT doc_id, class_id, coalesce(links, 0) + f.n - 1 AS n_links
        FROM documents d JOIN f ON f.text = coalesce(d.text, '') JOIN m USING (id) LEFT JOIN k USING (id)
    """,
    "op7_substring_dedup": f"""
        WITH {_WORDS.format('d', 'doc_id', 'text', _SPACED, 'documents')},
        g AS (SELECT r, id, j, md5(g) AS g FROM ({_runs('dw', 50)}) WHERE n = 50), f AS (SELECT g, min(id) AS id FROM g GROUP BY g),
        c AS (SELECT DISTINCT r, unnest(range(j, j + 50)) AS j FROM g JOIN f ON f.g = g.g AND f.id < g.id),
        k AS (SELECT r, count(*) AS n_words, count(c.j) AS n_removed, string_agg(w, ' ' ORDER BY dw.j) FILTER (c.j IS NULL) AS kept FROM dw LEFT JOIN c USING (r, j) GROUP BY r),
        t AS (SELECT row_number() OVER () AS r, doc_id FROM documents)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (r)
    """,
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
                CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * x.c[i])) AS BIGINT) AS score
            FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.c) = len(x.c) WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
}

"""Queries that apply the operators to their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_main, language, mixing, near_dup, ngram, packing, token_counts, vectors
from .spark_util import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.digests(chat.windows(rows))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return shares.select("doc_id", "size", "source_size", "target", "taken", F.get("places", F.lit(0)).alias("first_place"), F.size("places").cast("long").alias("epochs"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.train_and_score(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_exact_top_k, op3_chat_formatting, op4_token_counts, op5_nearest_neighbours, op6_best_fit_packing, op7_source_mixing, op8_lm_scoring, op9_near_dedup, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    """op2 and op9; the others are tested against brute force, round trips or held-out rows."""
    return {
        "op9_near_dedup": r"""
            WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS x FROM t),
            u AS (SELECT doc_id, unnest(x) AS g FROM s),
            c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * common >= 85 * (len(x.x) + len(y.x) - common)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
            m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
            SELECT doc_id, len(x) AS n_shingles, least AS component_id, doc_id = least AS kept FROM s JOIN m ON m.a = doc_id
        """,
        "op2_exact_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                       FROM embeddings WHERE len(list_filter(embedding, lambda x: NOT coalesce(isfinite(x), false))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
        """
    }

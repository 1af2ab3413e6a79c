"""Registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagweave.llm import (alignment, bm25, compression_quality, decontamination, kmeans_tree, packing, preferences,
                          sentencepieces, simhash, toxicity, url_rules, va_clustering, wordpiece_counts)
from tagweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_wordpiece_counts(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece_counts.counted(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                                    ["doc_id"])


@query
def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op4_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans_tree.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.round_trips(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), **byte_bpe())


@query
def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.search(table(spark, folder, "documents"), F.col("doc_id") % 50 == 0, k=10)


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judged(table(spark, folder, "pages"), rules, ["page_id"])


SQL["op8_url_rules"] = f"""
    WITH rules(r_host, r_path, r_verdict) AS (VALUES {', '.join(map(str, URL_RULES))}),
    parts AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    fits AS (SELECT p.host, p.path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
                    arg_max(r_verdict, length(r_host || r_path)) AS verdict
             FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
             ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path) GROUP BY ALL)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts LEFT JOIN fits USING (host, path)"""


@query
def op9_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    chosen, rejected = preferences.other_endings(table(spark, folder, "conversations"))
    return preferences.segments(chosen, rejected)


SQL["op9_preference_pairs"] = """
    WITH turns AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    ends AS (SELECT pair_id, max((turn, text)) AS last FROM turns WHERE role = 'assistant' GROUP BY pair_id),
    pairs AS (SELECT a.pair_id, a.last[1] AS last_turn, b.last[2] AS other
              FROM (SELECT *, lead(pair_id, 1, first) OVER (ORDER BY pair_id) AS next FROM
                    (SELECT *, min(pair_id) OVER () AS first FROM ends)) a JOIN ends b ON b.pair_id = a.next),
    sides AS (SELECT *, row_number() OVER (PARTITION BY side, pair_id, turn ORDER BY role, text) AS place FROM (
              SELECT DISTINCT side, pair_id, turn, role,
                     CASE WHEN side = 1 AND turn = last_turn AND role = 'assistant' THEN other ELSE text END AS text
              FROM turns JOIN pairs USING (pair_id) CROSS JOIN (SELECT unnest([0, 1]) AS side))),
    shared AS (SELECT *, coalesce(bool_and(same) OVER (PARTITION BY pair_id ORDER BY turn, place), false) AS prompt
               FROM (SELECT pair_id, turn, place, count(*) = 2 AND count(DISTINCT (role, text)) = 1 AS same
                     FROM sides GROUP BY ALL)),
    rows_ AS (SELECT pair_id, CASE WHEN prompt THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part,
                     turn, place, role, '<|' || role || '|>' || chr(10) AS head,
                     '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
              FROM sides JOIN shared USING (pair_id, turn, place) WHERE side = 0 OR NOT prompt),
    placed AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, place
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM rows_)
    SELECT pair_id, part, turn, CAST(place AS INT) AS place, role, rendered, start,
           CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(head) END AS loss_start,
           CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(rendered) END AS loss_end
    FROM placed"""


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return compression_quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.judged(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: Words, then the 10 words from each word on, of items (all words of shorter items) and of documents.
SQL["op11_decontamination"] = """
    WITH words AS (SELECT *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
                   FROM (SELECT 0 AS side, doc_id AS id, text FROM documents
                         UNION ALL SELECT 1, item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
    docs AS (SELECT row_number() OVER () AS doc, id, w FROM words WHERE side = 0),
    windows AS (SELECT DISTINCT id AS item_id, n, array_to_string(w[p:p + n - 1], ' ') AS passage
                FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p
                      FROM (SELECT id, w, least(len(w), 10) AS n FROM words WHERE side = 1 AND len(w) > 0))),
    places AS (SELECT doc, n, p, array_to_string(w[p:p + n - 1], ' ') AS passage
               FROM (SELECT doc, w, n, unnest(range(1, len(w) - n + 2)) AS p
                     FROM docs, (SELECT DISTINCT n FROM windows))),
    hits AS (SELECT doc, n, p, item_id FROM places JOIN windows USING (n, passage)),
    counts AS (SELECT doc, count(DISTINCT word) AS n_hit
               FROM (SELECT DISTINCT doc, unnest(range(p, p + n)) AS word FROM hits) GROUP BY doc),
    found AS (SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
              FROM (SELECT DISTINCT doc, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc)
    SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN counts USING (doc) LEFT JOIN found USING (doc)"""


@query
def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return va_clustering.judged(table(spark, folder, "embeddings"))


def _assigned(n: int) -> str:
    """Vectors with the nearest of the centroids c<n>."""
    return f"""a{n} AS MATERIALIZED (SELECT id, vec_id, v, arg_min(k, d * 8 + k) AS k, CAST(min(d) AS BIGINT) AS d FROM (
        SELECT id, vec_id, kept.v AS v, k, list_sum(list_transform(range(1, 65), lambda i:
               (kept.v[i] - c{n}.v[i]) * (kept.v[i] - c{n}.v[i]))) AS d FROM kept, c{n})
        GROUP BY id, vec_id, v)"""


def _means(n: int) -> str:
    """The centroids c<n> from those before and their vectors; those without vectors stay."""
    return f"""c{n} AS MATERIALIZED (SELECT k, coalesce(m, v) AS v FROM c{n - 1} LEFT JOIN (
        SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
            SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{n - 1}, range(1, 65) AS places(i) GROUP BY k, i)
        GROUP BY k) USING (k))"""


SQL["op12_centroid_clusters"] = f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x:
            CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v FROM kept
        QUALIFY k < 8), {_assigned(0)}, {', '.join(f'{_means(n)}, {_assigned(n)}' for n in range(1, 11))}
    SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
    FROM a10 JOIN c10 USING (k)"""


@query
def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.counted(table(spark, folder, "documents"), model=public_tokenizers.path("piece_bpe_32k.model"),
                             **byte_bpe())


def byte_bpe() -> dict[str, str]:
    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}

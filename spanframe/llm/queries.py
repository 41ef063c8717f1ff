"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.byte_bpe import round_trip
from spanframe.llm.common import Scratch, table
from spanframe.llm.exact_dedup import exact_groups
from spanframe.llm.embedding_dedup import near_duplicates
from spanframe.llm.id_files import read_ids, write_ids
from spanframe.llm.language_id import language_report
from spanframe.llm.mixing import mix
from spanframe.llm.ngram_join import jaccard_groups
from spanframe.llm.secret_scan import ACCESS, ASSIGN, HEX, SCOPE, URL, WEAK_KEY, secret_report
from spanframe.llm.token_counts import count_tokens
from spanframe.llm.toxicity import toxicity_report

#: Characters that lower a document's quality weight in the mix.
NOISE = "0123456789#$%&*+/<=>@^_{|}~"


def quality_weight() -> Column:
    """The square of the share of characters that are not digits or symbols; 1 for an empty text."""
    size = F.length(F.coalesce(F.col("text"), F.lit("")))
    clean = F.length(F.translate(F.coalesce(F.col("text"), F.lit("")), NOISE, ""))
    share = F.when(size == 0, F.lit(1.0)).otherwise(clean / size)
    return share * share


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), quality_weight()).drop("copies")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "ids").path("documents")
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=0)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_exact_dedup, op3_ngram_join, op4_byte_bpe, op5_embedding_dedup,
        op6_source_mix, op7_language_id, op8_id_files, op9_secret_scan, op10_toxicity,
    )
}

#: The patterns of op9 for DuckDB, whose engine has no lookbehind and needs none, as it reads a text once.
_ASSIGN = ASSIGN.replace("'", "''")
_PATTERNS = (_ASSIGN, ACCESS, HEX, WEAK_KEY, f"{URL}|[A-Za-z0-9.-]+:[0-9]+[A-Za-z0-9.:-]*")
_MATCHES = " UNION ALL ".join(f"SELECT r, {k} AS rank, regexp_extract_all(t, '{x}', 0) AS found, regexp_split_to_array(t, '{x}') AS gaps FROM d" for k, x in enumerate(_PATTERNS))

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
        ), k AS (
          SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                 first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
    "op3_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
          SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS grams FROM w
        ), e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
        ), p AS (
          SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
          GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
        ), l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p
        ), r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.v FROM r JOIN l ON r.seen = l.u
        ), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
        SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, component_id FROM s JOIN c ON s.doc_id = c.node""",
    "op5_embedding_dedup": r"""
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
        ), g AS (
          SELECT * FROM e WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
            AND len(list_filter(x, lambda y: y <> 0)) > 0
        ), l AS (
          SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
          WHERE list_cosine_similarity(a.x, b.x) >= 0.93
        ), r AS (SELECT vec_id AS node, vec_id AS seen FROM e UNION SELECT r.node, l.v FROM r JOIN l ON r.seen = l.u
        ), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node
        ), n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
        SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM e JOIN c ON e.vec_id = c.node LEFT JOIN n ON e.vec_id = n.u""",
    "op6_source_mix": rf"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 CASE WHEN length(coalesce(text, '')) = 0 THEN 1.0
                      ELSE length(translate(text, '{NOISE}', '')) / length(text)::DOUBLE END AS share,
                 (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE AS u FROM documents
        ), k AS (
          SELECT doc_id, source, size, -ln(u) / least(greatest(share * share, 0.0625::DOUBLE), 16.0::DOUBLE) AS key FROM d
        ), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
        ), w AS (
          SELECT *, 2.0::DOUBLE * source_size AS cap,
                 [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s
        ), r AS (
          SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
                 sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w
        ), l AS (SELECT arg_max(rem, rest) / max(rest) AS level FROM r WHERE NOT cap * rest <= rem * w
        ), t AS (
          SELECT source, source_size, CASE WHEN cap * rest <= rem * w THEN cap ELSE (SELECT level FROM l) * w END AS target FROM r
        ), b AS (
          SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12)::BIGINT ELSE 0 END AS epochs FROM t
        ), o AS (
          SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, target - epochs * source_size AS budget,
                 coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
          FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
        )
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               (epochs * size + greatest(least(round(budget)::BIGINT - ahead, size), 0))::BIGINT AS taken FROM o""",
    "op9_secret_scan": rf"""
        WITH kinds(rank, kind) AS (VALUES (0, 'assign'), (1, 'access'), (2, 'hex'), (3, 'weak_key'), (4, 'weak_endpoint')
        ), d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
        ), m AS (
          {_MATCHES}
        ), i AS (SELECT r, rank, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM m
        ), e AS (
          SELECT r, rank, found[i] AS s, sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY r, rank ORDER BY i)::BIGINT AS ending FROM i
        ), p AS (
          SELECT r, rank, ending - length(s) AS start, ending FROM e WHERE CASE rank
            WHEN 0 THEN length(regexp_extract(s, '{_ASSIGN}', 1)) >= 6 WHEN 1 THEN length(s) >= 20 WHEN 2 THEN true
            WHEN 3 THEN length(s) <= 64 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]')
            ELSE (regexp_matches(s, '^https?://') OR regexp_matches(s, '^[A-Za-z0-9.-]+:[0-9]{{2,5}}$')) AND regexp_matches(s, '[A-Za-z0-9-]\.[A-Za-z0-9-]') AND NOT contains(s, '..') END
        ), l AS (
          SELECT * FROM p WHERE rank <= 2
             OR (rank = 3 AND EXISTS (SELECT 1 FROM p q WHERE q.r = p.r AND q.rank IN (1, 4) AND greatest(p.start - q.ending, q.start - p.ending) <= {SCOPE})
                 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.r = p.r AND q.rank <= 2 AND q.start < p.ending AND p.start < q.ending))
             OR (rank = 4 AND EXISTS (SELECT 1 FROM p q WHERE q.r = p.r AND q.rank <= 1 AND greatest(p.start - q.ending, q.start - p.ending) <= {SCOPE}))
        ), g AS (
          SELECT l.r, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
                 string_agg(kind || ':' || start || ':' || ending, ',' ORDER BY start, rank) AS spans,
                 string_agg(kind || ':' || start || ':' || ending, ',' ORDER BY start, rank) FILTER (rank <= 2) AS base
          FROM l JOIN kinds USING (rank) GROUP BY l.r
        )
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)""",
}

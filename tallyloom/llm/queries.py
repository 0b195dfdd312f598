"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, exact_dedup, extraction, lexical, line_dedup, minhash, mixing, negatives, pii, quality, substring_dedup, toxicity, webp
from tallyloom.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: The definition itself, on strings: a block is compared by its lines, not by ranks.
OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents
), w AS (
  SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^ 	-
]+')) AS words FROM l
), s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM w WHERE words > 0
), x AS (
  SELECT doc_id, seq, pos, words,
         line AS l1, line || chr(10) || lead(line, 1) OVER o AS l2,
         line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS l3,
         line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o || chr(10) || lead(line, 3) OVER o AS l4,
         words + lead(words, 1) OVER o AS w2, words + lead(words, 1) OVER o + lead(words, 2) OVER o AS w3,
         words + lag(words, 1) OVER o AS b2, words + lag(words, 1) OVER o + lag(words, 2) OVER o AS b3,
         lead(words, 3) OVER o IS NOT NULL AS has4, lag(words, 3) OVER o IS NOT NULL AS back4
  FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY seq)
), m AS (
  SELECT *, CASE WHEN words >= 4 THEN 1 WHEN w2 >= 4 THEN 2 WHEN w3 >= 4 THEN 3 WHEN has4 THEN 4 END AS ahead,
            CASE WHEN words >= 4 THEN 1 WHEN b2 >= 4 THEN 2 WHEN b3 >= 4 THEN 3 WHEN back4 THEN 4 END AS back
  FROM x
), b AS (
  SELECT doc_id, seq AS start, ahead AS m FROM m WHERE ahead IS NOT NULL
  UNION
  SELECT doc_id, seq - back + 1, back FROM m WHERE back IS NOT NULL
), c AS (
  SELECT b.doc_id, b.start, b.m, CASE b.m WHEN 1 THEN l1 WHEN 2 THEN l2 WHEN 3 THEN l3 ELSE l4 END AS block
  FROM b JOIN x ON b.doc_id = x.doc_id AND b.start = x.seq
), r AS (
  SELECT *, row_number() OVER (PARTITION BY m, block ORDER BY doc_id, start) AS nth FROM c
), gone AS (
  SELECT DISTINCT doc_id, start + i AS seq FROM r, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE nth > 1 AND i < m
), kept AS (
  SELECT w.doc_id, string_agg(w.line, chr(10) ORDER BY w.pos) FILTER (WHERE g.seq IS NULL) AS text, count(*) AS n_lines, count(g.seq) AS n_deleted
  FROM w LEFT JOIN s ON w.doc_id = s.doc_id AND w.pos = s.pos LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.seq = g.seq
  GROUP BY w.doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_deleted AS BIGINT) AS n_deleted, sha256(coalesce(text, '')) AS text_sha256 FROM kept
"""


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.scored(docs, quality.train(docs, labels))
    return scored.select("doc_id", *quality.SCORES, (F.col("score") >= quality.KEEP).alias("kept"))


def op6_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(webp.store(table(spark, sf_dir, "documents")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


#: The definition itself: shingles as strings, all links on full sets, reachability.
OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingles FROM d
), g AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT a AS doc_id, b AS other FROM l
  UNION
  SELECT reach.doc_id, l.b FROM reach JOIN l ON reach.other = l.a
), c AS (
  SELECT doc_id, min(other) AS least_other FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(least_other, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(least_other, s.doc_id)) AS kept
FROM s LEFT JOIN c USING (doc_id)
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), c AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), n AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY doc_id
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, s GROUP BY term, docs
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN c USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fitted(pages))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


#: Every anchor against all rows on lists of integers.
OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_line_dedup": op3_line_dedup,
        "op4_source_mixing": op4_source_mixing,
        "op5_quality_cotraining": op5_quality_cotraining,
        "op6_toxicity_mil": op6_toxicity_mil,
        "op7_personal_data": op7_personal_data,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_lossless_webp": op9_lossless_webp,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_lexical_search": op11_lexical_search,
        "op12_html_extraction": op12_html_extraction,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_line_dedup": OP3_SQL, "op10_minhash_near_dedup": OP10_SQL, "op11_lexical_search": OP11_SQL, "op13_hard_negatives": OP13_SQL}

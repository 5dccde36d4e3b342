"""Registered queries of the pipeline operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, collocations, decontamination, hard_negatives, lm, ngram_join, packing, pii, quality, secrets, token_files, topk, toxicity
from tidewatch.llm.common import prepare, table
from tidewatch.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(WORD_VOCABULARY)
    return packing.pack_documents(table(spark, folder, "documents"), str(path), end_id=0)


@query("op4_token_files")
def write_and_read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = str(public_tokenizers.path(BYTE_VOCABULARY))
    target = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), target, path, end_id=2)
    return token_files.digest(token_files.read_token_files(spark, target))


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_secrets")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


TOP_K_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM rows) q JOIN rows c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op9_exact_top_k", TOP_K_SQL)
def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


@query("op10_lm_scores")
def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


NGRAM_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
           WHEN len(w) = 0 THEN []
           WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT documents.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.b) AS component_id
FROM documents JOIN reach ON reach.a = documents.doc_id LEFT JOIN sizes ON sizes.doc_id = documents.doc_id
GROUP BY documents.doc_id
"""


@query("op5_ngram_jaccard", NGRAM_SQL)
def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


@query("op1_decontamination")
def contaminated(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_key")


@query("op11_bpe_lexicon")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = str(public_tokenizers.path(BYTE_VOCABULARY))
    return bpe.digest(bpe.decode(bpe.encode(table(spark, folder, "documents"), path), path))


COLLOCATIONS_SQL = r"""
WITH words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), grams AS (
  SELECT lang, k, g, count(*) AS f
  FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
    FROM words, (VALUES (1), (2), (3)) AS sizes (k))
  GROUP BY lang, k, g
), totals AS (
  SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT p.lang, p.k, p.g, p.f AS a, x.f AS l, y.f AS r, x.k AS cut,
         (1000000 * p.f::HUGEINT * p.f::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM grams p, (VALUES (1), (2)) AS split (c)
  JOIN grams x ON x.lang = p.lang AND x.g = p.g[1:c]
  JOIN grams y ON y.lang = p.lang AND y.g = p.g[c + 1:]
  WHERE p.k > 1 AND p.f >= 10 AND c < p.k
), phrases AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), around AS (
  SELECT lang, part AS g, max(a) AS a
  FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS part FROM phrases WHERE k = 3)
  GROUP BY lang, part
), ranked AS (
  SELECT p.*, array_to_string(p.g, ' ') AS phrase
  FROM phrases p LEFT JOIN around o ON o.lang = p.lang AND o.g = p.g
  WHERE o.a IS NULL OR 100 * o.a < 50 * p.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang)
QUALIFY rank <= 2000
"""


@query("op12_collocations", COLLOCATIONS_SQL)
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


NEGATIVES_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.v AS anchor, c.vec_id, c.label = a.label AS alike,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM rows a JOIN rows c ON (c.vec_id, c.label, c.v) <> (a.vec_id, a.label, a.v)
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, anchor, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.anchor, positive_id, positive_score
                               ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.anchor = p.anchor AND NOT n.alike
  AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = hard_negatives.participants(table(spark, folder, "embeddings"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)

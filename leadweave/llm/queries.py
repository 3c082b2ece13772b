"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadweave.llm import decontam, langid, license_scan, line_dedup, minhash, negatives, packing, quality, residual, spelling, substring, topk, toxicity
from leadweave.llm.tables import documents, held_out

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    graded = quality.grade_texts(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return graded.withColumn("held_out", held_out(F.col("doc_id")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "worst")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_matches(documents(spark, sf_dir), _read(spark, sf_dir, "benchmark"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.pack_whole(documents(spark, sf_dir), TOKENIZER)


def with_slips(found: DataFrame) -> DataFrame:
    """(word) of (id, run): where 97 divides the crc32 of ``id:run``, the run lacks one code point, the place of which the crc32 tells."""
    h, run = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")), F.col("run")
    at = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return found.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, slip).otherwise(run).alias("word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(with_slips(spelling.runs(documents(spark, sf_dir)))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_packing, op3_minhash, op4_topk, op5_line_dedup, op6_language, op7_substring, op8_quality, op9_toxicity, op10_decontamination,
    op11_best_fit, op12_spelling, op13_hard_negatives)}

#: the text of each line without its blank ends; chr(10) and chr(9) keep the SQL readable
ORACLE: dict[str, str] = {
    "op5_line_dedup": f"""
WITH lines AS (
  SELECT d.doc_id, d.source, u.i, u.l, trim(u.l, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS t
  FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS l, generate_subscripts(string_split(d.text, chr(10)), 1) AS i) u),
wide AS (SELECT t, min(doc_id) AS first FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES})
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE w.first <> l.doc_id) AS n_removed,
  coalesce(string_agg(l.l, chr(10) ORDER BY l.i) FILTER (WHERE w.first IS NULL OR w.first = l.doc_id), '') AS kept_text
FROM lines l LEFT JOIN wide w ON l.t = w.t GROUP BY l.doc_id""",
    "op4_topk": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {topk.K}""",
    "op13_hard_negatives": f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE alike),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
      CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND {negatives.PERCENT} * p.score <= 100 * s.score AND s.score <= p.score
      WHERE p.k <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives.NEGATIVES}""",
}

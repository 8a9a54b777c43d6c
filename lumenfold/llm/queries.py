"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shard import histogram_shards

    out = histogram_shards(_table(spark, sf_dir, "documents"), shards=8, carry=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, toxicity_scores

    out = toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_tree import main_text

    return main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import graph_neighbours

    return graph_neighbours(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .curriculum import curriculum_mix

    out = curriculum_mix(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "position", "repeat_position", "source")


def op6_count_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unigram import unigram_token_counts

    return unigram_token_counts(_table(spark, sf_dir, "documents"))


def op7_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import minhash_components

    out = minhash_components(_table(spark, sf_dir, "documents"), words=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_matches

    return license_matches(_table(spark, sf_dir, "documents"))


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .metric_join import cosine_components

    out = cosine_components(_table(spark, sf_dir, "embeddings"), threshold=0.95)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


_WORDS = "[^\\x20\\x09-\\x0D]+"

ORACLE_OP5 = f"""
WITH keyed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k, md5(coalesce(text, '')) AS tie
  FROM documents),
placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source))::BIGINT AS source_size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM keyed),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
  FROM (SELECT DISTINCT source, source_size FROM placed)),
weighted AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CASE r % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS slope
  FROM ranked),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighted
  WINDOW w AS (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT max(level) FILTER (level * weight <= most) AS level FROM leveled),
targets AS (
  SELECT source, slope, least(most, coalesce(f.level * weight, most)) AS target FROM leveled, final f),
joined AS (
  SELECT p.*, t.slope, t.target, floor(t.target)::BIGINT AS words,
         CASE WHEN source_size > 0 THEN floor(t.target)::BIGINT // source_size ELSE 0 END AS rounds
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, size * rounds + greatest(0, least(size, words - rounds * source_size - pos)) AS taken FROM joined)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN 2.0::DOUBLE * least(1.0::DOUBLE, pos / target)
         / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4.0::DOUBLE * slope * least(1.0::DOUBLE, pos / target))) END AS position,
       CASE WHEN taken > size THEN 2.0::DOUBLE * least(1.0::DOUBLE, (pos + source_size) / target)
         / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4.0::DOUBLE * slope * least(1.0::DOUBLE, (pos + source_size) / target))) END AS repeat_position,
       source
FROM took
"""

_SHINGLES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets)
"""

ORACLE_OP7 = f"""{_SHINGLES},
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n_shingles, y.n_shingles) >= 80 * greatest(x.n_shingles, y.n_shingles)
  GROUP BY 1, 2, x.n_shingles, y.n_shingles
  HAVING 100 * count(*) >= 80 * (x.n_shingles + y.n_shingles - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sizes
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_ AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT s.doc_id, s.n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sizes s JOIN least_ l USING (doc_id)
"""

ORACLE_OP10 = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_ AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least_ l ON l.u = e.vec_id LEFT JOIN degree d ON d.u = e.vec_id
"""

QUERIES = {f.__name__: f for f in (op1_histogram_sort, op2_weak_supervision, op3_site_style_tree, op4_pruned_graph, op5_curriculum_mix, op6_count_viterbi, op7_minhash_components, op8_license_windows, op9_residual_packing, op10_metric_join)}
ORACLES = {"op5_curriculum_mix": ORACLE_OP5, "op7_minhash_components": ORACLE_OP7, "op10_metric_join": ORACLE_OP10}

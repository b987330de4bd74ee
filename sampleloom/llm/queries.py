"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.llm import knn, langid, mixing, packing, quality, simhash, substrings, tokencounts, toxicity, urlfilter
from sampleloom.llm.storage import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn.knn_join(_table(spark, sf_dir, "embeddings"))
    return near.select("vec_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over the whole corpus, each delivered twice.

    All documents are inserted; those whose label says low quality are deleted;
    those whose white space at line ends and between lines isn't in normal form are revised.
    """
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels")
    normal = F.regexp_replace(F.regexp_replace("text", "[ \\t]+(?=\\n|$)", ""), "\\n{3,}", "\n\n")
    revised = F.when(F.col("text") != normal, normal)
    counts = materialize(tokencounts.count_tokens(docs, tokencounts.Tokenizer(), revised), "token-counts")  # the texts are read once
    bad = labels.where("quality = 0").select("doc_id").distinct()
    deleted = counts.join(bad, "doc_id", "left_semi")
    was = counts.where("revised IS NOT NULL").join(bad, "doc_id", "left_anti")
    revised = was.withColumn("tokens", F.col("revised"))
    rollup = tokencounts.TokenRollup(spark)
    batches = {"insert": (None, counts), "delete": (deleted, None), "revise": (was, revised)}
    for _ in range(2):
        for name, (before, after) in batches.items():
            rollup.commit(name, tokencounts.delta(before, after))
    return rollup.totals()


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.decide(pages, urlfilter.service_redirects(pages))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), length=tokencounts.Tokenizer())


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_voronoi_knn": op2_voronoi_knn,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_token_rollup": op7_token_rollup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_source_mixing": op9_source_mixing,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op2_voronoi_knn": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(distance, 6) AS distance FROM r WHERE rank <= 10
""",
    "op4_substring_dedup": substrings.passages_sql(),
    "op5_quality_rules": quality.report_sql(),
    "op10_url_filter": urlfilter.decide_sql(),
}

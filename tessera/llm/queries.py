"""Thin queries over the given tables, one for each training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    bpe,
    clustering,
    itemsearch,
    langid,
    licenses,
    linededup,
    lmscore,
    mixing,
    neardup,
    quality,
    search,
    sharding,
    urlfilter,
)
from tessera.llm.common import Scratch, documents


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(documents(spark, sf_dir), shards=8)


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_quality(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("places")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lmscore.cross_entropy_difference(documents(spark, sf_dir), labels.where("quality = 1 and toxic = 0").select("doc_id"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3
    model = langid.train(docs.where(F.coalesce(fold, F.lit(0)) != 1), order=F.xxhash64("doc_id"))
    held_out = docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False)))
    return langid.detect(held_out, model, keep=("held_out", )).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are read once: words and form go to a narrow table.
    docs, n = documents(spark, sf_dir), mixing.count_words(F.col("text"))
    narrow = docs.select("doc_id", "source", "lang", "text", n.alias("n"))
    narrow = narrow.select("doc_id", "source", "lang", "n", mixing.text_form(F.coalesce("text", F.lit("")), F.col("n")).alias("form"))
    return mixing.mix(Scratch(spark).save(narrow, "narrow"), tokens="n", topic="form").select("doc_id", *mixing.RESULTS)


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    return search.search(documents(spark, sf_dir), queries)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "source", "text", "line_total", "line_dropped")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_item_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsearch.rank_for_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The label of a number is the outcome of the page of that number.
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("low"), (F.col("toxic") == 1).alias("toxic")
    )
    outcomes = labels.select("page_id", (F.col("low") | F.col("toxic")).alias("bad"))
    return urlfilter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_kd_sharding,
            op2_host_quality,
            op3_license_scan,
            op4_near_duplicates,
            op5_lm_score,
            op6_language_id,
            op7_mixing,
            op8_topk_search,
            op9_line_dedup,
            op10_bpe,
            op11_item_search,
            op12_kmeans,
            op13_url_filter,
        )
    }

"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last return the columns
of documents; ``run`` writes each result as Parquet in the shared scratch folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, linededup, mixing, neardup
from tessera.llm.common import Scratch, documents

#: Share of letters that the main language must have.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter, or without a main language, go. ``lang`` stays as given."""
    model = langid.train(docs, order=F.xxhash64("doc_id"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = langid.detect(rows, model, keep=("row",))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines of their source; n_chars follows the text where it changed."""
    # A page of boilerplate only is a copy: near-dedup settles it.
    cleaned = linededup.dedup_lines(docs, keep_boilerplate_pages=True)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn(
            "n_chars", F.when(F.col("line_dropped") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
        )
    return cleaned.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities, raked to source, language and topic targets."""
    return mixing.mix(docs).where("mix_kept").select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and hashes of ids and decoded text."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", bpe_tokens)]

#: Viterbi, MinHash components and BPE have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

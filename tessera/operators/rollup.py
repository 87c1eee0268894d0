"""Summaries of a run log kept up as runs arrive, from partial aggregates a combo and case.

The log only grows; its summaries (A1 to A3) are sums, first and best rows. A cell holds these for one combo and case, and cells
of two parts of the log merge into one. So a new part is read once, its cells are merged into the stored ones (only
folders of its combos are written), and a summary reads cells, of which there are as many as a plan has runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.review import row_order
from tessera.sources.io import upsert_partitions

#: Folders of stored cells.
FOLDERS = 16
ATTRIBUTES = ("combo_title", "combo_kind", "base_combo_id", "active_combo_id", "system_prompt_id", "user_prompt_id", "fewshot_id", "question")
COUNTS = ("runs", "passed", "failed", "parse_errors", "validation_fails", "scores", "durations")
SUMS = ("score_sum", "duration_sum")
TEXTS = ("request_types", "experiment_kinds")


def cells(rows: DataFrame) -> DataFrame:
    """A row a combo and case: counts, decimal sums, distinct texts, the first row in order and the best one."""
    order, decimal = row_order(), lambda c: F.col(c).cast("decimal(18,6)")
    score = F.when(F.coalesce("score", F.lit(0.0)) == 0, -1.0).otherwise(F.col("score"))
    best = F.min(F.struct((-score).alias("s"), order.alias("o"), "combo_id", "score"))
    none = F.lit(0).cast("decimal(28,6)")
    flags = {"passed": F.col("passed"), "failed": ~F.col("passed"), "parse_errors": F.col("parse_error"), "validation_fails": ~F.col("validation_ok")}
    folder = F.pmod(F.crc32(F.coalesce("combo_id", F.lit("")).cast("binary")), F.lit(FOLDERS)).cast("string")
    return rows.groupBy("combo_id", "case_id", folder.alias("folder")).agg(
        F.count("*").alias("runs"),
        *[F.count_if(flag).alias(name) for name, flag in flags.items()],
        F.count("score").alias("scores"),
        F.count("duration_seconds").alias("durations"),
        F.coalesce(F.sum(decimal("score")), none).cast("decimal(28,6)").alias("score_sum"),
        F.coalesce(F.sum(decimal("duration_seconds")), none).cast("decimal(28,6)").alias("duration_sum"),
        F.sort_array(F.collect_set(F.when(F.col("request_type") != "", F.col("request_type")))).alias("request_types"),
        F.sort_array(F.collect_set(F.when(F.col("experiment_kind") != "", F.col("experiment_kind")))).alias("experiment_kinds"),
        F.min(order).alias("first_order"),
        F.min_by(F.struct(*ATTRIBUTES), order).alias("first"),
        best.alias("best"),
    )


def _merged() -> dict[str, Column]:
    """How columns of cells merge, by their names."""
    return (
        {c: F.sum(c) for c in COUNTS}
        | {c: F.sum(c).cast("decimal(28,6)") for c in SUMS}
        | {c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))) for c in TEXTS}
        | {"first_order": F.min("first_order"), "first": F.min_by("first", "first_order"), "best": F.min("best")}
    )


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of two parts of a log."""
    every = stored.select(*new.columns).unionByName(new)
    return every.groupBy("combo_id", "case_id", "folder").agg(*[v.alias(k) for k, v in _merged().items()])


def keep_up(path: str, rows: DataFrame) -> DataFrame:
    """The stored cells after one more part of the log; each part is added once."""
    return upsert_partitions(path, cells(rows), "folder", merge)


def _mean(total: str, count: str) -> Column:
    return F.round((F.col(total) / F.nullif(F.col(count), F.lit(0))).cast("decimal(22,10)"), 4).cast("double")


def metrics(stored: DataFrame) -> DataFrame:
    """A1 from cells."""
    out = stored.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
        F.sum("score_sum").cast("decimal(28,6)").alias("score_sum"),
        F.countDistinct(F.nullif("combo_id", F.lit(""))).alias("combo_count"),
        F.countDistinct(F.nullif("case_id", F.lit(""))).alias("case_count"),
    )
    return out.select(
        F.col("runs").alias("review_row_count"), "combo_count", "case_count", _mean("score_sum", "scores").alias("average_score"),
        F.round(F.col("passed") / F.nullif(F.col("runs"), F.lit(0)), 4).alias("pass_rate"), F.col("parse_errors").alias("parse_error_count"),
    )


def _by(stored: DataFrame, key: str) -> DataFrame:
    return stored.withColumn(key, F.coalesce(key, F.lit("None"))).groupBy(key).agg(*[v.alias(k) for k, v in _merged().items()])


def combo_summary(stored: DataFrame) -> DataFrame:
    """A2 from cells."""
    return _by(stored, "combo_id").select(
        "combo_id", *[F.col(f"first.{c}").alias(c) for c in ATTRIBUTES if c != "question"], F.col("runs").alias("case_count"),
        F.col("passed").alias("passed_case_count"), F.col("failed").alias("failed_case_count"), F.col("parse_errors").alias("parse_error_count"),
        F.col("validation_fails").alias("validation_fail_count"), _mean("score_sum", "scores").alias("average_score"),
        F.round(F.col("passed") / F.col("runs"), 4).alias("pass_rate"), _mean("duration_sum", "durations").alias("average_duration_seconds"), *TEXTS,
    )


def case_summary(stored: DataFrame) -> DataFrame:
    """A3 from cells."""
    return _by(stored, "case_id").select(
        "case_id", F.col("first.question").alias("question"), F.col("runs").alias("combo_count"), F.col("passed").alias("passed_combo_count"),
        F.col("failed").alias("failed_combo_count"), F.col("parse_errors").alias("parse_error_count"), _mean("score_sum", "scores").alias("average_score"),
        F.round(F.col("passed") / F.col("runs"), 4).alias("pass_rate"), *TEXTS, F.col("best.combo_id").alias("best_combo_id"), F.col("best.score").alias("best_score"),
    )

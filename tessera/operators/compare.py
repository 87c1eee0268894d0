"""Comparison of answers: fields, text ratios, diffs, alignments, baseline against challengers."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.operators import matching
from tessera.operators.review import flatten_artifacts, latest

# What makes a difference meaningful.
MIN_SCORE_DELTA = 0.05
MAX_TEXT_SIMILARITY = 0.985


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([matching.ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def _diff(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [
            "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), "baseline", "challenger", lineterm=""))
            for a, b in zip(left, right, strict=True)
        ]
    )


_OPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("tag", T.StringType()),
            *[T.StructField(n, T.IntegerType()) for n in ("left_start", "left_end", "right_start", "right_end")],
        ]
    )
)


@F.pandas_udf(_OPS)
def _opcodes(left: pd.Series, right: pd.Series) -> pd.Series:
    names = ("tag", "left_start", "left_end", "right_start", "right_end")
    return pd.Series(
        [
            [dict(zip(names, op, strict=True)) for op in difflib.SequenceMatcher(None, list(a), list(b), autojunk=False).get_opcodes()]
            for a, b in zip(left, right, strict=True)
        ]
    )


def text_similarity(left: Column, right: Column) -> Column:
    """Matching-blocks ratio of normalized texts; equal ones and empty ones need no matching."""
    a, b = text.review_text(left), text.review_text(right)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(_ratio(a, b))


def unified_diff(left: Column, right: Column) -> Column:
    """Unified diff of normalized texts."""
    a, b = text.review_text(left), text.review_text(right)
    return F.when(a == b, "").otherwise(_diff(a, b))


def alignment(left: Column, right: Column, unit: str = "paragraph") -> Column:
    """Operations that turn the segments of one text into those of the other."""
    cut = {"paragraph": text.paragraphs, "sentence": text.sentences}[unit]
    return _opcodes(cut(left), cut(right))


# The compared fields, and which of them are texts and lists.
FIELDS = [
    "request_type",
    "certainty",
    "short_answer",
    "explanation",
    "examples",
    "experiment.kind",
    "experiment.reason",
    "experiment.questions",
    "source_ids",
]
TEXT_FIELDS = ["short_answer", "explanation", "experiment.reason"]
LIST_FIELDS = ["examples", "experiment.questions", "source_ids"]


def field_value(path: str) -> Column:
    """F16: a field of a normalized artifact: its own column first, then the parsed answer; texts and lists normalized."""
    a = F.col("parsed_answer")
    for part in path.split("."):
        a = a[part]
    if path in TEXT_FIELDS:
        return text.review_text(a)
    if path in LIST_FIELDS:
        none = F.array().cast("array<string>")
        return F.coalesce("source_ids", none) if path == "source_ids" else F.filter(
            F.transform(F.coalesce(a, none), text.review_text), lambda x: x != ""
        )
    own = {"request_type": "request_type", "experiment.kind": "experiment_kind"}
    return F.coalesce(F.nullif(own[path], F.lit("")), a) if path in own else a


def shown(value: Column, path: str) -> Column:
    """F16: a field's value as text."""
    return F.array_join(
        F.filter(F.transform(value, text.review_text), lambda x: x != ""), "\n"
    ) if path in LIST_FIELDS else F.coalesce(value, F.lit(""))


def records(artifacts: DataFrame) -> DataFrame:
    """Review rows of artifacts with ``fields``: the compared fields, a dot as two underscores."""
    fields = F.struct(*[field_value(f).alias(f.replace(".", "__")) for f in FIELDS])
    return flatten_artifacts(artifacts, fields=fields)


def compare_fields(pairs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Names and number of fields that differ between left.fields and right.fields."""
    side = lambda s, f: F.col(f"{s}.fields.{f.replace('.', '__')}")
    names = fields or FIELDS
    changed = F.array_compact(F.array(*[F.when(~side("left", f).eqNullSafe(side("right", f)), f) for f in names]))
    out = pairs.withColumns({"changed_fields": changed, "changed_field_count": F.size(changed)})
    return out.withColumn("equal_field_count", F.lit(len(names)) - F.col("changed_field_count"))


def field_comparisons(pairs: DataFrame, fields: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a pair and field: field_path, both texts, equal, similarity, counts of lists.

    Texts that differ go through the matcher once, as one column of all fields; equal ones don't.
    """
    rows = []
    for f in fields or FIELDS:
        left, right = (F.col(f"{s}.fields.{f.replace('.', '__')}") for s in ("left", "right"))
        count = lambda c, f=f: F.size(c) if f in LIST_FIELDS else F.lit(None).cast("int")
        rows.append(
            F.struct(
                F.lit(f).alias("field_path"),
                shown(left, f).alias("left_text"),
                shown(right, f).alias("right_text"),
                left.eqNullSafe(right).alias("equal"),
                count(left).alias("left_count"),
                count(right).alias("right_count"),
            )
        )
    long = pairs.select(*keep, F.explode(F.array(*rows)).alias("c")).select(*keep, "c.*")
    matched = F.col("field_path").isin(TEXT_FIELDS + LIST_FIELDS)
    similarity = F.when(
        matched, F.round(text_similarity(F.col("left_text"), F.col("right_text")), 4)
    ).otherwise(F.col("equal").cast("double"))
    return long.withColumn("similarity", similarity)


def paired(rows: DataFrame, baseline: str) -> DataFrame:
    """case_id, left (the baseline's latest row of the case) and right (that of each other combo)."""
    now = latest(rows).where(F.col("case_id") != "")
    side = lambda name: F.struct(*[c for c in now.columns if c != "case_id"]).alias(name)
    base = now.where(F.col("combo_id") == baseline).select("case_id", side("left"))
    return now.where(F.col("combo_id").isNull() | (F.col("combo_id") != baseline)).select("case_id", side("right")).join(base, "case_id")


def baseline_vs_challenger(
    rows: DataFrame,
    baseline: str,
    *,
    fields: list[str] | None = None,
    min_delta: float = MIN_SCORE_DELTA,
    max_similarity: float = MAX_TEXT_SIMILARITY,
) -> DataFrame:
    """The latest row of every other combo against the baseline's of the same case. ``rows``: what ``records`` gives."""
    both = paired(rows, baseline)
    both = compare_fields(both, fields)
    both = both.withColumns(
        {
            "score_delta": F.round(F.col("right.score") - F.col("left.score"), 4),
            "pass_delta": F.col("right.passed").cast("int") - F.col("left.passed").cast("int"),
            "full_text_similarity": F.round(text_similarity(F.col("left.comparison_text"), F.col("right.comparison_text")), 4),
        }
    )
    meaningful = (F.col("changed_field_count") > 0) | F.coalesce(F.abs("score_delta") >= min_delta, F.lit(False)) | F.coalesce(
        F.col("pass_delta") != 0, F.lit(False)
    ) | (F.col("left.parse_error") != F.col("right.parse_error")) | (F.col("full_text_similarity") <= max_similarity)
    return both.select(
        "case_id",
        F.col("left.question").alias("question"),
        F.col("left.combo_id").alias("baseline_combo_id"),
        F.col("right.combo_id").alias("challenger_combo_id"),
        F.col("left.score").alias("baseline_score"),
        F.col("right.score").alias("challenger_score"),
        "score_delta",
        "pass_delta",
        F.col("left.parse_error").alias("baseline_parse_error"),
        F.col("right.parse_error").alias("challenger_parse_error"),
        "full_text_similarity",
        "changed_fields",
        "changed_field_count",
        F.col("left.comparison_text").alias("baseline_text"),
        F.col("right.comparison_text").alias("challenger_text"),
        meaningful.alias("meaningful_delta"),
    )


def meaningful_only(comparisons: DataFrame) -> DataFrame:
    """P11."""
    return comparisons.where("meaningful_delta")


def challenger_summary(comparisons: DataFrame) -> DataFrame:
    """One row a challenger."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,6)")), 4).cast("double")
    up, down = F.coalesce("score_delta", F.lit(0.0)) > 0, F.coalesce("score_delta", F.lit(0.0)) < 0
    return comparisons.where(F.col("challenger_combo_id") != "").groupBy("baseline_combo_id", "challenger_combo_id").agg(
        F.count("*").alias("compared_case_count"),
        F.count_if("meaningful_delta").alias("meaningful_case_count"),
        F.round(F.count_if("meaningful_delta") / F.count("*"), 4).alias("meaningful_case_rate"),
        F.count_if(up).alias("improved_score_case_count"),
        F.count_if(down).alias("worsened_score_case_count"),
        F.count_if(~up & ~down).alias("same_score_case_count"),
        F.count_if(F.col("pass_delta") == 1).alias("pass_gain_case_count"),
        F.count_if(F.col("pass_delta") == -1).alias("pass_loss_case_count"),
        mean("score_delta").alias("average_score_delta"),
        mean("full_text_similarity").alias("average_text_similarity"),
        mean("changed_field_count").alias("average_changed_field_count"),
        F.round(F.count_if(F.col("changed_field_count") > 0) / F.count("*"), 4).alias("changed_field_rate"),
    )

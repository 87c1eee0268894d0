"""Review tables: flat answer rows, filters, summaries, rankings. All built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text

# Weights of the combo ranking.
RANK_WEIGHTS = {"average_score": 0.55, "pass_rate": 0.25, "stability_rate": 0.10, "validation_rate": 0.05, "speed_score": 0.05}


def flatten_artifacts(artifacts: DataFrame, **more: Column) -> DataFrame:
    """One flat row an artifact; a missing title falls back from base to active combo to the id. ``more``: further columns."""
    answer, snap, m = F.col("parsed_answer"), F.col("prompt_snapshot"), F.col("metrics")
    none = F.array().cast("array<string>")
    shown = {
        "short_answer": text.review_text(answer["short_answer"]),
        "explanation": text.review_text(answer["explanation"]),
        "examples": F.array_join(F.filter(F.transform(F.coalesce(answer["examples"], none), text.review_text), lambda x: x != ""), "\n"),
        "experiment_reason": text.review_text(answer["experiment"]["reason"]),
        "experiment_questions": F.array_join(
            F.filter(F.transform(F.coalesce(answer["experiment"]["questions"], none), text.review_text), lambda x: x != ""), "\n"
        ),
        "raw_output": text.review_text("raw_output"),
    }
    comparison = text.comparison_text(shown)
    return artifacts.select(
        F.col("id").alias("row_id"),
        "raw_run_id",
        "created_at",
        "experiment_id",
        F.col("execution.signature").alias("execution_signature"),
        "model",
        "combo_id",
        F.coalesce(
            F.nullif(snap["base_combo"]["title"], F.lit("")), F.nullif(snap["active_combo"]["title"], F.lit("")), F.col("combo_id")
        ).alias("combo_title"),
        snap["base_combo"]["kind"].alias("combo_kind"),
        snap["combo_relation"]["base_combo_id"].alias("base_combo_id"),
        "active_combo_id",
        snap["roles"]["system"]["prompt_id"].alias("system_prompt_id"),
        snap["roles"]["user"]["prompt_id"].alias("user_prompt_id"),
        snap["fewshot"]["prompt_id"].alias("fewshot_id"),
        "case_set_id",
        "case_id",
        "question",
        m["score"].alias("score"),
        F.coalesce(m["passed"], F.lit(False)).alias("passed"),
        m["passed_count"].alias("passed_count"),
        m["total_count"].alias("total_count"),
        m["duration_seconds"].alias("duration_seconds"),
        F.coalesce(m["validation_ok"], F.lit(False)).alias("validation_ok"),
        F.coalesce(F.col("review_flags.parse_error"), F.lit(False)).alias("parse_error"),
        "request_type",
        "experiment_kind",
        answer["certainty"].alias("certainty"),
        F.size(F.coalesce("source_ids", none)).alias("source_count"),
        "source_ids",
        F.coalesce(F.col("answer_lengths.example_count"), F.lit(0)).cast("int").alias("example_count"),
        shown["short_answer"].alias("short_answer"),
        F.substring(shown["explanation"], 1, text.PREVIEW_CHARS).alias("explanation_preview"),
        comparison.alias("comparison_text"),
        text.json_string_hash(comparison).alias("comparison_hash"),
        F.coalesce("tags", none).alias("tags"),
        F.col("artifact_paths.normalized").alias("normalized_artifact_path"),
        F.col("artifact_paths.raw").alias("raw_artifact_path"),
        "scope",
        *[c.alias(n) for n, c in more.items()],
    )


def filter_rows(
    rows: DataFrame,
    *,
    is_in: dict[str, list[str]] | None = None,
    passed: bool | None = None,
    parse_error: bool | None = None,
    score_range: tuple[float, float] | None = None,
    query: str = "",
    query_columns: tuple[str, ...] = ("combo_title", "case_id", "question", "short_answer"),
    latest_only: bool = False,
    tags: list[str] | None = None,
) -> DataFrame:
    """All given conditions; empty lists match all, rows without a score pass any range."""
    out = rows
    for column, values in (is_in or {}).items():
        if values:
            out = out.where(F.col(column).isin(values))
    if passed is not None:
        out = out.where(F.col("passed") == passed)
    if parse_error is not None:
        out = out.where(F.col("parse_error") == parse_error)
    if score_range:
        out = out.where(F.col("score").isNull() | F.col("score").between(*score_range))
    if tags:
        out = out.where(text.has_all(F.col("tags"), tags))
    out = out.where(text.contains_text(query, *map(F.col, query_columns)))
    return latest(out) if latest_only else out


def latest(rows: DataFrame, keys: tuple[str, ...] = ("case_id", "combo_id"), ordinal: str = "row_id") -> DataFrame:
    """The latest row of each key, by created_at then input order (``ordinal``, unique in a key).

    Only keys and order are aggregated; the rows are picked by a semi join, which stands below what is computed from them.
    """
    at = F.coalesce("created_at", F.lit(""))
    last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.max(F.struct(at.alias("at"), F.col(ordinal).alias("n"))).alias("m")
    ).select(*[f"_{k}" for k in keys], "m.at", "m.n")
    same = (at == last["at"]) & F.col(ordinal).eqNullSafe(last["n"])
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(last, same, "left_semi")


def _avg(c: str) -> Column:
    """Mean on six decimals, so that the order of the rows can't change the rounded value."""
    return F.round(F.avg(F.col(c).cast("decimal(18,6)")), 4).cast("double")


def _rate(flag: Column) -> Column:
    return F.round(F.count_if(flag) / F.count("*"), 4)


def _texts(c: str) -> Column:
    return F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c))))


def _first(c: str, order: Column) -> Column:
    """The value in the first row, null if it is null there."""
    return F.min_by(F.struct(F.col(c).alias("v")), order)["v"].alias(c)


ROW_ORDER = ("combo_id", "case_id", "created_at")


def row_order(ordinal: str = "row_id") -> Column:
    return F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ROW_ORDER], F.col(ordinal).alias("n"))


def metrics(rows: DataFrame) -> DataFrame:
    """A1: one row of totals."""
    return rows.agg(
        F.count("*").alias("review_row_count"),
        F.countDistinct(F.nullif("combo_id", F.lit(""))).alias("combo_count"),
        F.countDistinct(F.nullif("case_id", F.lit(""))).alias("case_count"),
        _avg("score").alias("average_score"),
        _rate(F.col("passed")).alias("pass_rate"),
        F.count_if("parse_error").alias("parse_error_count"),
    )


def tag_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def combo_summary(rows: DataFrame) -> DataFrame:
    """A2: a row a combo; null ids group as the text None; attributes come from the first row in order."""
    order = row_order()
    return rows.withColumn("combo_id", F.coalesce("combo_id", F.lit("None"))).groupBy("combo_id").agg(
        *[
            _first(c, order)
            for c in ("combo_title", "combo_kind", "base_combo_id", "active_combo_id", "system_prompt_id", "user_prompt_id", "fewshot_id")
        ],
        F.count("*").alias("case_count"),
        F.count_if("passed").alias("passed_case_count"),
        F.count_if(~F.col("passed")).alias("failed_case_count"),
        F.count_if("parse_error").alias("parse_error_count"),
        F.count_if(~F.col("validation_ok")).alias("validation_fail_count"),
        _avg("score").alias("average_score"),
        _rate(F.col("passed")).alias("pass_rate"),
        _avg("duration_seconds").alias("average_duration_seconds"),
        _texts("request_type").alias("request_types"),
        _texts("experiment_kind").alias("experiment_kinds"),
    )


def case_summary(rows: DataFrame) -> DataFrame:
    """A3: a row a case with its best combo; a best score of zero or null counts as -1, the first row wins ties."""
    order = row_order()
    score = F.when(F.coalesce("score", F.lit(0.0)) == 0, -1.0).otherwise(F.col("score"))
    best = F.min_by(F.struct("combo_id", "score"), F.struct((-score).alias("s"), order.alias("o")))
    out = rows.withColumn("case_id", F.coalesce("case_id", F.lit("None"))).groupBy("case_id").agg(
        _first("question", order),
        F.count("*").alias("combo_count"),
        F.count_if("passed").alias("passed_combo_count"),
        F.count_if(~F.col("passed")).alias("failed_combo_count"),
        F.count_if("parse_error").alias("parse_error_count"),
        _avg("score").alias("average_score"),
        _rate(F.col("passed")).alias("pass_rate"),
        best.alias("_best"),
        _texts("request_type").alias("request_types"),
        _texts("experiment_kind").alias("experiment_kinds"),
    )
    return out.withColumns({"best_combo_id": F.col("_best.combo_id"), "best_score": F.col("_best.score")}).drop("_best")


def speed_scores(summary: DataFrame) -> DataFrame:
    """1 for the fastest combo, 0 for the slowest; all equal: 1; without a duration: 0."""
    d, every = F.col("average_duration_seconds"), Window.partitionBy()
    low, high = F.min(d).over(every), F.max(d).over(every)
    score = F.when(low.isNull(), 0.0).when(low == high, 1.0).when(d.isNull(), 0.0).otherwise(F.round(1.0 - (d - low) / (high - low), 4))
    return summary.withColumn("speed_score", score)


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Numbers a summary table, which has a row a combo or case."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def combo_ranking(rows: DataFrame, weights: dict[str, float] | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Combos by weighted score. ``baseline``: summary of challengers against a baseline combo, to show beside."""
    w = RANK_WEIGHTS | (weights or {})
    n = F.greatest(F.col("case_count"), F.lit(1))
    s = speed_scores(combo_summary(rows)).withColumns(
        {"_stable": 1.0 - F.col("parse_error_count") / n, "_valid": 1.0 - F.col("validation_fail_count") / n}
    )
    score = (
        F.coalesce("average_score", F.lit(0.0)) * w["average_score"] + F.coalesce("pass_rate", F.lit(0.0)) * w["pass_rate"]
        + F.col("_stable") * w["stability_rate"] + F.col("_valid") * w["validation_rate"] + F.col("speed_score") * w["speed_score"]
    )
    s = s.withColumns(
        {"stability_rate": F.round("_stable", 4), "validation_rate": F.round("_valid", 4), "ranking_score": F.round(score, 4)}
    ).drop("_stable", "_valid")
    if baseline is not None:
        against = baseline.select(
            F.col("challenger_combo_id").alias("combo_id"),
            F.col("average_score_delta").alias("average_score_delta_vs_baseline"),
            F.col("meaningful_case_rate").alias("meaningful_case_rate_vs_baseline"),
        )
        s = s.join(against, "combo_id", "left")
    return _ranked(s, F.col("ranking_score").desc(), F.coalesce("average_score", F.lit(0.0)).desc(), F.col("combo_id"))


def case_difficulty(rows: DataFrame) -> DataFrame:
    """Cases by failures, disagreement and parse errors."""
    spread = rows.where(F.col("case_id") != "").groupBy("case_id").agg(
        F.round(F.coalesce(F.max("score") - F.min("score"), F.lit(0.0)), 4).alias("score_range"),
        F.countDistinct(F.nullif("request_type", F.lit(""))).alias("request_type_count"),
        F.countDistinct(F.nullif("experiment_kind", F.lit(""))).alias("experiment_kind_count"),
    )
    s = case_summary(rows).join(spread, "case_id", "left").fillna({"score_range": 0.0, "request_type_count": 0, "experiment_kind_count": 0})
    error = F.col("parse_error_count") / F.greatest(F.col("combo_count"), F.lit(1))
    more = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    disagreement = F.least(F.lit(1.0), F.col("score_range") + more("request_type_count") * 0.2 + more("experiment_kind_count") * 0.15)
    hard = (1.0 - F.coalesce("pass_rate", F.lit(0.0))) * 0.6 + disagreement * 0.25 + error * 0.15
    s = s.withColumns({"parse_error_rate": F.round(error, 4), "difficulty_score": F.round(hard, 4)})
    return _ranked(s, F.col("difficulty_score").desc(), F.col("case_id"))


def facets(rows: DataFrame) -> DataFrame:
    """Counts by five dimensions, one pass of grouping sets and one for tags: facet, value, n."""
    dims = ["request_type", "experiment_kind", "combo_id", "case_id"]
    sets = rows.groupingSets([[F.col(d)] for d in dims], *map(F.col, dims)).agg(F.grouping_id(*dims).alias("_g"), F.count("*").alias("n"))
    which = F.when(F.col("_g") == 7, "request_type").when(
        F.col("_g") == 11, "experiment_kind"
    ).when(F.col("_g") == 13, "combo_id").otherwise("case_id")
    out = sets.select(which.alias("facet"), F.coalesce(*dims).alias("value"), "n").where(F.col("value") != "")
    return out.union(tag_counts(rows).select(F.lit("tag"), "tag", "n"))


def ranges(rows: DataFrame, measures: tuple[str, ...] = ("score", "duration_seconds", "source_count", "example_count")) -> DataFrame:
    """Measure, min, max, average."""
    one = rows.agg(
        *[
            F.struct(F.min(m).cast("double").alias("min"), F.max(m).cast("double").alias("max"), _avg(m).alias("average")).alias(m)
            for m in measures
        ]
    )
    return one.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("measure"),
                        F.col(f"{m}.min").alias("min"),
                        F.col(f"{m}.max").alias("max"),
                        F.col(f"{m}.average").alias("average"),
                    )
                    for m in measures
                ]
            )
        ).alias("r")
    ).select("r.*")


def prompt_rows(rows: DataFrame, prompt_id: str, combo_ids: list[str] | None = None) -> DataFrame:
    """Rows that use a prompt in a role, or whose combo is listed."""
    roles = F.array_compact(
        F.array(
            *[
                F.when(F.col(c) == prompt_id, F.lit(r))
                for r, c in (("system", "system_prompt_id"), ("user", "user_prompt_id"), ("fewshot", "fewshot_id"))
            ]
        )
    )
    listed = F.lit(False)
    for c in ("combo_id", "base_combo_id", "active_combo_id"):
        listed = listed | F.coalesce(F.col(c).isin(combo_ids or []), F.lit(False))
    return rows.withColumns({"matched_prompt_roles": roles, "matched_by_combo": listed}).where(
        (F.size("matched_prompt_roles") > 0) | F.col("matched_by_combo")
    )


def _performance(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("run_count"),
        F.count("score").alias("scored_run_count"),
        _avg("score").alias("average_score"),
        F.round(F.max("score"), 4).alias("best_score"),
        _rate(F.col("passed")).alias("pass_rate"),
        F.max(F.nullif("created_at", F.lit(""))).alias("latest_run_at"),
        F.avg("score").alias("_mean"),
        F.max("score").alias("_max"),
    )


def _top(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1")


def prompt_combo_performance(rows: DataFrame) -> DataFrame:
    """A4: how combos did with a prompt, with their best model."""
    named = rows.where(F.col("combo_id") != "")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).desc()
    best = _top(
        _performance(named.where(F.col("model") != ""), "combo_id", "model"), "combo_id", zero("_mean"), zero("_max"), F.col("model")
    ).select("combo_id", F.col("model").alias("best_model"))
    order = F.struct(F.col("created_at"), F.col("row_id"))
    # Rows come latest first, so the first row is the last one.
    more = named.groupBy("combo_id").agg(
        F.max_by(F.struct("combo_title", "combo_kind", "base_combo_id"), order).alias("a"),
        _texts("active_combo_id").alias("active_combo_ids"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("matched_prompt_roles")))).alias("matched_prompt_roles"),
        _texts("experiment_id").alias("experiment_ids"),
        _texts("model").alias("models"),
    ).select("*", "a.*", F.size("models").alias("model_count")).drop("a")
    return _performance(named, "combo_id").drop("_mean", "_max").join(more, "combo_id").join(best, "combo_id", "left")


def prompt_model_performance(rows: DataFrame) -> DataFrame:
    """A5: how models did with a prompt, with their best combo."""
    named = rows.where(F.col("model") != "")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).desc()
    pairs = _performance(named.where(F.col("combo_id") != ""), "model", "combo_id")
    best = _top(
        pairs, "model", zero("average_score"), zero("best_score"), zero("pass_rate"), F.col("run_count").desc(), F.col("combo_id")
    ).select("model", F.col("combo_id").alias("best_combo_id"))
    titles = named.groupBy("model", F.col("combo_id").alias("best_combo_id")).agg(
        F.max_by("combo_title", F.struct("created_at", "row_id")).alias("best_combo_title")
    )
    counts = named.groupBy("model").agg(
        F.countDistinct(F.nullif("combo_id", F.lit(""))).alias("combo_count"),
        F.countDistinct(F.nullif("experiment_id", F.lit(""))).alias("experiment_count"),
    )
    return _performance(named, "model").drop("_mean", "_max").join(counts, "model").join(
        best.join(titles, ["model", "best_combo_id"]), "model", "left"
    )


def prompt_usage_summary(rows: DataFrame) -> DataFrame:
    """Totals of a prompt's rows."""
    return rows.agg(
        F.count("*").alias("run_count"),
        F.count("score").alias("scored_run_count"),
        _texts("model").alias("models"),
        F.max("created_at").alias("latest_run_at"),
        _texts("execution_signature").alias("signatures"),
    )


def top_prompt_entries(performance: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The best n combos or models of a performance table."""
    return performance.orderBy(
        F.coalesce("average_score", F.lit(0.0)).desc(),
        F.coalesce("best_score", F.lit(0.0)).desc(),
        F.coalesce("pass_rate", F.lit(0.0)).desc(),
        F.col("run_count").desc(),
        F.col(key),
    ).limit(n)


def best(rows: DataFrame, score: str, minimum: float, key: str) -> DataFrame:
    """Rows with at least a score, best first."""
    return rows.where(F.col(score) >= minimum).orderBy(F.col(score).desc(), key)


def score_summary(rows: DataFrame, bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Counts and range of the scores; without scores the bounds are 0 and 1."""
    return rows.agg(
        F.count("*").alias("row_count"),
        F.count("score").alias("scored_count"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        _avg("score").alias("average_score"),
        F.coalesce(F.min("score"), F.lit(bounds[0])).alias("low_bound"),
        F.coalesce(F.max("score"), F.lit(bounds[1])).alias("high_bound"),
    )


def upsert_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """The last version of each row's note; preferred ones first, then case, combo, time."""
    every = notes.unionByName(changes)
    last = every.groupBy(F.col("row_id").alias("_id")).agg(F.max_by(F.struct(*every.columns), "updated_at").alias("n")).select("n.*")
    return last.orderBy(F.col("preferred").desc(), "case_id", "combo_id", "updated_at", "row_id")


def scopes(rows: DataFrame, experiments: DataFrame) -> DataFrame:
    """Artifacts a scope, with name, status and tags of the experiment where there is one, the last scope first."""
    e = experiments.select(
        F.col("id").alias("scope"),
        F.col("name").alias("experiment_name"),
        F.col("status").alias("experiment_status"),
        F.col("tags").alias("experiment_tags"),
    )
    out = rows.groupBy("scope").agg(F.count("*").alias("artifact_count")).join(e, "scope", "left")
    out = out.withColumns(
        {
            "label": F.concat(
                "scope", F.when(F.col("experiment_name").isNotNull(), F.concat(F.lit(" | "), "experiment_name")).otherwise("")
            ),
            "experiment_tags": F.coalesce("experiment_tags", F.array().cast("array<string>")),
        }
    )
    return out.orderBy(F.col("scope").desc())


def union_scopes(tables: dict[str, DataFrame]) -> DataFrame:
    """The review rows of all scopes, each with its scope; columns that a scope lacks are null."""
    named = [t.withColumn("scope", F.lit(scope)) for scope, t in tables.items() if scope]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def scope_report(rows: DataFrame) -> DataFrame:
    """One report a scope: file counts, metrics, and its combo and case tables as JSON."""
    combos = rows.groupBy("scope", "combo_id").agg(
        F.count("*").alias("case_count"),
        F.count_if("passed").alias("passed_case_count"),
        _avg("score").alias("average_score"),
        _rate(F.col("passed")).alias("pass_rate"),
    )
    cases = rows.groupBy("scope", "case_id").agg(
        F.count("*").alias("combo_count"),
        F.count_if("passed").alias("passed_combo_count"),
        _avg("score").alias("average_score"),
        _rate(F.col("passed")).alias("pass_rate"),
    )
    packed = lambda t, key, name: t.groupBy("scope").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(key, *[c for c in t.columns if c not in ("scope", key)])))).alias(name)
    )
    total = rows.groupBy("scope").agg(
        F.countDistinct("raw_artifact_path").alias("raw_file_count"),
        F.countDistinct("normalized_artifact_path").alias("normalized_file_count"),
        F.count("*").alias("review_row_count"),
        F.countDistinct("combo_id").alias("combo_count"),
        F.countDistinct("case_id").alias("case_count"),
        _avg("score").alias("average_score"),
        _rate(F.col("passed")).alias("pass_rate"),
        F.count_if("parse_error").alias("parse_error_count"),
    )
    return total.join(packed(combos, "combo_id", "combo_rows"), "scope").join(packed(cases, "case_id", "case_rows"), "scope")


def csv_ready(rows: DataFrame) -> DataFrame:
    """Nulls as empty text, lists and structs as JSON text."""
    plain = lambda c, t: F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string")
    return rows.select(*[F.coalesce(plain(c, t), F.lit("")).alias(c) for c, t in rows.dtypes])

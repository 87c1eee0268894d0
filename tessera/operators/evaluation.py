"""Rule checks of answers, run plans, coverage, result upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.phrases import found_phrases
from tessera.operators.review import latest
from tessera.sources.scratch import save

# What counts as a concentration, answer vocabularies and size limits, and the score of a stable combo.
CONCENTRATION = r"(?iU)(\b\d+(?:[\.,]\d+)?\s*%\b|\b\d+(?:[\.,]\d+)?\s*(?:m|mol\s*/\s*l|mol/l|моль\s*/\s*л)\b)"
EXPERIMENT_KINDS = ["none", "clarification", "experiment"]
CERTAINTIES = ["low", "medium", "high"]
REQUEST_TYPES = ["theory", "experiment", "mixed"]
MAX_EXAMPLES, MAX_SOURCES, MAX_QUESTIONS = 2, 5, 3
# The fields of an answer, and those that each kind of experiment needs.
ANSWER = (
    "struct<request_type:string,short_answer:string,explanation:string,examples:array<string>,certainty:string,source_ids:array<string>,experiment:struct<kind:string,reason:string,questions:array<string>,title:string,goal:string," "ingredients:array<struct<name:string,formula:string,amount:string,is_solution:boolean,concentration:string,purpose:string>>,equipment:array<string>,protective_equipment:array<string>,steps:array<string>,safety_notes:array<string>," "disposal:string,adult_supervision_required:boolean>>"
)
NEEDED_TEXTS = {"none": ["reason"], "clarification": ["reason"], "experiment": ["title", "goal", "disposal"]}
NEEDED_LISTS = {"experiment": ["ingredients", "equipment", "protective_equipment", "steps", "safety_notes"]}
STABLE_SCORE = 0.8
#: Cases of a block of a plan, about.
CASES = 256


def answer_json(answer: Column) -> Column:
    """The answer as lower-cased JSON text, nulls included."""
    return F.lower(F.to_json(answer, {"ignoreNullFields": "false"}))


def score_answers(answers: DataFrame, cases: DataFrame, phrases: DataFrame, **options) -> DataFrame:
    """Each answer against its case: found_phrases, checks (name, passed), passed_count, total_count, score, passed.

    ``phrases``: case_id and phrase, a row for each phrase that the answers of a case must not have (``options`` as in
    ``phrases.found_phrases``). A check exists only if the case declares it. Without an answer all fail but the concentration
    check. Cases are matched by case_id; Spark sends them to all tasks if they are small.
    """
    a, blob = F.col("answer"), answer_json(F.col("answer"))
    declared = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    check = lambda when, name, ok: F.when(when, F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed")))
    checks = F.array_compact(
        F.array(
            check(F.lit(True), "parse_ok", a.isNotNull()),
            check(declared(F.col("expected_request_type")), "request_type", F.array_contains("expected_request_type", a["request_type"])),
            check(
                declared(F.col("expected_experiment_kind")),
                "experiment_kind",
                F.array_contains("expected_experiment_kind", a["experiment"]["kind"]),
            ),
            check(F.col("_forbids").isNotNull(), "forbidden_phrases", a.isNotNull() & (F.size("found_phrases") == 0)),
            check(
                F.coalesce("forbid_concentration_patterns", F.lit(False)),
                "no_invented_concentration",
                a.isNull() | ~blob.rlike(CONCENTRATION),
            ),
        )
    )
    forbids = phrases.where("phrase is not null").groupBy("case_id").agg(F.count("*").alias("_forbids"))
    out = answers.join(cases.join(forbids, "case_id", "left"), "case_id")
    out = out.withColumn("found_phrases", found_phrases(phrases, F.col("case_id"), blob, **options)).withColumn("checks", checks).drop("_forbids")
    out = out.withColumns({"passed_count": F.size(F.filter("checks", lambda c: c["passed"])), "total_count": F.size("checks")})
    return out.withColumns(
        {"score": F.round(F.col("passed_count") / F.col("total_count"), 4), "passed": F.col("passed_count") == F.col("total_count")}
    )


def failed_checks(results: DataFrame) -> DataFrame:
    """Compact rows with the names of the checks that failed."""
    return results.withColumn(
        "failed_checks", F.array_join(F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["name"]), ", ")
    )


def summarize(results: DataFrame) -> DataFrame:
    """Average score, pass rate, cases; zeros without results."""
    return results.agg(
        F.coalesce(F.round(F.avg(F.col("score").cast("decimal(18,6)")), 4).cast("double"), F.lit(0.0)).alias("average_score"),
        F.coalesce(F.round(F.count_if("passed") / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)).alias("pass_rate"),
        F.count("*").alias("case_count"),
    )


def require_unique(table: DataFrame, key: str) -> DataFrame:
    """The table, or an error if a key occurs twice."""
    if not (twice := table.groupBy(key).count().where("count > 1").limit(1)).isEmpty():
        raise ValueError(f"{key} occurs twice: {twice.first()[0]}")
    return table


def plan_runs(combos: DataFrame, cases: DataFrame, existing: DataFrame, mode: str, signature: str) -> DataFrame:
    """Every combo and case, with the latest artifact of the signature and whether to run it.

    Modes: ``all``; ``missing``: without an artifact; ``failed``: with one that failed. The product of both lists is what
    a plan is: its size is the number of runs to come.
    """
    if mode not in ("all", "missing", "failed"):
        raise ValueError(f"unknown mode: {mode}")
    have = latest(existing.where(F.col("execution_signature") == signature)).select(
        "combo_id", "case_id", F.col("row_id").alias("existing_id"), F.col("passed").alias("existing_passed")
    )
    # Cases are dealt to blocks, and a combo meets each block: a join by the block's number.
    ids = save(cases.select("case_id").distinct())
    blocks = max(1, -(-ids.count() // CASES))
    dealt = ids.select("case_id", F.pmod(F.xxhash64("case_id"), F.lit(blocks)).cast("int").alias("_block"))
    each = combos.select("combo_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    targets = each.join(dealt, "_block").drop("_block")
    planned = targets.join(have, ["combo_id", "case_id"], "left")
    run = {
        "all": F.lit(True),
        "missing": F.col("existing_id").isNull(),
        "failed": F.col("existing_id").isNotNull() & ~F.coalesce("existing_passed", F.lit(False)),
    }
    return planned.withColumn("should_run", run[mode])


def coverage(planned: DataFrame) -> DataFrame:
    """Cases done and missing of each combo; complete if none is missing."""
    missing = F.sort_array(F.collect_set(F.when(F.col("existing_id").isNull(), F.col("case_id"))))
    return planned.groupBy("combo_id").agg(
        F.count("existing_id").alias("case_count"), missing.alias("missing_case_ids")
    ).withColumn("complete", F.size("missing_case_ids") == 0)


def report_rows(rows: DataFrame, combos: DataFrame, cases: DataFrame, signature: str | None = None) -> DataFrame:
    """Rows of selected combos and cases, of one signature if given."""
    out = rows.join(combos.select("combo_id"), "combo_id", "left_semi").join(cases.select("case_id"), "case_id", "left_semi")
    return out if signature is None else out.where(F.col("execution_signature") == signature)


def artifact_tags(results: DataFrame, variant: str = "rag", rag: bool = True) -> DataFrame:
    """Tags and file name of each result."""
    tags = F.array_compact(
        F.array(
            F.lit(variant),
            F.lit("rag" if variant == "rag" and rag else "no_rag"),
            F.when(F.coalesce("validation_ok", F.lit(False)), "validation_ok").otherwise("validation_failed"),
            F.when(F.coalesce("passed", F.lit(False)), "case_passed").otherwise("case_failed"),
            F.when(F.coalesce("raw_output", F.lit("")) == "", "empty_output"),
            F.when(F.col("answer").isNull(), "parse_error"),
        )
    )
    name = F.concat_ws("__", F.col("run_id").cast("string"), "combo_id", F.regexp_replace(text.slug("case_id"), "-", "_"))
    return results.withColumns({"tags": tags, "artifact_file": F.concat(name, F.lit(".json"))})


def normalized_artifacts(results: DataFrame, scope: str, variant: str = "rag", rag: bool = True) -> DataFrame:
    """Run, answer and case result as one normalized artifact.

    ``results``: run_id, combo_id, case_id, question, created_at, model, answer, raw_output, validation_ok, duration_seconds,
    and score, passed, passed_count, total_count of the case. Adds blocks of normalized texts, metrics, tags, sources, answer
    lengths, review flags and the paths of both files.
    """
    a = F.col("answer")
    none = F.array().cast("array<string>")
    r = artifact_tags(results, variant, rag).withColumns(
        {
            "_short": text.text_block(a["short_answer"]),
            "_explanation": text.text_block(a["explanation"]),
            "_reason": text.text_block(a["experiment"]["reason"]),
            "_raw": text.text_block("raw_output"),
        }
    )
    listed = lambda c: F.filter(F.transform(F.coalesce(c, none), text.review_text), lambda x: x != "")
    r = r.withColumns(
        {
            "_examples": listed(a["examples"]),
            "_questions": listed(a["experiment"]["questions"]),
            "source_ids": F.coalesce(a["source_ids"], none),
        }
    )
    n = lambda c: F.col(f"{c}.normalized")
    shown = {
        "short_answer": n("_short"),
        "explanation": n("_explanation"),
        "examples": F.array_join("_examples", "\n"),
        "experiment_reason": n("_reason"),
        "experiment_questions": F.array_join("_questions", "\n"),
        "raw_output": n("_raw"),
    }
    r = r.withColumn("comparison_text", text.comparison_text(shown))
    lengths = F.struct(
        F.col("_short.char_count").alias("short_answer_chars"),
        F.col("_short.word_count").alias("short_answer_words"),
        F.col("_explanation.char_count").alias("explanation_chars"),
        F.col("_explanation.word_count").alias("explanation_words"),
        F.size(F.coalesce(a["examples"], none)).alias("example_count"),
        F.col("_reason.char_count").alias("experiment_reason_chars"),
        F.col("_raw.char_count").alias("raw_output_chars"),
        F.length("comparison_text").alias("comparison_chars"),
        (
            F.col("_short.paragraph_count") + F.col("_explanation.paragraph_count") + F.col("_reason.paragraph_count")
        ).alias("paragraph_count_total"),
    )
    ok = F.coalesce("validation_ok", F.lit(False))
    path = lambda kind: F.concat_ws("/", F.lit("runs"), F.lit(kind), F.lit(scope), "artifact_file").alias(kind)
    return r.select(
        F.lit(scope).alias("scope"),
        F.col("run_id").alias("id"),
        F.col("run_id").alias("raw_run_id"),
        "combo_id",
        "case_id",
        "question",
        "created_at",
        "model",
        a.alias("parsed_answer"),
        "comparison_text",
        F.struct(
            "score",
            "passed",
            "passed_count",
            "total_count",
            F.round("duration_seconds", 4).alias("duration_seconds"),
            ok.alias("validation_ok"),
        ).alias("metrics"),
        "tags",
        "source_ids",
        F.size("source_ids").alias("source_count"),
        a["request_type"].alias("request_type"),
        a["experiment"]["kind"].alias("experiment_kind"),
        lengths.alias("answer_lengths"),
        F.struct(
            a.isNull().alias("parse_error"), ok.alias("validation_ok"), (F.size("source_ids") > 0).alias("has_sources")
        ).alias("review_flags"),
        F.struct(path("raw"), path("normalized")).alias("artifact_paths"),
    )


def upsert_results(results: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest result of each (experiment, combo), with the status that its score gives."""
    every = results.unionByName(changes)
    last = every.groupBy("experiment_id", "combo_id").agg(
        F.max_by(F.struct("score", "subject_score", "updated_at"), F.col("updated_at")).alias("r")
    ).select("experiment_id", "combo_id", "r.*")
    return last.withColumn("status", F.when(F.col("score") >= STABLE_SCORE, "stable").otherwise("needs_work"))


def merge_results(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """A15 for ``io.upsert_partitions``: results of stored experiments, whose status follows from their score, and changes to them."""
    return upsert_results(stored.select(*changes.columns), changes)


def experiment_scores(results: DataFrame) -> DataFrame:
    """Averages, best and worst of each experiment's results."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,6)")), 4).cast("double")
    return results.groupBy("experiment_id").agg(
        F.count("*").alias("tested_combo_count"),
        mean("score").alias("average_score"),
        F.max("score").alias("best_score"),
        F.min("score").alias("worst_score"),
        mean("subject_score").alias("average_subject_score"),
        F.count("subject_score").alias("subject_score_count"),
    )


def answer_problems(a: Column, request_types: list[str] = REQUEST_TYPES) -> Column:
    """names of the fields of an answer (of type ANSWER) that break a rule; missing lists count as empty, empty texts as missing."""
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    among = lambda c, values: F.coalesce(c.isin(values), F.lit(False))
    e = a["experiment"]
    is_kind = lambda k: F.coalesce(e["kind"] == k, F.lit(False))
    rules = [
        ("request_type", ~among(a["request_type"], request_types)),
        ("short_answer", empty(a["short_answer"])),
        ("explanation", empty(a["explanation"])),
        ("examples", count(a["examples"]) > MAX_EXAMPLES),
        ("certainty", ~among(a["certainty"], CERTAINTIES)),
        ("source_ids", count(a["source_ids"]) > MAX_SOURCES),
        ("experiment.kind", ~among(e["kind"], EXPERIMENT_KINDS)),
        ("experiment.questions", is_kind("clarification") & ~count(e["questions"]).between(1, MAX_QUESTIONS)),
    ]
    for kind, fields in NEEDED_TEXTS.items():
        rules += [(f"experiment.{f}", is_kind(kind) & empty(e[f])) for f in fields]
    for kind, fields in NEEDED_LISTS.items():
        rules += [(f"experiment.{f}", is_kind(kind) & (count(e[f]) == 0)) for f in fields]
    plan, parts = is_kind("experiment"), F.coalesce(
        e["ingredients"],
        F.array().cast("array<struct<name:string,formula:string,amount:string,is_solution:boolean,concentration:string,purpose:string>>"),
    )
    rules += [
        ("experiment.adult_supervision_required", plan & e["adult_supervision_required"].isNull()),
        (
            "experiment.ingredients.fields",
            plan & F.exists(parts, lambda x: empty(x["name"]) | empty(x["amount"]) | empty(x["purpose"]) | x["is_solution"].isNull()),
        ),
        (
            "experiment.ingredients.concentration",
            plan & F.exists(parts, lambda x: F.coalesce(x["is_solution"], F.lit(False)) & empty(x["concentration"])),
        ),
    ]
    return F.array_compact(F.array(F.when(a.isNull(), "missing"), *[F.when(a.isNotNull() & rule, name) for name, rule in rules]))


def validate_answers(answers: DataFrame, request_types: list[str] = REQUEST_TYPES) -> DataFrame:
    """broken_rules and valid for each ``answer`` (of type ANSWER)."""
    return answers.withColumn(
        "broken_rules", answer_problems(F.col("answer"), request_types)
    ).withColumn("valid", F.size("broken_rules") == 0)

"""The given tables as the contract tables of the jobs; each mapping is deterministic and column-wise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized answer artifacts, one an event: nested as a run writes them."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    combo, score = F.col("user_id") % 20, F.when(F.col("k") > 0, F.round(F.least(F.col("value"), F.lit(100.0)) / 100, 4))
    failed = F.col("event_type") == "error"
    passed = ~failed & F.coalesce(score >= 0.1, F.lit(False))
    kind = F.element_at(F.array(*map(F.lit, ("none", "clarification", "experiment"))), (F.col("k") % 3 + 1).cast("int"))
    prompt = lambda role: F.concat(F.lit(f"{role}_"), (F.col("user_id") % 5).cast("string"))
    answer = F.struct(
        F.col("event_type").alias("request_type"),
        F.when(F.col("k") % 2 == 0, "high").otherwise("low").alias("certainty"),
        F.concat_ws(" ", F.lit("Answer"), F.col("event_type"), F.col("k").cast("string")).alias("short_answer"),
        F.concat(
            F.lit("It depends on "), F.col("event_type"), F.lit(".\n\nValue: "), F.col("value").cast("string"), F.lit(".")
        ).alias("explanation"),
        F.transform(
            F.when(F.col("k") % 3 > 0, F.sequence(F.lit(1), F.col("k") % 3)).otherwise(F.array().cast("array<int>")),
            lambda i: F.concat(F.lit("Example "), i.cast("string")),
        ).alias("examples"),
        F.struct(
            kind.alias("kind"),
            F.when(kind == "clarification", F.lit("Needs detail")).alias("reason"),
            F.when(kind == "clarification", F.array(F.lit("Which one?"))).alias("questions"),
        ).alias("experiment"),
    )
    sources = F.transform(
        F.when(F.col("k") % 5 > 0, F.sequence(F.lit(1), F.col("k") % 5)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("S"), i.cast("string")),
    )
    return e.select(
        F.concat(F.lit("exp_"), (F.col("user_id") % 4).cast("string")).alias("scope"),
        F.col("event_id").alias("id"),
        F.concat(F.lit("raw_"), F.col("event_id").cast("string")).alias("raw_run_id"),
        F.concat(F.lit("combo_"), combo.cast("string")).alias("combo_id"),
        F.when(combo % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("combo_"), (combo % 3).cast("string"))).alias("active_combo_id"),
        F.concat(F.lit("exp_"), (F.col("user_id") % 4).cast("string")).alias("experiment_id"),
        F.concat(F.lit("model_"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.lit("set_1").alias("case_set_id"),
        F.concat(F.lit("case_"), (F.col("k") % 12).cast("string")).alias("case_id"),
        F.concat(F.lit("Question "), (F.col("k") % 12).cast("string")).alias("question"),
        F.when(~failed, answer).alias("parsed_answer"),
        F.when(failed, F.concat(F.lit("broken output "), F.col("k").cast("string"))).alias("raw_output"),
        F.struct(
            score.alias("score"),
            passed.alias("passed"),
            F.when(passed, 2).otherwise(1).alias("passed_count"),
            F.lit(2).alias("total_count"),
            (F.col("k") / 10).alias("duration_seconds"),
            (~failed).alias("validation_ok"),
        ).alias("metrics"),
        F.array(F.col("event_type"), F.when(passed, "pass").otherwise("fail")).alias("tags"),
        sources.alias("source_ids"),
        F.col("event_type").alias("request_type"),
        F.when(~failed, kind).alias("experiment_kind"),
        F.struct((F.col("k") % 3).alias("example_count")).alias("answer_lengths"),
        F.struct(failed.alias("parse_error")).alias("review_flags"),
        F.struct(
            F.struct(
                F.when(combo % 4 > 0, F.concat(F.lit("Combo "), combo.cast("string"))).alias("title"), F.lit("base").alias("kind")
            ).alias("base_combo"),
            F.struct(F.when(combo % 2 > 0, F.concat(F.lit("Active "), combo.cast("string"))).alias("title")).alias("active_combo"),
            F.struct(F.concat(F.lit("combo_"), combo.cast("string")).alias("base_combo_id")).alias("combo_relation"),
            F.create_map(
                F.lit("system"), F.struct(prompt("sys").alias("prompt_id")), F.lit("user"), F.struct(prompt("usr").alias("prompt_id"))
            ).alias("roles"),
            F.struct(F.when(F.col("user_id") % 2 == 0, F.lit("fsh_1")).alias("prompt_id")).alias("fewshot"),
        ).alias("prompt_snapshot"),
        F.struct(F.concat(F.lit("sig_"), (F.col("user_id") % 2).cast("string")).alias("signature")).alias("execution"),
        F.struct(
            F.concat(F.lit("runs/normalized/"), F.col("event_id").cast("string"), F.lit(".json")).alias("normalized"),
            F.concat(F.lit("runs/raw/"), F.col("event_id").cast("string"), F.lit(".json")).alias("raw"),
        ).alias("artifact_paths"),
    )


def full_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with all fields, one an event; rules are broken by the event's number."""
    i = F.col("event_id")
    text = lambda c: F.lit(c)
    many = lambda prefix, n: F.transform(F.sequence(F.lit(0), n), lambda x: F.concat(F.lit(prefix), x.cast("string")))
    upto = lambda prefix, n: F.slice(many(prefix, n), 2, F.greatest(n.cast("int"), F.lit(0)))  # noqa: E731  prefix1 .. prefix n
    none = F.array().cast("array<string>")
    part = F.struct(
        text("salt").alias("name"),
        F.lit(None).cast("string").alias("formula"),
        F.when(i % 31 == 0, "").otherwise("1 g").alias("amount"),
        (i % 2 == 0).alias("is_solution"),
        F.when(i % 6 != 2, "1 M").alias("concentration"),
        text("taste").alias("purpose"),
    )
    experiment = F.struct(
        F.when(i % 4 == 0, "none").when(i % 4 == 1, "clarification").when(i % 8 == 3, "other").otherwise("experiment").alias("kind"),
        F.when(i % 5 == 0, "").otherwise("why").alias("reason"),
        upto("Q", i % 5).alias("questions"),
        F.when(i % 19 > 0, "title").alias("title"),
        text("goal").alias("goal"),
        F.when(
            i % 29 == 0,
            F.array().cast(
                "array<struct<name:string,formula:string,amount:string,is_solution:boolean,concentration:string,purpose:string>>"
            ),
        ).otherwise(F.array(part)).alias("ingredients"),
        F.array(text("cup")).alias("equipment"),
        F.array(text("gloves")).alias("protective_equipment"),
        F.when(i % 37 == 0, none).otherwise(F.array(text("stir"))).alias("steps"),
        F.array(text("careful")).alias("safety_notes"),
        F.when(i % 23 == 0, "").otherwise("sink").alias("disposal"),
        F.when(i % 41 > 0, True).alias("adult_supervision_required"),
    )
    answer = F.struct(
        F.when(i % 7 == 0, "other").otherwise(
            F.element_at(F.array(*map(F.lit, ("theory", "experiment", "mixed"))), (i % 3 + 1).cast("int"))
        ).alias("request_type"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("Short "), i.cast("string"))).alias("short_answer"),
        F.when(i % 13 > 0, "Because  of this.\n\n\nAnd that.").alias("explanation"),
        upto("E", i % 4).alias("examples"),
        F.when(i % 17 == 0, "sure").otherwise("high").alias("certainty"),
        upto("S", i % 7).alias("source_ids"),
        experiment.alias("experiment"),
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        i.alias("run_id"),
        F.concat(F.lit("combo_"), (F.col("user_id") % 20).cast("string")).alias("combo_id"),
        F.concat(F.lit("case_"), (k % 12).cast("string")).alias("case_id"),
        F.lit("Why?").alias("question"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.lit("model_1").alias("model"),
        F.when(i % 43 > 0, answer).alias("answer"),
        F.when(i % 43 == 0, F.concat(F.lit("broken "), i.cast("string"))).otherwise("").alias("raw_output"),
        (i % 43 > 0).alias("validation_ok"),
        (k / 10).alias("duration_seconds"),
        F.lit(0.5).alias("score"),
        (i % 2 == 0).alias("passed"),
        F.lit(1).alias("passed_count"),
        F.lit(2).alias("total_count"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks: lines of documents (section = doc_id), and each conversation as one special block (section = -1 - conv_id).

    User turns are the questions of a worked example or an exercise set, assistant turns the answers; every fifth
    conversation is a feature.
    """
    i = F.col("block_index")
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("section_id"), F.posexplode(F.split("text", "\n", -1)).alias("block_index", "line")
    )
    kind = (
        F.when(i % 13 == 6, "heading").when(i % 13 == 9, "feature").when(
            i % 7 == 3, "formula_or_equation"
        ).when(i % 7 == 5, "figure").when(i % 11 == 4, "table").otherwise("paragraph")
    )
    shown = F.when(i % 13 == 6, F.when(i % 2 == 0, "Media Attributions").otherwise("Heading")).otherwise(F.col("line"))
    lines = lines.select("section_id", "block_index", kind.alias("block_type"), shown.alias("text"))

    turn = F.struct("turn", "text")
    own = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, turn))), lambda x: x["text"])
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        own("user").alias("q"), own("assistant").alias("a"), F.min_by("text", "turn").alias("opening")
    )
    n = F.col("conv_id")
    worked, exercise = n % 5 < 2, (n % 5 >= 2) & (n % 5 < 4)
    child = lambda kind, text=F.lit(None).cast("string"), items=F.lit(None).cast("array<struct<number:int,text:string>>"): F.struct(
        F.lit(kind).alias("node_type"), text.alias("text"), F.lit(True).alias("ordered"), items.alias("items")
    )
    listed = lambda c: F.transform(c, lambda x, k: F.struct((k + 1 + n % 3).cast("int").alias("number"), x.alias("text")))
    title = lambda a, b: F.when(worked, a).otherwise(b)
    children = F.array(
        child("heading", title("Problems", "Questions")),
        child("paragraph", F.when(n % 3 > 0, F.col("opening"))),
        child("list", items=listed("q")),
        child("heading", F.lit("Solutions")),
        child("list", items=listed("a")),
        child("heading", title("Test Yourself", "Notes")),
        child("paragraph", F.element_at("q", -1)),
        child("list", items=listed("a")),
        child("heading", F.lit("Answer")),
        child("figure", F.lit("a figure")),
        child("paragraph", F.lit("See above.")),
    )
    special = c.select(
        (-1 - n).alias("section_id"),
        F.lit(0).alias("block_index"),
        F.when(worked, "worked_example").when(exercise, "exercise_set").otherwise("feature").alias("block_type"),
        F.col("opening").alias("text"),
        F.when(n % 7 > 0, F.concat(F.lit("Example "), n.cast("string"))).alias("title"),
        F.when(worked | exercise, children).alias("children"),
    )
    return lines.unionByName(special, allowMissingColumns=True)


#: The same review rows in SQL (without the text columns), as a common table expression.
REVIEW_SQL = r"""
ev as (select *, cast(json_extract(props, '$.k') as int) as k, user_id % 20 as c from events),
ev2 as (select *, case when k > 0 then round(least(value, 100.0) / 100, 4) end as score, event_type = 'error' as failed from ev),
review as (select event_id as row_id, 'raw_' || event_id as raw_run_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as created_at, 'exp_' || (user_id % 4) as experiment_id, 'sig_' || (user_id % 2) as execution_signature,
    'model_' || (user_id % 3) as model, 'combo_' || c as combo_id, case when c % 4 > 0 then 'Combo ' || c when c % 2 > 0 then 'Active ' || c else 'combo_' || c end as combo_title, 'base' as combo_kind,
    'combo_' || c as base_combo_id, case when c % 3 > 0 then 'combo_' || (c % 3) end as active_combo_id, 'sys_' || (user_id % 5) as system_prompt_id, 'usr_' || (user_id % 5) as user_prompt_id,
    case when user_id % 2 = 0 then 'fsh_1' end as fewshot_id, 'set_1' as case_set_id, 'case_' || (k % 12) as case_id, 'Question ' || (k % 12) as question, score,
    not failed and coalesce(score >= 0.1, false) as passed, case when not failed and coalesce(score >= 0.1, false) then 2 else 1 end as passed_count, 2 as total_count, k / 10 as duration_seconds,
    not failed as validation_ok, failed as parse_error, event_type as request_type, case when not failed then ['none', 'clarification', 'experiment'][k % 3 + 1] end as experiment_kind,
    case when failed then null when k % 2 = 0 then 'high' else 'low' end as certainty, k % 5 as source_count, k % 3 as example_count,
    [event_type, case when not failed and coalesce(score >= 0.1, false) then 'pass' else 'fail' end] as tags, 'exp_' || (user_id % 4) as scope from ev2)
"""

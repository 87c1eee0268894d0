"""Queries of the review tables and their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import review as r
from tessera.operators import rollup, textindex
from tessera.sources import io
from tessera.sources.adapters import REVIEW_SQL, artifacts, table
from tessera.sources.scratch import folder

_rows = lambda s, d: r.flatten_artifacts(artifacts(s, d))
FLAT = [
    "row_id",
    "raw_run_id",
    "created_at",
    "experiment_id",
    "execution_signature",
    "model",
    "combo_id",
    "combo_title",
    "combo_kind",
    "base_combo_id",
    "active_combo_id",
    "system_prompt_id",
    "user_prompt_id",
    "fewshot_id",
    "case_set_id",
    "case_id",
    "question",
    "score",
    "passed",
    "passed_count",
    "total_count",
    "duration_seconds",
    "validation_ok",
    "parse_error",
    "request_type",
    "experiment_kind",
    "certainty",
    "source_count",
    "example_count",
]
KEY = ["row_id", "case_id", "combo_id", "created_at", "score"]


def _joined(df, *arrays):
    """Arrays as text, so that both engines compare them alike."""
    return df.withColumns({c: F.array_join(c, ",") for c in arrays})


def _experiments(rows):
    return rows.select(F.col("experiment_id").alias("id")).distinct().where("id <> 'exp_3'").select(
        "id", F.concat(F.lit("Name "), "id").alias("name"), F.lit("active").alias("status"), F.array(F.lit("x"), F.col("id")).alias("tags")
    )


_prompt = lambda s, d: r.prompt_rows(_rows(s, d), "sys_1", ["combo_2"])

def _all_scopes(s, d):
    """Review rows written once, a folder a scope; the tables of all scopes that are found there, together."""
    path = folder(s)
    _rows(s, d).write.partitionBy("scope").parquet(path)
    names = [row["scope"] for row in s.read.parquet(path).select("scope").distinct().collect()]
    return r.union_scopes({name: s.read.parquet(f"{path}/scope={name}") for name in names})


def _read_files(s, d):
    """S3: a file for each supplier, some of them blank, broken, of another kind or with a value of another type."""
    k, path = F.col("s_suppkey"), folder(s)
    record = F.to_json(F.struct(k.alias("id"), F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation")).alias("place")))
    value = (
        F.when(k % 11 == 1, " \n").when(k % 11 == 3, F.substring(record, 1, 20)).when(k % 11 == 5, F.concat(F.lit("["), record, F.lit("]")))
        .when(k % 11 == 7, F.replace(record, F.lit('"id":'), F.lit('"id":"x",  "k":'))).otherwise(F.replace(record, F.lit(","), F.lit(",\n ")))
    )
    io.write_files(table(s, d, "supplier").select(k.alias("file"), value.alias("value")), path, "file")
    schema = s.createDataFrame([], "id long, name string, place struct<nation:long>").schema
    return io.read_files(s, path, schema, pattern="*.txt")


def _files(s, d):
    return _read_files(s, d)[0].select("id", "name", F.col("place.nation").alias("nation"))


def _csv_file(s, d):
    """Written as CSV with a header and read back."""
    path = folder(s)
    io.write_csv(r.csv_ready(_rows(s, d).select("row_id", "combo_title", "tags")), path)
    return s.read.option("header", True).option("escape", "\\").option("nullValue", "\u0000").schema(
        "row_id string, combo_title string, tags string"
    ).csv(path)


def _jsonl(s, d):
    """Documents written as JSON lines and read back by schema."""
    path = folder(s)
    io.write_jsonl(table(s, d, "documents").select("doc_id", "lang", "text"), path)
    return io.read_jsonl(s, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("h"))


def _notes(rows):
    base = rows.select(
        "row_id",
        "case_id",
        "combo_id",
        F.lit("first").alias("note_text"),
        (F.col("row_id") % 3 == 0).alias("preferred"),
        F.col("created_at").alias("updated_at"),
    )
    later = base.where("row_id % 5 = 0").withColumns(
        {"note_text": F.lit("second"), "preferred": F.lit(True), "updated_at": F.lit("2099-01-01T00:00:00")}
    )
    return r.upsert_notes(base, later)


def _cells(s, d):
    """Cells of the review rows, which arrive in three parts."""
    path, rows = folder(s), _rows(s, d)
    for part in range(3):
        stored = rollup.keep_up(path, rows.where(F.col("row_id") % 3 == part))
    return stored


#: Searched for in documents by an index: words of any length, with blanks, beyond ASCII, and in no text.
SEARCHES = ("e", "on", "THE", "de la", "and the", "ción", "license", "no such text at all")


def _indexed_search(s, d):
    path = folder(s)
    textindex.write_index(table(s, d, "documents"), path, "doc_id", "text", "source")
    found = [textindex.search(s, path, q).select(F.lit(q).alias("query"), F.col("id").alias("doc_id")) for q in SEARCHES]
    return reduce(lambda a, b: a.union(b), found)


QUERIES = {
    "p1_review_rows": lambda s, d: _rows(s, d).select(*FLAT),
    "p3_review_filter": lambda s, d: r.filter_rows(
        _rows(s, d), is_in={"combo_id": ["combo_1", "combo_2", "combo_3"], "request_type": []}, passed=True, score_range=(0.2, 0.9)
    ).select(*KEY),
    "p4_text_search": lambda s, d: r.filter_rows(_rows(s, d), query="Combo 1").select(*KEY),
    "p4_indexed_search": _indexed_search,
    "p5_tag_superset": lambda s, d: r.filter_rows(_rows(s, d), tags=["click", "pass"]).select(*KEY),
    "w1_latest": lambda s, d: r.latest(_rows(s, d)).select(*KEY),
    "a1_metrics": lambda s, d: r.metrics(_rows(s, d)),
    "a1_tag_counts": lambda s, d: r.tag_counts(_rows(s, d)),
    "a2_combo_summary": lambda s, d: _joined(r.combo_summary(_rows(s, d)), "request_types", "experiment_kinds"),
    "a3_case_summary": lambda s, d: _joined(r.case_summary(_rows(s, d)), "request_types", "experiment_kinds"),
    "a1_metrics_kept_up": lambda s, d: rollup.metrics(_cells(s, d)),
    "a2_combos_kept_up": lambda s, d: _joined(rollup.combo_summary(_cells(s, d)), "request_types", "experiment_kinds"),
    "a3_cases_kept_up": lambda s, d: _joined(rollup.case_summary(_cells(s, d)), "request_types", "experiment_kinds"),
    "w2_combo_ranking": lambda s, d: r.combo_ranking(r.latest(_rows(s, d))).select(
        "rank", "combo_id", "average_score", "pass_rate", "stability_rate", "validation_rate", "speed_score", "ranking_score"
    ),
    "w3_speed_scores": lambda s, d: r.speed_scores(r.combo_summary(_rows(s, d))).select(
        "combo_id", "average_duration_seconds", "speed_score"
    ),
    "w4_case_difficulty": lambda s, d: r.case_difficulty(_rows(s, d)).select(
        "rank", "case_id", "pass_rate", "score_range", "request_type_count", "experiment_kind_count", "parse_error_rate", "difficulty_score"
    ),
    "a7_facets": lambda s, d: r.facets(_rows(s, d)),
    "a7_ranges": lambda s, d: r.ranges(_rows(s, d)),
    "j7_prompt_rows": lambda s, d: _joined(_prompt(s, d), "matched_prompt_roles").select(*KEY, "matched_prompt_roles", "matched_by_combo"),
    "a4_prompt_combos": lambda s, d: _joined(
        r.prompt_combo_performance(_prompt(s, d)), "active_combo_ids", "matched_prompt_roles", "experiment_ids", "models"
    ),
    "a5_prompt_models": lambda s, d: r.prompt_model_performance(_prompt(s, d)),
    "a14_prompt_usage": lambda s, d: _joined(r.prompt_usage_summary(_prompt(s, d)), "models", "signatures"),
    "t2_top_combos": lambda s, d: r.top_prompt_entries(
        r.prompt_combo_performance(_prompt(s, d)), "combo_id"
    ).select("combo_id", "average_score", "run_count"),
    "t1_best_combos": lambda s, d: r.best(
        r.combo_summary(_rows(s, d)), "average_score", 0.38, "combo_id"
    ).select("combo_id", "average_score"),
    "a17_score_summary": lambda s, d: r.score_summary(_rows(s, d)),
    "u1_all_scopes": lambda s, d: _all_scopes(s, d).select(*KEY, "scope"),
    "s3_files": _files,
    "s3_dead_letters": lambda s, d: _read_files(s, d)[1].select(F.regexp_extract("file_path", "file=([0-9]+)", 1).cast("long").alias("id"), "reason", "size"),
    "s8_scopes": lambda s, d: _joined((lambda rows: r.scopes(rows, _experiments(rows)))(_rows(s, d)), "experiment_tags"),
    "s6_scope_report": lambda s, d: r.scope_report(_rows(s, d)).withColumns(
        {
            c: F.aggregate(
                F.from_json(c, f"array<struct<{n}:long,average_score:double>>"), F.lit(0).cast("long"), (lambda n: lambda a, x: a + x[n])(n)
            ) for c, n in (("combo_rows", "case_count"), ("case_rows", "combo_count"))
        }
    ),
    "s5_csv_ready": lambda s, d: r.csv_ready(_rows(s, d).select("row_id", "active_combo_id", "passed_count", "tags", "source_ids")),
    "s5_csv_file": _csv_file,
    "s1_jsonl": _jsonl,
    "t6_review_notes": lambda s, d: _notes(_rows(s, d)),
}


def _sql(body: str) -> str:
    return f"with {REVIEW_SQL.strip()} {body}"


_K = ", ".join(KEY)
_R4 = "round(avg(score::decimal(18, 6))::decimal(18, 10), 4)::double"
_COMBO = """, combo as (select combo_id, count(*) as case_count, count(*) filter (passed) as passed_case_count, count(*) filter (parse_error) as parse_error_count, count(*) filter (not validation_ok) as validation_fail_count,
    round(avg(score::decimal(18, 6))::decimal(18, 10), 4)::double as average_score, round(count(*) filter (passed) / count(*), 4) as pass_rate, round(avg(duration_seconds::decimal(18, 6))::decimal(18, 10), 4)::double as average_duration_seconds from {src} group by combo_id),
speed as (select *, case when min(average_duration_seconds) over () is null then 0.0 when min(average_duration_seconds) over () = max(average_duration_seconds) over () then 1.0 when average_duration_seconds is null then 0.0
    else round(1.0 - (average_duration_seconds - min(average_duration_seconds) over ()) / (max(average_duration_seconds) over () - min(average_duration_seconds) over ()), 4) end as speed_score from combo)"""
_LATEST = (
    ", latest as (select * from review qualify row_number() over (partition by case_id, combo_id order by created_at desc, row_id desc) = "
    "1)"
)
_PROMPT = """, roles as (select *, list_filter([case when system_prompt_id = 'sys_1' then 'system' end, case when user_prompt_id = 'sys_1' then 'user' end, case when fewshot_id = 'sys_1' then 'fewshot' end], lambda x: x is not null) as matched,
    coalesce(combo_id = 'combo_2', false) or coalesce(base_combo_id = 'combo_2', false) or coalesce(active_combo_id = 'combo_2', false) as by_combo from review), prompt as (select * from roles where len(matched) > 0 or by_combo)"""
_PERF = (
    "count(*) as run_count, count(score) as scored_run_count, round(avg(score::decimal(18, 6))::decimal(18, 10), 4)::double as "
    "average_score, round(max(score), 4) as best_score, round(count(*) filter (passed) / count(*), 4) as pass_rate, max(created_at) as "
    "latest_run_at"
)
_BY_COMBO = _PROMPT + f""", pc as (select combo_id, {_PERF}, arg_max(combo_title, (created_at, row_id)) as combo_title, arg_max(combo_kind, (created_at, row_id)) as combo_kind, arg_max(base_combo_id, (created_at, row_id)) as base_combo_id,
    array_to_string(list_sort(coalesce(list(distinct active_combo_id) filter (active_combo_id is not null), [])), ',') as active_combo_ids, array_to_string(list_sort(list_distinct(flatten(list(matched)))), ',') as matched_prompt_roles,
    array_to_string(list_sort(list(distinct experiment_id)), ',') as experiment_ids, array_to_string(list_sort(list(distinct model)), ',') as models, count(distinct model) as model_count from prompt group by combo_id),
pm as (select combo_id, model, avg(score) as m, max(score) as x from prompt group by all),
bm as (select combo_id, model as best_model from pm qualify row_number() over (partition by combo_id order by coalesce(m, 0) desc, coalesce(x, 0) desc, model) = 1)"""

SQL = {
    "p1_review_rows": _sql(f"select {', '.join(FLAT)} from review"),
    "p3_review_filter": _sql(
        f"select {_K} from review where combo_id in ('combo_1', 'combo_2', 'combo_3') and passed and (score is null or score between 0.2 "
        f"and 0.9)"
    ),
    "p4_text_search": _sql(
        f"select {_K} from review where contains(lower(combo_title || ' ' || case_id || ' ' || question || ' ' || case when parse_error "
        f"then '' else 'Answer ' || request_type || ' ' end), 'combo 1')"
    ),
    "p5_tag_superset": _sql(f"select {_K} from review where list_contains(tags, 'click') and list_contains(tags, 'pass')"),
    "w1_latest": _sql(f"{_LATEST} select {_K} from latest"),
    "a1_metrics": _sql(
        f"select count(*) as review_row_count, count(distinct combo_id) as combo_count, count(distinct case_id) as case_count, {_R4} as "
        f"average_score, round(count(*) filter (passed) / count(*), 4) as pass_rate, count(*) filter (parse_error) as parse_error_count "
        f"from review"
    ),
    "a1_tag_counts": _sql("select tag, count(*) as n from (select unnest(tags) as tag from review) group by tag"),
    "a2_combo_summary": _sql("""select combo_id, arg_min(combo_title, o) as combo_title, arg_min(combo_kind, o) as combo_kind, arg_min(base_combo_id, o) as base_combo_id, arg_min_null(active_combo_id, o) as active_combo_id, arg_min(system_prompt_id, o) as system_prompt_id,
        arg_min(user_prompt_id, o) as user_prompt_id, arg_min_null(fewshot_id, o) as fewshot_id, count(*) as case_count, count(*) filter (passed) as passed_case_count, count(*) filter (not passed) as failed_case_count, count(*) filter (parse_error) as parse_error_count,
        count(*) filter (not validation_ok) as validation_fail_count, round(avg(score::decimal(18, 6))::decimal(18, 10), 4)::double as average_score, round(count(*) filter (passed) / count(*), 4) as pass_rate, round(avg(duration_seconds::decimal(18, 6))::decimal(18, 10), 4)::double as average_duration_seconds,
        array_to_string(list_sort(list(distinct request_type)), ',') as request_types, array_to_string(list_sort(list(distinct experiment_kind) filter (experiment_kind is not null)), ',') as experiment_kinds
        from (select *, (combo_id, case_id, created_at, row_id) as o from review) group by combo_id"""),
    "a3_case_summary": _sql("""select case_id, min(question) as question, count(*) as combo_count, count(*) filter (passed) as passed_combo_count, count(*) filter (not passed) as failed_combo_count, count(*) filter (parse_error) as parse_error_count, round(avg(score::decimal(18, 6))::decimal(18, 10), 4)::double as average_score,
        round(count(*) filter (passed) / count(*), 4) as pass_rate, max(combo_id) filter (b = 1) as best_combo_id, max(score) filter (b = 1) as best_score, array_to_string(list_sort(list(distinct request_type)), ',') as request_types,
        array_to_string(list_sort(list(distinct experiment_kind) filter (experiment_kind is not null)), ',') as experiment_kinds
        from (select *, row_number() over (partition by case_id order by case when coalesce(score, 0) = 0 then -1 else score end desc, combo_id, created_at, row_id) as b from review) group by case_id"""),
    "w2_combo_ranking": _sql(_LATEST + _COMBO.format(src="latest") + """, k as (select *, 1.0::double - parse_error_count / case_count as st, 1.0::double - validation_fail_count / case_count as va from speed),
        z as (select *, round(coalesce(average_score, 0) * 0.55::double + coalesce(pass_rate, 0) * 0.25::double + st * 0.1::double + va * 0.05::double + speed_score * 0.05::double, 4) as ranking_score from k)
        select row_number() over (order by ranking_score desc, coalesce(average_score, 0) desc, combo_id)::int as rank, combo_id, average_score, pass_rate, round(st, 4) as stability_rate, round(va, 4) as validation_rate, speed_score, ranking_score from z"""),
    "w3_speed_scores": _sql(_COMBO.format(src="review") + " select combo_id, average_duration_seconds, speed_score from speed"),
    "w4_case_difficulty": _sql(""", q as (select case_id, count(*) as n, count(*) filter (parse_error) as e, round(count(*) filter (passed) / count(*), 4) as pass_rate, coalesce(round(max(score) - min(score), 4), 0.0) as score_range,
        count(distinct request_type) as request_type_count, count(distinct experiment_kind) as experiment_kind_count from review group by case_id),
        z as (select *, round((1.0::double - coalesce(pass_rate, 0)) * 0.6::double + least(1.0::double, score_range + greatest(request_type_count - 1, 0) * 0.2::double + greatest(experiment_kind_count - 1, 0) * 0.15::double) * 0.25::double + e / n * 0.15::double, 4) as difficulty_score from q)
        select row_number() over (order by difficulty_score desc, case_id)::int as rank, case_id, pass_rate, score_range, request_type_count, experiment_kind_count, round(e / n, 4) as parse_error_rate, difficulty_score from z"""),
    "a7_facets": _sql(" ".join(["select 'tag' as facet, tag as value, count(*) as n from (select unnest(tags) as tag from review) group by tag"] + [f"union all select '{c}', {c}, count(*) from review where {c} is not null group by {c}" for c in ("request_type", "experiment_kind", "combo_id", "case_id")])),
    "a7_ranges": _sql(" union all ".join(f"select '{m}' as measure, min({m})::double as min, max({m})::double as max, round(avg({m}::decimal(18, 6))::decimal(18, 10), 4)::double as average from review" for m in ("score", "duration_seconds", "source_count", "example_count"))),
    "j7_prompt_rows": _sql(f"{_PROMPT} select {_K}, array_to_string(matched, ',') as matched_prompt_roles, by_combo as matched_by_combo from prompt"),
    "a4_prompt_combos": _sql(f"{_BY_COMBO} select pc.*, best_model from pc left join bm using (combo_id)"),
    "a5_prompt_models": _sql(f"""{_PROMPT}, p as (select model, {_PERF}, count(distinct combo_id) as combo_count, count(distinct experiment_id) as experiment_count from prompt group by model),
        c as (select model, combo_id, {_PERF}, arg_max(combo_title, (created_at, row_id)) as title from prompt group by model, combo_id),
        b as (select model, combo_id as best_combo_id, title as best_combo_title from c qualify row_number() over (partition by model order by coalesce(average_score, 0) desc, coalesce(best_score, 0) desc, coalesce(pass_rate, 0) desc, run_count desc, combo_id) = 1)
        select p.*, best_combo_id, best_combo_title from p left join b using (model)"""),
    "a14_prompt_usage": _sql(
        f"{_PROMPT} select count(*) as run_count, count(score) as scored_run_count, array_to_string(list_sort(list(distinct model)), ',') "
        f"as models, max(created_at) as latest_run_at, array_to_string(list_sort(list(distinct execution_signature)), ',') as signatures "
        f"from prompt"
    ),
    "t2_top_combos": _sql(
        f"{_BY_COMBO} select combo_id, average_score, run_count from pc order by coalesce(average_score, 0) desc, coalesce(best_score, 0) "
        f"desc, coalesce(pass_rate, 0) desc, run_count desc, combo_id limit 3"
    ),
    "t1_best_combos": _sql(
        "select combo_id, average_score from (select combo_id, round(avg(score::decimal(18, 6))::decimal(18, 10), 4)::double as "
        "average_score from review group by combo_id) where average_score >= 0.38"
    ),
    "a17_score_summary": _sql(
        f"select count(*) as row_count, count(score) as scored_count, min(score) as min_score, max(score) as max_score, {_R4} as "
        f"average_score, coalesce(min(score), 0.0) as low_bound, coalesce(max(score), 1.0) as high_bound from review"
    ),
    "s3_files": "select s_suppkey as id, s_name as name, s_nationkey as nation from supplier where s_suppkey % 11 not in (1, 3, 5, 7)",
    "s3_dead_letters": (
        """with r as (select s_suppkey as id, '{"id":' || s_suppkey || ',"name":"' || s_name || '","place":{"nation":' || s_nationkey || '}}' as t from supplier) """
        "select id, case id % 11 when 1 then 'blank' when 3 then 'not JSON' when 5 then 'not an object' else 'a value of another type' end as reason, "
        """(1 + case id % 11 when 1 then 2 when 3 then 20 when 5 then length(t) + 2 else length(replace(t, '"id":', '"id":"x",  "k":')) end)::int as size from r where id % 11 in (1, 3, 5, 7)"""
    ),
    "u1_all_scopes": _sql(f"select {_K}, scope from review"),
    "s8_scopes": _sql(
        "select scope, count(*) as artifact_count, case when scope <> 'exp_3' then 'Name ' || scope end as experiment_name, case when "
        "scope <> 'exp_3' then 'active' end as experiment_status, case when scope <> 'exp_3' then 'x,' || scope else '' end as "
        "experiment_tags, scope || case when scope <> 'exp_3' then ' | Name ' || scope else '' end as label from review group by scope"
    ),
    "s6_scope_report": _sql(
        f"select scope, count(*) as raw_file_count, count(*) as normalized_file_count, count(*) as review_row_count, count(distinct "
        f"combo_id) as combo_count, count(distinct case_id) as case_count, {_R4} as average_score, round(count(*) filter (passed) / "
        f"count(*), 4) as pass_rate, count(*) filter (parse_error) as parse_error_count, count(*) as combo_rows, count(case_id) as "
        f"case_rows from review group by scope"
    ),
    "s5_csv_ready": _sql("""select row_id::varchar as row_id, coalesce(active_combo_id, '') as active_combo_id, passed_count::varchar as passed_count, '["' || array_to_string(tags, '","') || '"]' as tags, case when source_count = 0 then '[]' else '["' || array_to_string(list_transform(range(1, source_count + 1), lambda x: 'S' || x), '","') || '"]' end as source_ids from review"""),
    "s5_csv_file": _sql("""select row_id::varchar as row_id, combo_title, '["' || array_to_string(tags, '","') || '"]' as tags from review"""),
    "s1_jsonl": "select doc_id, lang, md5(text) as h from documents",
    "t6_review_notes": _sql(
        "select row_id, case_id, combo_id, case when row_id % 5 = 0 then 'second' else 'first' end as note_text, row_id % 5 = 0 or row_id "
        "% 3 = 0 as preferred, case when row_id % 5 = 0 then '2099-01-01T00:00:00' else created_at end as updated_at from review"
    ),
}
SQL |= {kept: SQL[own] for kept, own in (("a1_metrics_kept_up", "a1_metrics"), ("a2_combos_kept_up", "a2_combo_summary"), ("a3_cases_kept_up", "a3_case_summary"))}
SQL["p4_indexed_search"] = " union all ".join(
    f"select '{q}' as query, doc_id from documents where contains(lower(concat_ws(' ', text, source)), '{q.lower()}')" for q in SEARCHES
)

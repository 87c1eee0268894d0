"""Queries of text functions, evaluation, comparison and similarity, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import compare, evaluation, review, similarity
from tessera.plans.review_queries import _K, KEY, _sql
from tessera.sources import io
from tessera.sources.adapters import artifacts, full_answers, table
from tessera.sources.scratch import folder

_rows = lambda s, d: review.flatten_artifacts(artifacts(s, d))
_docs = lambda s, d: table(s, d, "documents")


def _items(s, d):
    return _docs(s, d).select(F.col("doc_id").alias("item_id"), F.col("source").alias("group_id"), F.lit("").alias("label"), "text")


def _vectors(s, d):
    return table(s, d, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("group_id"), F.col("embedding").alias("vector")
    )


def _answers(s, d):
    """Assistant turns as answers; the turn is the case."""
    c = table(s, d, "conversations").where("role = 'assistant'")
    kind = F.element_at(F.array(*map(F.lit, ("none", "clarification", "experiment"))), (F.col("conv_id") % 3 + 1).cast("int"))
    answer = F.struct(
        F.when(F.col("turn") % 4 == 1, "explain").otherwise("plan").alias("request_type"),
        F.lit("high").alias("certainty"),
        F.col("text").alias("short_answer"),
        F.struct(kind.alias("kind")).alias("experiment"),
    )
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("run_id"),
        F.concat(F.lit("turn_"), (F.col("turn") % 4).cast("string")).alias("case_id"),
        F.concat(F.lit("combo_"), (F.col("conv_id") % 7).cast("string")).alias("combo_id"),
        F.when(F.col("conv_id") % 11 > 0, answer).alias("answer"),
    )


def _cases(s, d):
    """A case for each remainder of the answers' turns, with what it expects."""
    t = table(s, d, "conversations").where("role = 'assistant'").select((F.col("turn") % 4).alias("t")).distinct()
    kinds = F.array(F.lit("none"), F.lit("experiment"))
    return t.select(
        F.concat(F.lit("turn_"), F.col("t").cast("string")).alias("case_id"),
        F.array(F.when(F.col("t") == 1, "explain").otherwise("plan")).alias("expected_request_type"),
        F.when(F.col("t") == 3, kinds).alias("expected_experiment_kind"),
        (F.col("t") == 1).alias("forbid_concentration_patterns"),
    )


def _phrases(s, d):
    """Forbidden phrases of the cases: all clauses of two words or more of all benchmark items, dealt by the item's number."""
    clause = F.explode(F.split("text", r"[.,;:!?\n]+")).alias("phrase")
    rows = table(s, d, "benchmark").select(F.concat(F.lit("turn_"), (F.col("item_id") % 4).cast("string")).alias("case_id"), clause)
    return rows.select("case_id", F.btrim("phrase").alias("phrase")).where("contains(phrase, ' ')")


def _scored(s, d):
    return evaluation.score_answers(_answers(s, d), _cases(s, d), _phrases(s, d))


def _combos(s, d):
    return _rows(s, d).select("combo_id").distinct()


def _case_ids(s, d):
    return _rows(s, d).select("case_id").distinct()


def _plan(s, d, mode):
    rows = _rows(s, d).where("not (case_id = 'case_3' and combo_id in ('combo_1', 'combo_5'))")
    return evaluation.plan_runs(_combos(s, d), _case_ids(s, d), rows, mode, "sig_1")


def _result_changes(s, d):
    """Results of a first run, and of a later one that changes some of them."""
    r = _rows(s, d)
    base = r.select(
        "experiment_id",
        "combo_id",
        "score",
        (F.col("row_id") % 10 / 10).alias("subject_score"),
        F.concat_ws("#", "created_at", F.lpad(F.col("row_id").cast("string"), 12, "0")).alias("updated_at"),
    ).where("score is not null")
    return base.where("subject_score < 0.5"), base.where("subject_score >= 0.5")


def _results(s, d):
    return evaluation.upsert_results(*_result_changes(s, d))


def _stored_results(s, d):
    """The results stored by experiment, changed twice by the same later run, and read back."""
    path, (first, later) = folder(s), _result_changes(s, d)
    for changes in (first, later, later):
        io.upsert_partitions(path, changes, "experiment_id", evaluation.merge_results)
    return s.read.parquet(path)


def _compared(s, d):
    return compare.baseline_vs_challenger(compare.records(artifacts(s, d)), "combo_3")


def _fields(s, d):
    pairs = compare.paired(compare.records(artifacts(s, d)), "combo_3").withColumn("challenger_combo_id", F.col("right.combo_id"))
    return compare.field_comparisons(pairs, keep=("case_id", "challenger_combo_id"))


def _artifacts(s, d):
    return evaluation.normalized_artifacts(full_answers(s, d), "exp_1")


def _stored_pairs(s, d):
    """Pairs written under their parameters next to others, some of them twice, and read back."""
    path = folder(s)
    for threshold in (0.3, 0.5, 0.3):
        similarity.write_bundle(similarity.pairs(_vectors(s, d), threshold=threshold), path, backend="given", threshold=str(threshold))
    return similarity.read_bundle(s, path, backend="given", threshold="0.3")


# Digits, a letter that has a superscript only, signs and brackets, blanks inside and around, and nothing.
def _scripts():
    return {
        "digits": F.col("p_size").cast("string"),
        "power": F.concat(F.col("p_size").cast("string"), F.lit("n")),
        "signs": F.concat(F.lit(" (n+"), F.col("p_size").cast("string"), F.lit(") -\t1 ")),
        "mixed": F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, " \n").otherwise(F.concat(F.lit(" x"), F.col("p_size").cast("string"))),
    }


QUERIES = {
    "f1_review_text": lambda s, d: _docs(s, d).select("doc_id", F.md5(text.review_text("text")).alias("h")),
    "f2_text_blocks": lambda s, d: _docs(s, d).select("doc_id", text.text_block("text").alias("b")).select(
        "doc_id", "b.char_count", "b.word_count", "b.line_count", "b.paragraph_count", F.md5("b.inline_normalized").alias("h")
    ),
    "f3_comparison_text": lambda s, d: _rows(s, d).select("row_id", "comparison_text"),
    "f3_comparison_hash": lambda s, d: _rows(s, d).select("row_id", "comparison_hash"),
    "f4_sentences": lambda s, d: _docs(s, d).select(
        "doc_id",
        F.size(text.sentences("text")).alias("n_sentences"),
        F.md5(F.array_join(text.sentences("text"), "|")).alias("sentences"),
        F.md5(F.array_join(text.embedding_tokens("text"), "|")).alias("tokens"),
    ),
    "f2_list_blocks": lambda s, d: _docs(s, d).select("doc_id", F.explode(text.list_block(F.split("text", "\n", -1))).alias("x")).select(
        "doc_id", "x.index", "x.block.char_count", "x.block.word_count", "x.block.paragraph_count", F.md5("x.block.normalized").alias("h")
    ),
    "f5_prompt_stats": lambda s, d: _docs(s, d).select("doc_id", text.prompt_stats("text").alias("p")).select(
        "doc_id",
        "p.char_count",
        "p.line_count",
        "p.word_count",
        "p.sentence_count",
        "p.avg_word_length",
        "p.avg_sentence_words",
        "p.placeholder_count",
        "p.brace_count",
    ),
    "f6_chunk_text": lambda s, d: _docs(s, d).select(
        "doc_id", F.sha2(text.chunk_text("text"), 256).alias("h"), F.md5(text.slug("text")).alias("slug")
    ),
    "f7_scripts": lambda s, d: table(s, d, "part").withColumns(_scripts()).select(
        "p_partkey",
        *[text.unicode_script(c, up).alias(f"{c}_{'sup' if up else 'sub'}") for c in _scripts() for up in (True, False)],
        text.unicode_script("p_type", True).alias("word"),
    ),
    "f9_preview": lambda s, d: _docs(s, d).select("doc_id", text.inline_preview("text").alias("preview")),
    "f10_keywords": lambda s, d: table(s, d, "part").select(
        "p_partkey",
        F.array_join(
            text.distinct_keywords(F.concat(F.split("p_name", " "), F.array(F.upper("p_type"), F.lower("p_type"), F.lit(" ")))), ","
        ).alias("keywords"),
    ),
    "f12_forbidden": lambda s, d: _scored(s, d).select(
        "run_id",
        F.exists("checks", lambda c: (c["name"] == "forbidden_phrases") & c["passed"]).alias("clean"),
        F.array_join("found_phrases", "|").alias("found"),
    ),
    "f13_content_key": lambda s, d: table(s, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        text.content_key(
            F.create_map(F.lit("user"), F.col("l_suppkey").cast("string"), F.lit("system"), F.col("l_partkey").cast("string"))
        ).alias("k"),
    ),
    "f16_field_values": lambda s, d: artifacts(s, d).select(
        F.col("id").alias("row_id"), *[compare.shown(compare.field_value(f), f).alias(f.replace(".", "_")) for f in compare.FIELDS]
    ),
    "f17_validate_answers": lambda s, d: evaluation.validate_answers(full_answers(s, d)).select(
        "run_id", F.array_join("broken_rules", ",").alias("broken_rules"), "valid"
    ),
    "j3_score_answers": lambda s, d: _scored(s, d).select("run_id", "case_id", "passed_count", "total_count", "score", "passed"),
    "a8_failed_checks": lambda s, d: evaluation.failed_checks(_scored(s, d)).select("run_id", "failed_checks"),
    "a8_summary": lambda s, d: evaluation.summarize(_scored(s, d)),
    "p2_artifact_tags": lambda s, d: evaluation.artifact_tags(
        _scored(s, d).withColumns({"validation_ok": F.col("answer").isNotNull(), "raw_output": F.col("answer.short_answer")})
    ).select("run_id", F.array_join("tags", ",").alias("tags"), "artifact_file"),
    "p2_answer_lengths": lambda s, d: _answers(s, d).select("run_id", text.text_block("answer.short_answer").alias("b")).select(
        "run_id", F.col("b.char_count").alias("short_answer_chars"), F.col("b.word_count").alias("short_answer_words")
    ),
    "p2_artifacts": lambda s, d: _artifacts(s, d).select(
        "id",
        F.array_join("tags", ",").alias("tags"),
        "source_count",
        "request_type",
        "experiment_kind",
        F.col("review_flags.parse_error").alias("parse_error"),
        F.col("review_flags.has_sources").alias("has_sources"),
        F.col("artifact_paths.raw").alias("raw"),
        F.col("artifact_paths.normalized").alias("normalized"),
    ),
    "p2_lengths": lambda s, d: _artifacts(s, d).select("id", "answer_lengths.*", F.md5("comparison_text").alias("h")),
    "j4_plan_missing": lambda s, d: _plan(s, d, "missing"),
    "j4_plan_failed": lambda s, d: _plan(s, d, "failed").select("combo_id", "case_id", "should_run"),
    "j5_coverage": lambda s, d: evaluation.coverage(_plan(s, d, "all")).withColumn(
        "missing_case_ids", F.array_join("missing_case_ids", ",")
    ),
    "j6_report_rows": lambda s, d: evaluation.report_rows(
        _rows(s, d), _combos(s, d).where("combo_id < 'combo_2'"), _case_ids(s, d).where("case_id <> 'case_1'"), "sig_0"
    ).select(*KEY),
    "a15_results": lambda s, d: _results(s, d).select("experiment_id", "combo_id", "score", "status"),
    "a15_stored_results": lambda s, d: _stored_results(s, d).select("experiment_id", "combo_id", "score", "status"),
    "a15_experiments": lambda s, d: evaluation.experiment_scores(_results(s, d)),
    "j1_baseline": lambda s, d: _compared(s, d).select(
        "case_id",
        "challenger_combo_id",
        "baseline_score",
        "challenger_score",
        "score_delta",
        "pass_delta",
        "changed_field_count",
        F.array_join("changed_fields", ",").alias("changed_fields"),
        "meaningful_delta",
    ),
    "j1_text_similarity": lambda s, d: _compared(s, d).select("case_id", "challenger_combo_id", "full_text_similarity"),
    "j2_changed_fields": lambda s, d: _compared(s, d).select(
        F.explode("changed_fields").alias("field")
    ).groupBy("field").agg(F.count("*").alias("n")),
    "j2_fields": lambda s, d: _fields(s, d).select(
        "case_id",
        "challenger_combo_id",
        "field_path",
        "equal",
        "left_count",
        "right_count",
        F.md5("left_text").alias("l"),
        F.md5("right_text").alias("r"),
    ),
    "j2_field_similarity": lambda s, d: _fields(s, d).select(
        "case_id", "challenger_combo_id", "field_path", "left_text", "right_text", "similarity"
    ),
    "p11_meaningful": lambda s, d: compare.meaningful_only(_compared(s, d)).select("case_id", "challenger_combo_id"),
    "a6_challengers": lambda s, d: compare.challenger_summary(_compared(s, d)).drop("average_text_similarity"),
    "a6_text_similarity": lambda s, d: compare.challenger_summary(_compared(s, d)).select("challenger_combo_id", "average_text_similarity"),
    "w2_ranking_with_baseline": lambda s, d: review.combo_ranking(
        review.latest(_rows(s, d)), {"speed_score": 0.0}, compare.challenger_summary(_compared(s, d))
    ).select("rank", "combo_id", "ranking_score", "average_score_delta_vs_baseline", "meaningful_case_rate_vs_baseline"),
    "e9_text_ratio": lambda s, d: _compared(s, d).select(
        "case_id",
        "challenger_combo_id",
        F.round(compare.text_similarity(F.col("baseline_text"), F.col("challenger_text")), 4).alias("ratio"),
    ),
    "e10_unified_diff": lambda s, d: _compared(s, d).select(
        "case_id", "challenger_combo_id", compare.unified_diff(F.col("baseline_text"), F.col("challenger_text")).alias("diff")
    ),
    "e11_alignment": lambda s, d: _compared(s, d).select(
        "case_id",
        "challenger_combo_id",
        F.explode(compare.alignment(F.col("baseline_text"), F.col("challenger_text"), "sentence")).alias("op"),
    ).select("case_id", "challenger_combo_id", "op.*"),
    "e1_embedding_cells": lambda s, d: similarity.token_hash_cells(_items(s, d)),
    "e1_embed_items": lambda s, d: similarity.embed(_items(s, d)).select(
        "item_id",
        "group_id",
        "text_hash",
        "text_length",
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"),
    ),
    "e2_cosine": lambda s, d: _vectors(s, d).join(
        _vectors(s, d).select((F.col("item_id") - 1).alias("item_id"), F.col("vector").alias("other")), "item_id"
    ).select("item_id", similarity.cosine("vector", "other").alias("similarity")),
    "e3_pairs": lambda s, d: similarity.pairs(_vectors(s, d), threshold=0.3),
    "e3_pairs_of_all": lambda s, d: similarity.pairs(_vectors(s, d), same_group=False, threshold=0.5, tile=128),
    "e4_matrix": lambda s, d: similarity.similarity_matrix(_vectors(s, d), similarity.pairs(_vectors(s, d))),
    "e5_clusters": lambda s, d: similarity.clusters(
        similarity.pairs(_vectors(s, d), threshold=0.4), _vectors(s, d), 0.4
    ).withColumn("member_item_ids", F.array_join("member_item_ids", ",")),
    "e5_cluster_members": lambda s, d: similarity.cluster_members(similarity.pairs(_vectors(s, d), threshold=0.4), 0.4),
    "e6_outliers": lambda s, d: similarity.outliers(_vectors(s, d)),
    "e6_outlier_means": lambda s, d: similarity.outlier_means(_vectors(s, d)),
    "e7_nearest": lambda s, d: similarity.nearest(_vectors(s, d), _vectors(s, d).where("item_id % 20 = 0")),
    "e7_nearest_of_all": lambda s, d: similarity.nearest(_vectors(s, d), _vectors(s, d), send_bytes=0),
    "s7_stored_pairs": _stored_pairs,
    "e8_bundle_counts": lambda s, d: similarity.bundle(_vectors(s, d), threshold=0.4)["counts"],
}

_T = r"coalesce(text, '')"
_REVIEW = (
    rf"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({_T}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[ \t]+(\n|$)', "
    rf"'\1', 'g'), chr(32) || chr(10) || chr(9) || chr(11) || chr(12)), '\n{{3,}}', chr(10) || chr(10), 'g')"
)
_WORD = r"[A-Za-zА-Яа-яЁёЇїІіЄєҐґ0-9]+(?:[-''][A-Za-zА-Яа-яЁёЇїІіЄєҐґ0-9]+)?"
_N = f"n as (select doc_id, {_REVIEW} as t from documents)"
_COMPARE = r"""case when parse_error then 'RAW_OUTPUT' || chr(10) || 'broken output ' || k else 'SHORT_ANSWER' || chr(10) || 'Answer ' || request_type || ' ' || k || chr(10) || chr(10) || 'EXPLANATION' || chr(10) || 'It depends on ' || request_type || '.' || chr(10) || chr(10) || 'Value: ' || value || '.'
    || case when k % 3 = 0 then '' when k % 3 = 1 then chr(10) || chr(10) || 'EXAMPLES' || chr(10) || 'Example 1' else chr(10) || chr(10) || 'EXAMPLES' || chr(10) || 'Example 1' || chr(10) || 'Example 2' end
    || case when experiment_kind = 'clarification' then chr(10) || chr(10) || 'EXPERIMENT_REASON' || chr(10) || 'Needs detail' || chr(10) || chr(10) || 'EXPERIMENT_QUESTIONS' || chr(10) || 'Which one?' else '' end end"""
_EVENT = "wide as (select r.*, e.k, e.value from review r join ev e on e.event_id = r.row_id)"
_ANSWERS = r"""with ph as (select 'turn_' || (item_id % 4) as case_id, list(distinct trim(p)) as phrases from (select item_id, unnest(string_split_regex(text, '[.,;:!?\n]+')) as p from benchmark) where contains(trim(p), ' ') group by 1),
a as (select conv_id || '-' || turn as run_id, 'turn_' || (turn % 4) as case_id, 'combo_' || (conv_id % 7) as combo_id, conv_id % 11 = 0 as lost, turn % 4 as t, conv_id % 3 as e, text from conversations where role = 'assistant'),
j as (select a.*, lower(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n')) as blob, phrases from a left join ph using (case_id)),
f as (select *, case when lost then [] else list_sort(list_filter(coalesce(phrases, []), lambda p: contains(blob, lower(p)))) end as found from j),
c as (select *, not lost as parse_ok, not lost as type_ok, case when t = 3 then not lost and e in (0, 2) end as kind_ok, case when phrases is not null then not lost and len(found) = 0 end as clean,
    case when t = 1 then lost or not regexp_matches(blob, '(?i)(\b\d+(?:[\.,]\d+)?\s*%\b|\b\d+(?:[\.,]\d+)?\s*(?:m|mol\s*/\s*l|mol/l|моль\s*/\s*л)\b)') end as conc_ok from f),
s as (select *, parse_ok::int + type_ok::int + coalesce(kind_ok, false)::int + coalesce(clean, false)::int + coalesce(conc_ok, false)::int as n, 2 + (t = 3)::int + (phrases is not null)::int + (t = 1)::int as total from c)"""
_PLAN = """, have as (select * from review where execution_signature = 'sig_1' and not (case_id = 'case_3' and combo_id in ('combo_1', 'combo_5')) qualify row_number() over (partition by case_id, combo_id order by created_at desc, row_id desc) = 1),
plan as (select a.combo_id, b.case_id, h.row_id as existing_id, h.passed as existing_passed from (select distinct combo_id from review) a cross join (select distinct case_id from review) b left join have h using (combo_id, case_id))"""
_RESULTS = (
    ", res as (select *, row_id % 10 / 10 as subject_score from review where score is not null qualify row_number() over (partition by "
    "experiment_id, combo_id order by created_at desc, row_id desc) = 1)"
)
_SHORT, _EXPL, _EXAM, _CLAR = (
    "case when {0}.parse_error then '' else 'Answer ' || {0}.request_type || ' ' || {0}.k end",
    (
        "case when {0}.parse_error then '' else 'It depends on ' || {0}.request_type || '.' || chr(10) || chr(10) || 'Value: ' || "
        "{0}.value || '.' end"
    ),
    "case when {0}.parse_error or {0}.k % 3 = 0 then '' when {0}.k % 3 = 1 then 'Example 1' else 'Example 1' || chr(10) || 'Example 2' end",
    "coalesce({0}.experiment_kind, '') = 'clarification'",
)
_SOURCES = "array_to_string(list_transform(range(1, {0}.source_count + 1), lambda x: 'S' || x), chr(10))"
_VALUES = {
    "request_type": "{0}.request_type",
    "certainty": "coalesce({0}.certainty, '')",
    "short_answer": _SHORT,
    "explanation": _EXPL,
    "examples": _EXAM,
    "experiment.kind": "coalesce({0}.experiment_kind, '')",
    "experiment.reason": f"case when {_CLAR} then 'Needs detail' else '' end",
    "experiment.questions": f"case when {_CLAR} then 'Which one?' else '' end",
    "source_ids": _SOURCES,
}
_COUNTS = {
    "examples": "case when {0}.parse_error then 0 else {0}.k % 3 end",
    "experiment.questions": f"({_CLAR})::int",
    "source_ids": "{0}.source_count",
}
_PAIRED = f""", {_EVENT}, latest as (select *, {_COMPARE} as ctext from wide where case_id is not null qualify row_number() over (partition by case_id, combo_id order by created_at desc, row_id desc) = 1),
sides as (select l, r from latest r join latest l on l.case_id = r.case_id and l.combo_id = 'combo_3' and r.combo_id <> 'combo_3')"""
_CHANGED = ", ".join(f"case when {v.format('l')} is distinct from {v.format('r')} then '{k}' end" for k, v in _VALUES.items())
_J1 = f"""{_PAIRED}, j as (select r.case_id, r.combo_id as challenger_combo_id, l.score as baseline_score, r.score as challenger_score, round(r.score - l.score, 4) as score_delta, r.passed::int - l.passed::int as pass_delta, l.parse_error <> r.parse_error as perr,
    list_filter([{_CHANGED}], lambda x: x is not null) as changed, l.ctext <> r.ctext as cdiff from sides),
m as (select *, len(changed) > 0 or coalesce(abs(score_delta) >= 0.05, false) or coalesce(pass_delta <> 0, false) or perr or cdiff as meaningful from j)"""
_A6 = f"""{_J1}, a6 as (select challenger_combo_id, count(*) as compared_case_count, count(*) filter (meaningful) as meaningful_case_count, round(count(*) filter (meaningful) / count(*), 4) as meaningful_case_rate, count(*) filter (coalesce(score_delta, 0) > 0) as improved_score_case_count,
    count(*) filter (coalesce(score_delta, 0) < 0) as worsened_score_case_count, count(*) filter (coalesce(score_delta, 0) = 0) as same_score_case_count, count(*) filter (pass_delta = 1) as pass_gain_case_count, count(*) filter (pass_delta = -1) as pass_loss_case_count,
    round(avg(score_delta::decimal(18, 6))::decimal(18, 10), 4)::double as average_score_delta, round(avg(len(changed)::decimal(18, 6))::decimal(18, 10), 4)::double as average_changed_field_count, round(count(*) filter (len(changed) > 0) / count(*), 4) as changed_field_rate from m group by challenger_combo_id)"""
_RULES = [
    ("request_type", "i % 7 = 0"),
    ("short_answer", "i % 11 = 0"),
    ("explanation", "i % 13 = 0"),
    ("examples", "i % 4 > 2"),
    ("certainty", "i % 17 = 0"),
    ("source_ids", "i % 7 > 5"),
    ("experiment.kind", "i % 8 = 3"),
    ("experiment.questions", "i % 4 = 1 and i % 5 not in (1, 2, 3)"),
    ("experiment.reason", "i % 4 in (0, 1) and i % 5 = 0"),
    ("experiment.title", "plan and i % 19 = 0"),
    ("experiment.disposal", "plan and i % 23 = 0"),
    ("experiment.ingredients", "plan and i % 29 = 0"),
    ("experiment.steps", "plan and i % 37 = 0"),
    ("experiment.adult_supervision_required", "plan and i % 41 = 0"),
    ("experiment.ingredients.fields", "plan and i % 29 > 0 and i % 31 = 0"),
    ("experiment.ingredients.concentration", "plan and i % 29 > 0 and i % 2 = 0 and i % 6 = 2"),
]
_FULL = (
    "fa as (select event_id as i, i % 4 in (2, 3) and i % 8 <> 3 as plan, i % 43 = 0 as lost, 'combo_' || (user_id % 20) as combo_id, "
    "'case_' || (json_extract(props, '$.k')::int % 12) as case_id from events)"
)
_LEN = f"""{_FULL}, fl as (select *, case when lost or i % 11 = 0 then '' else 'Short ' || i end as sa, case when lost or i % 13 = 0 then '' else 'Because of this.' || chr(10) || chr(10) || 'And that.' end as ex, case when lost then 0 else i % 4 end as ne, case when lost or i % 5 = 0 then '' else 'why' end as re,
    case when lost then 0 else i % 5 end as nq, case when lost then 'broken ' || i else '' end as ro from fa),
fc as (select *, array_to_string(list_filter([case when sa <> '' then 'SHORT_ANSWER' || chr(10) || sa end, case when ex <> '' then 'EXPLANATION' || chr(10) || ex end, case when ne > 0 then 'EXAMPLES' || chr(10) || array_to_string(list_transform(range(1, ne + 1), lambda x: 'E' || x), chr(10)) end,
    case when re <> '' then 'EXPERIMENT_REASON' || chr(10) || re end, case when nq > 0 then 'EXPERIMENT_QUESTIONS' || chr(10) || array_to_string(list_transform(range(1, nq + 1), lambda x: 'Q' || x), chr(10)) end, case when ro <> '' then 'RAW_OUTPUT' || chr(10) || ro end], lambda x: x is not null), chr(10) || chr(10)) as ct from fl)"""
_DOT = "list_dot_product({a}.embedding::double[], {b}.embedding::double[])"
_PAIRS = (
    f"p as (select a.vec_id as l, b.vec_id as r, round({_DOT.format(a='a', b='b')}, 6) as s from embeddings a join embeddings b on a.label "
    f"= b.label and a.vec_id < b.vec_id)"
)
_PEERS = f"{_PAIRS}, m as (select l as i, r as o, s from p union all select r, l, s from p)"

_SCRIPT_SQL = {
    "digits": "p_size::varchar",
    "power": "p_size || 'n'",
    "signs": "' (n+' || p_size || ') -' || chr(9) || '1 '",
    "mixed": "case p_partkey % 3 when 0 then '' when 1 then ' ' || chr(10) else ' x' || p_size end",
}


def _script(value: str, up: bool) -> str:
    known, to, mark = ("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ", "^") if up else ("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", "_")
    other = f"regexp_matches({value}, '[^{known.replace('-', '')}\\s-]')"
    return f"case when {other} then '{mark}(' || ({value}) || ')' else translate({value}, '{known}', '{to}') end"


SQL = {
    "f1_review_text": f"with {_N} select doc_id, md5(t) as h from n",
    "f2_text_blocks": (
        rf"with {_N} select doc_id, length(t)::int as char_count, len(regexp_extract_all(t, '\S+'))::int as word_count, case when t = '' "
        rf"then 0 else len(string_split(t, chr(10))) end::int as line_count, len(list_filter(string_split_regex(t, '\n\s*\n'), lambda x: "
        rf"trim(x) <> ''))::int as paragraph_count, md5(regexp_replace(t, '\s+', ' ', 'g')) as h from n"
    ),
    "f3_comparison_text": _sql(f", {_EVENT} select row_id, {_COMPARE} as comparison_text from wide"),
    "f3_comparison_hash": _sql(f""", {_EVENT} select row_id, substr(sha256('"' || replace({_COMPARE}, chr(10), '\\n') || '"'), 1, 16) as comparison_hash from wide"""),
    "f4_sentences": rf"""with {_N}, c as (
        select doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)),
            lambda x: trim(x, chr(32) || chr(10) || chr(9))), lambda x: x <> '') as ss from n)
        select c.doc_id, len(ss)::int as n_sentences, md5(array_to_string(ss, '|')) as sentences,
            md5(array_to_string(regexp_extract_all(lower({_T}), '[a-z0-9_]+'), '|')) as tokens
        from c join documents using (doc_id)""",
    "f2_list_blocks": rf"""with documents as (
        select doc_id as d, unnest(l) as text, generate_subscripts(l, 1)::int as i
        from (select doc_id, string_split(text, chr(10)) as l from read_parquet_documents)),
        n as (select d, i, {_REVIEW} as t from documents)
        select d as doc_id, i as index, length(t)::int as char_count, len(regexp_extract_all(t, '\S+'))::int as word_count,
            (t <> '')::int as paragraph_count, md5(t) as h from n""".replace("read_parquet_documents", "main.documents"),
    "f5_prompt_stats": rf"""with t as (select doc_id, trim({_T}, chr(32) || chr(10) || chr(9)) as t from documents), w as (select *, regexp_extract_all(t, '{_WORD}') as ws, case when t = '' then 0 else len(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) end as ns from t)
        select doc_id, length(t)::int as char_count, case when t = '' then 0 else len(string_split(t, chr(10))) end::int as line_count, len(ws)::int as word_count, ns::int as sentence_count, coalesce(round(list_sum(list_transform(ws, lambda x: length(x))) / len(ws), 4), 0.0) as avg_word_length,
        case when ns > 0 then round(len(ws) / ns, 4) else 0.0 end as avg_sentence_words, len(list_distinct(regexp_extract_all(t, '\{{([a-zA-Z_][a-zA-Z0-9_]*)\}}', 1)))::int as placeholder_count, (length(t) - length(regexp_replace(t, '[{{}}]', '', 'g')))::int as brace_count from w""",
    "f6_chunk_text": rf"""select doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_T}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(32) || chr(10) || chr(9) || chr(160))) as h,
        md5(regexp_replace(regexp_replace(lower({_T}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug from documents""",
    "f7_scripts": "select p_partkey, "
    + ", ".join(f"{_script(v, up)} as {k}_{'sup' if up else 'sub'}" for k, v in _SCRIPT_SQL.items() for up in (True, False))
    + ", '^(' || p_type || ')' as word from part",
    "f9_preview": (
        rf"with t as (select doc_id, trim(regexp_replace({_T}, '\s+', ' ', 'g')) as t from documents) select doc_id, case when length(t) > "
        rf"180 then rtrim(substr(t, 1, 177)) || '...' else t end as preview from t"
    ),
    "f10_keywords": (
        "select p_partkey, array_to_string(list_filter(list_concat(list_distinct_ordered, [case when not "
        "list_contains(list_transform(list_distinct_ordered, lambda x: lower(x)), lower(p_type)) then upper(p_type) end]), lambda x: x is "
        "not null), ',') as keywords from (select *, case when split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) then "
        "[split_part(p_name, ' ', 1)] else string_split(p_name, ' ') end as list_distinct_ordered from part)"
    ),
    "f12_forbidden": f"{_ANSWERS} select run_id, coalesce(clean, false) as clean, array_to_string(found, '|') as found from s",
    "f13_content_key": """select l_orderkey, l_linenumber, substr(sha256('{"system":"' || l_partkey || '","user":"' || l_suppkey || '"}'), 1, 16) as k from lineitem""",
    "f16_field_values": _sql(f", {_EVENT} select row_id, " + ", ".join(f"{v.format('wide')} as {k.replace('.', '_')}" for k, v in _VALUES.items()) + " from wide"),
    "f17_validate_answers": (
        f"with {_FULL}, b as (select i, case when lost then 'missing' else "
        f"array_to_string(list_filter([{', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for n, c in _RULES)}], lambda x: x is "
        f"not null), ',') end as b from fa) select i as run_id, b as broken_rules, b = '' as valid from b"
    ),
    "p2_artifacts": f"""with {_FULL} select i as id, 'rag,rag,' || case when lost then 'validation_failed,' else 'validation_ok,' end || case when i % 2 = 0 then 'case_passed' else 'case_failed' end || case when not lost then ',empty_output' else '' end || case when lost then ',parse_error' else '' end as tags,
        (case when lost then 0 else i % 7 end)::int as source_count, case when not lost then case when i % 7 = 0 then 'other' else ['theory', 'experiment', 'mixed'][i % 3 + 1] end end as request_type, case when not lost then case when i % 4 = 0 then 'none' when i % 4 = 1 then 'clarification' when i % 8 = 3 then 'other' else 'experiment' end end as experiment_kind,
        lost as parse_error, not lost and i % 7 > 0 as has_sources, 'runs/raw/exp_1/' || i || '__' || combo_id || '__' || case_id || '.json' as raw, 'runs/normalized/exp_1/' || i || '__' || combo_id || '__' || case_id || '.json' as normalized from fa""",
    "p2_lengths": f"""with {_LEN} select i as id, length(sa)::int as short_answer_chars, (case when sa = '' then 0 else 2 end)::int as short_answer_words, length(ex)::int as explanation_chars, (case when ex = '' then 0 else 5 end)::int as explanation_words, ne::int as example_count, length(re)::int as experiment_reason_chars,
        length(ro)::int as raw_output_chars, length(ct)::int as comparison_chars, ((sa <> '')::int + case when ex = '' then 0 else 2 end + (re <> '')::int)::int as paragraph_count_total, md5(ct) as h from fc""",
    "s7_stored_pairs": f"with {_PAIRS} select l as left_item_id, r as right_item_id, s as similarity from p where s >= 0.3",
    "j2_fields": _sql(_PAIRED + " " + " union all ".join(f"select r.case_id as case_id, r.combo_id as challenger_combo_id, '{k}' as field_path, {v.format('l')} is not distinct from {v.format('r')} as equal, {('(' + _COUNTS[k].format('l') + ')::int') if k in _COUNTS else 'null::int'} as left_count, {('(' + _COUNTS[k].format('r') + ')::int') if k in _COUNTS else 'null::int'} as right_count, md5({v.format('l')}) as l, md5({v.format('r')}) as r from sides" for k, v in _VALUES.items())),
    "a6_challengers": _sql(f"{_A6} select 'combo_3' as baseline_combo_id, a6.* from a6"),
    "w2_ranking_with_baseline": _sql(f"""{_A6}, ls as (select * from review qualify row_number() over (partition by case_id, combo_id order by created_at desc, row_id desc) = 1),
        c as (select combo_id, round(avg(score::decimal(18, 6))::decimal(18, 10), 4)::double as a, round(count(*) filter (passed) / count(*), 4) as p, 1.0::double - count(*) filter (parse_error) / count(*) as st, 1.0::double - count(*) filter (not validation_ok) / count(*) as va from ls group by combo_id),
        z as (select *, round(coalesce(a, 0) * 0.55::double + p * 0.25::double + st * 0.1::double + va * 0.05::double, 4) as ranking_score from c)
        select row_number() over (order by ranking_score desc, coalesce(a, 0) desc, combo_id)::int as rank, combo_id, ranking_score, average_score_delta as average_score_delta_vs_baseline, meaningful_case_rate as meaningful_case_rate_vs_baseline from z left join a6 on challenger_combo_id = combo_id"""),
    "j3_score_answers": (
        f"{_ANSWERS} select run_id, case_id, n::int as passed_count, total as total_count, round(n / total, 4) as score, n = total as "
        f"passed from s"
    ),
    "a8_failed_checks": (
        f"{_ANSWERS} select run_id, array_to_string(list_filter([case when not parse_ok then 'parse_ok' end, case when not type_ok then "
        f"'request_type' end, case when not kind_ok then 'experiment_kind' end, case when not clean then 'forbidden_phrases' end, case "
        f"when not conc_ok then 'no_invented_concentration' end], lambda x: x is not null), ', ') as failed_checks from s"
    ),
    "a8_summary": (
        f"{_ANSWERS} select round(avg(round(n / total, 4)::decimal(18, 6))::decimal(18, 10), 4)::double as average_score, round(count(*) "
        f"filter (n = total) / count(*), 4) as pass_rate, count(*) as case_count from s"
    ),
    "p2_artifact_tags": (
        f"{_ANSWERS} select run_id, 'rag,rag,' || case when lost then 'validation_failed,' else 'validation_ok,' end || case when n = "
        f"total then 'case_passed' else 'case_failed' end || case when lost or text = '' then ',empty_output' else '' end || case when "
        f"lost then ',parse_error' else '' end as tags, run_id || '__' || combo_id || '__' || case_id || '.json' as artifact_file from s"
    ),
    "p2_answer_lengths": (
        rf"with documents as (select conv_id || '-' || turn as doc_id, case when conv_id % 11 > 0 then text end as text from conversations "
        rf"where role = 'assistant'), {_N} select doc_id as run_id, length(t)::int as short_answer_chars, len(regexp_extract_all(t, "
        rf"'\S+'))::int as short_answer_words from n"
    ),
    "j4_plan_missing": _sql(f"{_PLAN} select *, existing_id is null as should_run from plan"),
    "j4_plan_failed": _sql(f"{_PLAN} select combo_id, case_id, existing_id is not null and not existing_passed as should_run from plan"),
    "j5_coverage": _sql(
        f"{_PLAN} select combo_id, count(existing_id) as case_count, array_to_string(list_sort(coalesce(list(case_id) filter (existing_id "
        f"is null), [])), ',') as missing_case_ids, count(*) filter (existing_id is null) = 0 as complete from plan group by combo_id"
    ),
    "j6_report_rows": _sql(f"select {_K} from review where combo_id < 'combo_2' and case_id <> 'case_1' and execution_signature = 'sig_0'"),
    **dict.fromkeys(
        ("a15_results", "a15_stored_results"),
        _sql(f"{_RESULTS} select experiment_id, combo_id, score, case when score >= 0.8 then 'stable' else 'needs_work' end as status from res"),
    ),
    "a15_experiments": _sql(
        f"{_RESULTS} select experiment_id, count(*) as tested_combo_count, round(avg(score::decimal(18, 6))::decimal(18, 10), 4)::double "
        f"as average_score, max(score) as best_score, min(score) as worst_score, round(avg(subject_score::decimal(18, 6))::decimal(18, "
        f"10), 4)::double as average_subject_score, count(subject_score) as subject_score_count from res group by experiment_id"
    ),
    "j1_baseline": _sql(
        f"{_J1} select case_id, challenger_combo_id, baseline_score, challenger_score, score_delta, pass_delta, len(changed)::int as "
        f"changed_field_count, array_to_string(changed, ',') as changed_fields, meaningful as meaningful_delta from m"
    ),
    "j2_changed_fields": _sql(f"{_J1} select field, count(*) as n from (select unnest(changed) as field from j) group by field"),
    "p11_meaningful": _sql(f"{_J1} select case_id, challenger_combo_id from m where meaningful"),
    "e1_embedding_cells": """with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') as ts from documents), f as (select doc_id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || '__' || ts[i + 1]))) as f from t),
        g as (select doc_id, f, count(*) as n from f group by all), h as (select doc_id, n, sha256(f) as h from g), c as (select doc_id, (('0x' || substr(h, 1, 8))::bigint % 256)::int as slot, sum(case when ('0x' || substr(h, 9, 2))::int % 2 = 0 then n else -n end)::double as v from h group by all)
        select doc_id as item_id, slot, round(v / sqrt(sum(v * v) over (partition by doc_id)), 8) as value from c qualify v <> 0""",
    "e1_embed_items": (
        "select doc_id as item_id, source as group_id, substr(sha256(coalesce(text, '')), 1, 16) as text_hash, length(coalesce(text, "
        "''))::int as text_length, case when regexp_matches(coalesce(text, ''), '[A-Za-z0-9_]') then 1.0 else 0.0 end as norm from "
        "documents"
    ),
    "e2_cosine": (
        f"select a.vec_id as item_id, round({_DOT.format(a='a', b='b')}, 6) as similarity from embeddings a join embeddings b on b.vec_id "
        f"= a.vec_id + 1"
    ),
    "e3_pairs_of_all": (
        f"select * from (select a.vec_id as left_item_id, b.vec_id as right_item_id, round({_DOT.format(a='a', b='b')}, 6) as similarity "
        f"from embeddings a join embeddings b on a.vec_id < b.vec_id) where similarity >= 0.5"
    ),
    "e7_nearest_of_all": (
        f"with d as (select a.vec_id as selected_id, b.vec_id as item_id, round({_DOT.format(a='a', b='b')}, 6) as similarity from "
        f"embeddings a join embeddings b on a.vec_id <> b.vec_id) select *, row_number() over (partition by "
        f"selected_id order by similarity desc, item_id)::int as rank from d qualify rank <= 10"
    ),
    "e3_pairs": f"with {_PAIRS} select l as left_item_id, r as right_item_id, s as similarity from p where s >= 0.3",
    "e4_matrix": f"with {_PEERS} select i as item_id, o as peer_id, s as similarity from m union all select vec_id, vec_id, 1.0 from embeddings",
    "e5_clusters": f"""with recursive {_PEERS}, k as (select i, o from m where s >= 0.4), reach as (select i, o from k union select reach.i, k.o from reach join k on reach.o = k.i), lab as (select i, least(i, min(o)) as label from reach group by i),
        st as (select label, min(s) as min_similarity, max(s) as max_similarity, round(avg(s::decimal(18, 6))::decimal(18, 10), 4)::double as average_similarity from p join lab on lab.i = p.l where s >= 0.4 group by label)
        select lab.label as cluster_id, array_to_string(list_sort(list(i)), ',') as member_item_ids, count(*) as member_count, any_value(min_similarity) as min_similarity, any_value(max_similarity) as max_similarity, any_value(average_similarity) as average_similarity, any_value(e.label) as group_id
        from lab join st using (label) join embeddings e on e.vec_id = lab.label group by lab.label""",
    "e5_cluster_members": (
        f"with recursive {_PEERS}, k as (select i, o from m where s >= 0.4), reach as (select i, o from k union select reach.i, k.o "
        f"from reach join k on reach.o = k.i) select least(i, min(o)) as cluster_id, i as item_id from reach group by i"
    ),
    "e6_outliers": (
        f"with {_PEERS}, q as (select i, count(*) as n, round(avg(s::decimal(18, 6))::decimal(18, 10), 4)::double as mean, max(s) as "
        f"nearest from m group by i) select vec_id as item_id, label as group_id, coalesce(n, 0) as peer_count, mean as mean_similarity, "
        f"nearest as nearest_similarity, round(1.0::double - mean, 4) as outlier_score from embeddings left join q on q.i = vec_id"
    ),
    "e6_outlier_means": (
        f"with d as (select a.vec_id as i, avg({_DOT.format(a='a', b='b')}) as m from embeddings a join embeddings b on a.label = b.label "
        f"and a.vec_id <> b.vec_id group by a.vec_id) select vec_id as item_id, label as group_id, round(m, 4) as mean_similarity from "
        f"embeddings left join d on i = vec_id"
    ),
    "e7_nearest": (
        f"with d as (select a.vec_id as selected_id, b.vec_id as item_id, round({_DOT.format(a='a', b='b')}, 6) as similarity from "
        f"embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select *, row_number() over (partition by "
        f"selected_id order by similarity desc, item_id)::int as rank from d qualify rank <= 10"
    ),
    "e8_bundle_counts": f"with {_PAIRS} select (select count(*) from embeddings) as item_count, (select count(*) from p) as pair_count",
}

"""Queries of chunking and retrieval, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunking, retrieval, units
from tessera.sources.adapters import blocks, table


def _units(s, d):
    return units.units(blocks(s, d))


def _sections(s, d):
    """Sections of document lines, and of conversations."""
    number = F.regexp_extract("source", r"(\d+)", 1)
    docs = table(s, d, "documents").select(
        F.col("doc_id").alias("section_id"),
        number.cast("int").alias("chapter_number"),
        F.col("source").alias("chapter_title"),
        F.concat_ws(".", number, F.col("doc_id").cast("string")).alias("section_number"),
        F.col("lang").alias("language"),
    )
    c = table(s, d, "conversations").select("conv_id").distinct().select(
        (-1 - F.col("conv_id")).alias("section_id"),
        (F.col("conv_id") % 20).cast("int").alias("chapter_number"),
        F.lit("talk").alias("chapter_title"),
        F.concat(F.lit("c."), F.col("conv_id").cast("string")).alias("section_number"),
        F.lit("xx").alias("language"),
    )
    return docs.union(c).select(
        "*",
        F.lit("book").alias("source_id"),
        F.lit("Book").alias("book_title"),
        F.concat(F.lit("Title "), F.col("section_id").cast("string")).alias("section_title"),
    )


def _chunks(s, d):
    return chunking.chunks(chunking.merge_units(_units(s, d)), _sections(s, d))


def _items(s, d):
    c = table(s, d, "conversations")
    return c.select(
        F.col("conv_id").alias("section_id"),
        F.lit(0).alias("block_index"),
        F.when(F.col("role") == "user", "question").otherwise("answer").alias("role"),
        F.floor(F.col("turn") / 2).alias("item_index"),
        F.col("turn").alias("position"),
        "text",
    )


def _index(s, d):
    v = F.col("vec_id")
    return table(s, d, "embeddings").select(
        v.alias("chunk_id"),
        F.col("embedding").alias("vector"),
        (v % 9 > 0).alias("default_retrieval"),
        (v % 5).alias("chapter_number"),
        F.col("label").cast("string").alias("section"),
        F.when(v % 2 == 0, "theory").otherwise("table").alias("chunk_kind"),
    )


def _indexed(s, d, content):
    """Source chunks (document texts) and what an index of them holds: the vector of the same number, the content as it was then."""
    source = table(s, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 9 > 0).alias("default_retrieval")
    )
    index = source.join(_index(s, d).select("chunk_id", "vector"), "chunk_id", "left")
    return source, index.select("chunk_id", content.alias("text"), "vector")


def _supplier_metadata(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(
        k,
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
        F.when(k % 2 == 1, "yes").alias("odd"),
        F.array(F.lit("a"), k.cast("string")).alias("tags"),
        F.create_map(F.lit("k"), F.lit("v")).alias("more"),
    )


def _queries(s, d):
    return table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _tests(s, d):
    """Search items as test queries; the topics that a hit should mention are their capitalized words."""
    topics = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))))
    return table(s, d, "benchmark").where("item_id % 20 = 0").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), topics.alias("expected_topics")
    )


def _hits(s, d, k=12):
    """Candidates with their texts: a chunk's text is that of the document of its number, if there is one."""
    near = retrieval.knn(_queries(s, d), retrieval.metadata_filter(_index(s, d)), k)
    docs = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = near.withColumn("indexed_text", F.concat(F.lit("indexed "), F.col("chunk_id").cast("string")))
    v, label = F.col("chunk_id"), F.col("section")
    # The key of a hit's section: its parent section, its section, or its chapter and section numbers.
    meta = _index(s, d).select(
        "chunk_id",
        F.when(v % 3 == 0, label).alias("parent_section_id"),
        F.when(v % 3 == 1, F.concat(F.lit("s"), label)).alias("section_id"),
        "chapter_number",
        "chunk_kind",
        F.lit("").alias("section_title"),
        label.alias("section_number"),
        F.lit("theory").alias("retrieval_group"),
    )
    return retrieval.source_text(hits, docs).join(meta, "chunk_id").withColumn("section", retrieval.section_key())


def _selected(s, d):
    return retrieval.diversify(_hits(s, d))


def _packed(s, d):
    return retrieval.pack_context(_selected(s, d).withColumn("header", retrieval.hit_header()))


UNIT_KEYS = ["section_id", "block_start", "block_type", "locator", "chunk_kind", "retrieval_group", "default_retrieval"]

QUERIES = {
    "w5_attributions": lambda s, d: units.attribution_mode(blocks(s, d)).select("section_id", "block_index", "in_attributions"),
    "w6_heading_groups": lambda s, d: chunking.heading_groups(blocks(s, d)).select("section_id", "block_index", "heading_group"),
    "c5_units": lambda s, d: _units(s, d).select(
        *UNIT_KEYS,
        "title",
        "part",
        "item_index",
        F.md5("text").alias("h"),
        F.md5("paired_text").alias("paired"),
        F.md5("instruction_text").alias("instruction"),
    ),
    "w7_merged_units": lambda s, d: chunking.merge_units(_units(s, d)).select(*UNIT_KEYS, "block_end", F.md5("text").alias("h")),
    "c6_split_documents": lambda s, d: table(s, d, "documents").select(
        "doc_id", F.posexplode(chunking.split_long(F.col("text"))).alias("piece", "text")
    ),
    "c7_chunks": lambda s, d: _chunks(s, d).select(
        "id", "parent_section_id", "chunk_kind", "piece_index", "piece_count", "content_sha256", "embedding_sha256"
    ),
    "f14_embedding_text": lambda s, d: _chunks(s, d).select("id", F.md5("embedding_text").alias("h")),
    "a9_chunk_report": lambda s, d: chunking.report(_chunks(s, d)),
    "a10_chunk_checks": lambda s, d: chunking.validate(_chunks(s, d), chunking.Config(least=95)),
    "w11_review_sample": lambda s, d: chunking.sample_per_kind(_chunks(s, d)).select("chunk_kind", "rank", "id"),
    "t5_corpus_order": lambda s, d: (lambda c: c.orderBy(*chunking.corpus_order(c)))(_chunks(s, d)).select(
        "id", "chapter_number", "section_number", "block_start"
    ),
    "f8_list_starts": lambda s, d: table(s, d, "events").select(
        "event_id",
        chunking.repair_list_start(
            F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('7"'), F.col("user_id").cast("string"))).when(
                F.col("event_id") % 4 == 1, F.concat(F.col("user_id").cast("string"), F.lit('""'))
            ).when(F.col("event_id") % 4 == 2, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
        ).alias("r"),
    ).select("event_id", "r.*"),
    "j19_paired_items": lambda s, d: chunking.pair_items(_items(s, d)).select(
        "section_id", "item_index", "position", F.md5("paired_text").alias("paired")
    ),
    "p8_metadata_filter": lambda s, d: retrieval.metadata_filter(_index(s, d), chapter_number=2, chunk_kind="theory").select("chunk_id"),
    "p9_index_errors": lambda s, d: retrieval.index_input(
        table(s, d, "documents").select(
            F.col("lang").alias("id"),
            "text",
            F.when(F.col("doc_id") % 50 > 0, F.col("source")).alias("embedding_text"),
            F.lit(None).cast("boolean").alias("default_retrieval"),
        )
    )[1],
    "p10_metadata": lambda s, d: (
        lambda t: t.select("s_suppkey", retrieval.flat_metadata(t, ["name", "nation", "odd", "tags", "more"]).alias("metadata"))
    )(_supplier_metadata(s, d)),
    "s9_manifest": lambda s, d: retrieval.manifest(*_indexed(s, d, F.col("text")), "chunk_id"),
    "s9_stale_manifest": lambda s, d: retrieval.manifest(
        *_indexed(s, d, F.when(F.col("chunk_id") % 40 == 7, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))), "chunk_id"
    ),
    "t3_knn": lambda s, d: retrieval.knn(_queries(s, d), retrieval.metadata_filter(_index(s, d)), 5),
    "t4_batch_review": lambda s, d: retrieval.batch_review(_tests(s, d), _hits(s, d, 5)).select(
        "query_id", "rank", "chunk_id", "score", F.array_join("expected_topics", ",").alias("expected"), F.array_join("found_topics", ",").alias("found"), F.md5("text").alias("h")
    ),
    "j20_source_text": lambda s, d: _hits(s, d).select("query_id", "chunk_id", F.md5("text").alias("h")),
    "w8_diversity": lambda s, d: _selected(s, d).select("query_id", "label", "chunk_id", "section"),
    "w9_context": lambda s, d: retrieval.contexts(_queries(s, d), _selected(s, d), _packed(s, d)).select(
        "query_id", F.md5("context").alias("h"), F.length("context").alias("n")
    ),
    "j21_citations": lambda s, d: retrieval.check_citations(
        _queries(s, d).select(
            "query_id",
            F.array(
                F.lit(" s1"), F.lit("S9"), F.lit("S1"), F.concat(F.lit("s"), (F.col("query_id") % 5).cast("string"))
            ).alias("source_ids"),
        ),
        _selected(s, d),
    ).select("query_id", F.array_join("valid_ids", ",").alias("valid"), F.array_join("invalid_ids", ",").alias("invalid")),
    "w10_history": lambda s, d: retrieval.trim_history(table(s, d, "conversations"), 3).select("conv_id", "turn", "role"),
}

_NORM = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), "
    r"'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(32) || chr(10) || chr(9) || chr(160))"
)
_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'part')"
_B = r"""lines as (select doc_id as section_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as i from (select doc_id, string_split(text, chr(10)) as l from documents)),
lb as (select section_id, i as block_index, case when i % 13 = 6 then 'heading' when i % 13 = 9 then 'feature' when i % 7 = 3 then 'formula_or_equation' when i % 7 = 5 then 'figure' when i % 11 = 4 then 'table' else 'paragraph' end as block_type,
    case when i % 13 = 6 then case when i % 2 = 0 then 'Media Attributions' else 'Heading' end else line end as text from lines),
conv as (select conv_id as n, arg_min(text, turn) as opening, coalesce(list(text order by turn) filter (role = 'user'), []) as q, coalesce(list(text order by turn) filter (role = 'assistant'), []) as a from conversations group by conv_id),
cb as (select -1 - n as section_id, 0 as block_index, case when n % 5 < 2 then 'worked_example' when n % 5 < 4 then 'exercise_set' else 'feature' end as block_type, opening as text from conv),
b as (select * from lb union all select * from cb),
m as (select *, coalesce(last_value(case when block_type in ('feature', 'worked_example', 'exercise_set') then false when block_type = 'heading' and lower(text) = 'media attributions' then true end ignore nulls) over (partition by section_id order by block_index rows unbounded preceding), false) as attr from b)"""
_U = rf"""{_B}, ord as (select section_id, block_index as block_start, 0::bigint as seq, block_type, 'block-' || block_index || '-' || block_type as locator, text, case when block_type = 'feature' then 'feature' when attr then 'attribution' when block_type = 'formula_or_equation' then 'equation_context'
    when block_type = 'figure' then 'figure_caption' when block_type = 'table' then 'table' else 'theory' end as chunk_kind, case when block_type = 'feature' then 'feature' when attr then 'attribution' when block_type = 'figure' then 'figure' when block_type = 'table' then 'reference_table' else 'theory' end as retrieval_group,
    block_type = 'feature' or not attr as default_retrieval, case when block_type = 'feature' and section_id < 0 and (-1 - section_id) % 7 > 0 then 'Example ' || (-1 - section_id) end as title, null::varchar as part, null::int as item_index, null::varchar as paired, null::varchar as instruction from m where block_type not in ('worked_example', 'exercise_set')),
ex as (select n, n % 5 < 2 as w, case when n % 7 > 0 then 'Example ' || n when n % 5 < 2 then 'Worked example' else 'Exercises' end as title, case when n % 3 > 0 then opening end as intro, q, a,
    case when n % 5 < 2 then 'example-' || {_SLUG.format("case when n % 7 > 0 then 'Example ' || n else 'Worked example' end")} else 'exercise-0' end as pre from conv where n % 5 < 4),
it as (select n, w, title, pre, intro, 'q' as r, unnest(q) as text, generate_subscripts(q, 1) as k from ex union all select n, w, title, pre, intro, 'a', unnest(a), generate_subscripts(a, 1) from ex),
num as (select n, string_agg((k + n % 3) || '. ' || replace({_NORM.format("text")}, chr(10), chr(10) || '   '), chr(10) || chr(10) order by k) filter ({_NORM.format("text")} <> '') as t from it where r = 'a' group by n),
sp as (
    select n, w, title, 0::bigint as seq, pre || case when w then '-problems-intro' else '-questions-intro' end as locator, intro as text, case when w then 'worked_example_problem_intro' else 'assessment_question_intro' end as chunk_kind, case when w then 'worked_example' else 'assessment_question' end as retrieval_group, w as dr, case when w then 'problems' else 'questions' end as part, null::int as item_index, null::varchar as paired, null::varchar as instruction from ex
    union all select n, w, title, k, pre || case when w then '-problem-' else '-question-' end || (k + n % 3), text, case when w then 'worked_example_problem' else 'assessment_question' end, case when w then 'worked_example' else 'assessment_question' end, w, case when w then 'problem' else 'question' end, (k + n % 3)::int, null, intro from it where r = 'q'
    union all select n, w, title, 1000 + k, pre || case when w then '-solution-' else '-answer-' end || (k + n % 3), text, case when w then 'worked_example_solution' else 'assessment_answer' end, case when w then 'worked_example' else 'assessment_answer' end, w, case when w then 'solution' else 'answer' end, (k + n % 3)::int, (select x.text from it x where x.n = it.n and x.r = 'q' and x.k = it.k), null from it where r = 'a'
    union all select ex.n, w, title, 3000, pre || case when w then '-self-test' else '-notes' end, concat_ws(chr(10) || chr(10), {_NORM.format("q[-1]")}, num.t), case when w then 'self_test_question' else 'assessment_part' end, case when w then 'self_test' else 'assessment_question' end, false, case when w then 'test_yourself' else 'notes' end, null, null, null from ex left join num using (n)
    union all select n, w, title, 4000, pre || case when w then '-self-test-answer' else '-answers-intro' end, case when w then 'See above.' else 'a figure' || chr(10) || chr(10) || 'See above.' end, case when w then 'self_test_answer' else 'assessment_answer_intro' end, case when w then 'self_test_answer' else 'assessment_answer' end, false, case when w then 'answer' else 'answers' end, null, null, null from ex),
u0 as (select * from ord union all select -1 - n, 0, seq, case when w then 'worked_example' else 'exercise_set' end, locator, text, chunk_kind, retrieval_group, dr, title, part, item_index, paired, instruction from sp),
u as (select * replace ({_NORM.format("text")} as text, nullif({_NORM.format("paired")}, '') as paired, nullif({_NORM.format("instruction")}, '') as instruction), row_number() over (partition by section_id order by block_start, seq) as r, chunk_kind in ('theory', 'equation_context') and retrieval_group = 'theory' as mg from u0 where {_NORM.format("text")} <> '')"""
_M = _U + """, f as (select section_id, r, 1 as g, length(text) as size, mg as open from u where r = 1
    union all select u.section_id, u.r, case when f.open and u.mg and f.size + 2 + length(u.text) <= 1800 then f.g else f.g + 1 end, case when f.open and u.mg and f.size + 2 + length(u.text) <= 1800 then f.size + 2 + length(u.text) else length(u.text) end, u.mg from f join u on u.section_id = f.section_id and u.r = f.r + 1),
mu as (select section_id, min(block_start) as block_start, max(block_start) as block_end, bool_or(mg) as mg, arg_min(locator, r) as l, arg_min(chunk_kind, r) as k, arg_min(retrieval_group, r) as rg, bool_and(default_retrieval) as dr, count(distinct block_type) as t, arg_min(block_type, r) as bt, arg_min(title, r) as title, arg_min(part, r) as part,
    arg_min(item_index, r) as item_index, arg_min(paired, r) as paired, arg_min(instruction, r) as instruction, string_agg(text, chr(10) || chr(10) order by r) as text from u join f using (section_id, r) group by section_id, g),
un as (select section_id, block_start, block_end, case when mg then 'blocks-' || block_start || '-' || block_end else l end as locator, case when mg then 'theory' else k end as chunk_kind, rg as retrieval_group, dr as default_retrieval, case when t > 1 then 'mixed' else bt end as block_type, title, part, item_index, paired, instruction, text from mu)"""
_D = (
    "round(greatest(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - "
    "p[2]::double))), 0), 6)"
)
_KNN = (
    f"near as (select q.vec_id as query_id, c.vec_id as chunk_id, {_D} as distance, case c.vec_id % 3 when 0 then c.label::varchar when 1 then 's' || c.label else (c.vec_id % 5) || ':' || c.label end as section, c.label::varchar as label_ from embeddings q join "
    f"embeddings c on c.vec_id % 9 > 0 where q.vec_id % 20 = 0), ranked as (select *, row_number() over (partition by query_id order by "
    f"distance, chunk_id)::int as rank from near)"
)
_HITS = (
    f"{_KNN}, hits as (select r.*, case when d.text is not null then trim(d.text, chr(32) || chr(10) || chr(9)) else 'indexed ' || "
    f"chunk_id end as text from ranked r left join documents d on d.doc_id = chunk_id where rank <= 12)"
)
_SEL = (
    f"{_HITS}, s1 as (select *, row_number() over (partition by query_id, section order by distance, chunk_id) as k from hits), sel as "
    f"(select *, row_number() over (partition by query_id order by distance, chunk_id) as pos from s1 where k <= 2 qualify pos <= 4)"
)

#: A null key or text hashes as a hyphen, others behind an equals sign.
_HASH = "coalesce(sum(('0x' || substr(md5(coalesce('=' || doc_id, '-') || chr(31) || coalesce('=' || {}, '-')), 1, 15))::bigint::hugeint), 0)::varchar"
_MANIFEST = (
    f"with i as (select doc_id, {{old}} as t, embedding from documents left join embeddings on vec_id = doc_id), a as (select count(*) as source_count, count(*) "
    f"filter (doc_id % 9 > 0) as default_count, {_HASH.format('text')} as source_hash from documents), b as (select count(*) as indexed_count, "
    f"count(embedding) as vector_count, max(len(embedding))::int as vector_dimension, {_HASH.format('t')} as indexed_hash from i) "
    "select *, source_count = indexed_count and vector_count = indexed_count as complete, source_hash = indexed_hash as current from a, b"
)

SQL = {
    "w5_attributions": f"with {_B} select section_id, block_index, attr as in_attributions from m",
    "w6_heading_groups": (
        f"with {_B} select section_id, block_index, sum((block_type = 'heading')::int) over (partition by section_id order by block_index "
        f"rows unbounded preceding)::bigint as heading_group from b"
    ),
    "c5_units": (
        f"with {_U} select section_id, block_start, block_type, locator, chunk_kind, retrieval_group, default_retrieval, title, part, "
        f"item_index, md5(text) as h, md5(paired) as paired, md5(instruction) as instruction from u"
    ),
    "w7_merged_units": (
        f"with recursive {_M} select section_id, block_start, block_type, locator, chunk_kind, retrieval_group, default_retrieval, "
        f"block_end, md5(text) as h from un"
    ),
    "f8_list_starts": (
        "select event_id, case event_id % 4 when 0 then 7 when 1 then user_id when 2 then 1 else user_id end::int as value, case event_id "
        "% 4 when 0 then 'extract_first_integer' when 1 then 'trim_surrounding_quotes' when 2 then 'fallback_to_one' end as method from "
        "events"
    ),
    "j19_paired_items": (
        "with q as (select conv_id, turn // 2 as n, arg_max(text, turn) as t, min(turn) as f from conversations where role = 'user' group "
        "by all), f as (select conv_id, min(turn) as first from conversations where role = 'user' group by conv_id) select c.conv_id as "
        "section_id, turn // 2 as item_index, turn as position, md5(case when turn > first then t end) as paired from conversations c left "
        "join q on q.conv_id = c.conv_id and q.n = turn // 2 left join f on f.conv_id = c.conv_id where role is distinct from 'user'"
    ),
    "p8_metadata_filter": "select vec_id as chunk_id from embeddings where vec_id % 9 > 0 and vec_id % 5 = 2 and vec_id % 2 = 0",
    "p9_index_errors": (
        "select lang as id, array_to_string(list_filter([case when trim(text) = '' then 'text' end, case when doc_id % 50 = 0 then "
        "'embedding_text' end], lambda x: x is not null), ',') as problem from documents where trim(text) = '' or doc_id % 50 = 0 union "
        "all select lang, 'duplicate' from documents group by lang having count(*) > 1"
    ),
    "p10_metadata": r"""select s_suppkey, '{"name":"' || s_name || '","nation":' || s_nationkey || case when s_suppkey % 2 = 1 then ',"odd":"yes"' else '' end || ',"tags":"[\"a\",\"' || s_suppkey || '\"]","more":"{\"k\":\"v\"}"}' as metadata from supplier""",
    "s9_manifest": _MANIFEST.format(old="text"),
    "s9_stale_manifest": _MANIFEST.format(old="case when doc_id % 40 = 7 then text || ' (old)' else text end"),
    "t3_knn": f"with {_KNN} select query_id, rank, chunk_id, distance from ranked where rank <= 5",
    "t4_batch_review": (
        f"with {_HITS}, t as (select item_id as query_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) as topics from benchmark where item_id % 20 = 0), "
        "r as (select t.query_id, rank, chunk_id, distance as score, topics, coalesce(text, '') as text from t left join hits on hits.query_id = t.query_id and rank <= 5) "
        "select query_id, rank, chunk_id, score, array_to_string(topics, ',') as expected, array_to_string(list_filter(topics, lambda x: contains(lower(text), lower(x))), ',') as found, "
        rf"md5(case when length(text) > 1200 then regexp_replace(substr(text, 1, 1200), '\s+\z', '') || chr(10) || '…' else text end) as h from r"
    ),
    "j20_source_text": f"with {_HITS} select query_id, chunk_id, md5(text) as h from hits",
    "w8_diversity": f"with {_SEL} select query_id, 'S' || pos as label, chunk_id, section from sel",
    "w9_context": rf"""with {_SEL}, h as (select *, '[S' || pos || ']' || chr(10) || 'chunk_id: ' || chunk_id || chr(10) || 'source: Chapter ' || (chunk_id % 5) || ' · Section ' || label_ || chr(10) || 'content_type: ' || case when chunk_id % 2 = 0 then 'theory' else 'table' end as header from sel),
        p as (select *, 6500 - coalesce(sum(length(header) + 7 + length(text) + 2) over (partition by query_id order by pos rows between unbounded preceding and 1 preceding), 0) - length(header) - 9 as rest from h),
        k as (select *, min((rest > 120)::int) over (partition by query_id order by pos) as ok from p),
        t as (select query_id, string_agg(header || chr(10) || 'text:' || chr(10) || case when length(text) > rest then rtrim(substr(text, 1, rest::bigint), chr(32) || chr(10) || chr(9)) || chr(10) || '[truncated]' else text end, chr(10) || chr(10) order by pos) as context from k where ok = 1 group by query_id)
        select query_id, md5(context) as h, length(context)::int as n from t""",
    "j21_citations": (
        f"with {_SEL}, k as (select query_id, list('S' || pos) as ks from sel group by query_id), c as (select query_id, ks, case query_id "
        f"% 5 when 1 then ['S1', 'S9'] else ['S1', 'S9', 'S' || (query_id % 5)] end as cs from k) select query_id, "
        f"array_to_string(list_filter(cs, lambda x: list_contains(ks, x)), ',') as valid, array_to_string(list_filter(cs, lambda x: not "
        f"list_contains(ks, x)), ',') as invalid from c"
    ),
    "w10_history": (
        "with t as (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn desc) as b "
        "from conversations), u as (select *, min(turn) filter (role = 'user') over (partition by conv_id) as f from t where b <= 3) "
        "select conv_id, turn, role from u where n <= 3 or turn >= f"
    ),
}

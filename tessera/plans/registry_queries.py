"""Queries of the registry reports and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import registry as r
from tessera.operators.evaluation import ANSWER
from tessera.sources.adapters import table
from tessera.sources.scratch import save


def _nodes(s, d):
    """Documents as prompt nodes: 20 trees, three children a node."""
    i = F.col("doc_id")
    n = F.floor(i / 20)
    return table(s, d, "documents").select(
        i.alias("id"),
        F.col("lang").alias("type"),
        F.col("source").alias("tree_id"),
        F.when(n > 0, F.floor((n - 1) / 3) * 20 + i % 20).alias("parent_id"),
        F.concat(F.lit("Node "), i.cast("string")).alias("title"),
        F.lit("main").alias("branch"),
        F.lpad((i * 7919 % 10007).cast("string"), 5, "0").alias("created_at"),
        (i % 31 == 0).alias("used_path_fallback"),
        F.when(i % 17 == 0, F.array(F.lit("archived"))).otherwise(F.array(F.lit("live"))).alias("tags"),
        (i % 23 == 0).alias("archived"),
        "text",
    )


def _pair(a="l_partkey", b="l_suppkey"):
    return F.concat_ws("-", F.col(a).cast("string"), b if not isinstance(b, str) else F.col(b).cast("string"))


def _combos(s, d):
    """Part and supplier pairs as combos of a system and a user prompt."""
    l = table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()  # noqa: E741
    p, u = F.col("l_partkey"), F.col("l_suppkey")
    return l.select(
        _pair().alias("id"),
        F.create_map(F.lit("system"), p, F.lit("user"), u).alias("prompt_ids"),
        F.concat(F.lit("Combo "), p.cast("string")).alias("title"),
        F.when(p % 13 == 0, "archived").otherwise("draft").alias("status"),
        F.array(F.lit("x")).alias("tags"),
        F.lit(None).cast("boolean").alias("archived"),
        F.when(u % 2 == 1, _pair(b=F.floor(u / 2).cast("string"))).alias("base_combo_id"),
    )


def _experiments(s, d):
    """Orders as experiments; their lines are the combos, the seventh is unknown, returned lines have results."""
    l = table(s, d, "lineitem").withColumn("c", F.when(F.col("l_linenumber") == 7, "missing").otherwise(_pair()))  # noqa: E741
    return l.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "c"))), lambda x: x["c"]).alias("combo_ids"),
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("l_returnflag") == "R",
                    F.struct(F.col("c").alias("combo_id"), F.round(F.col("l_discount") * 10, 4).alias("score")),
                )
            )
        ).alias("results"),
    ).withColumns({
        "status": F.when(F.col("id") % 10 == 0, "archived").otherwise("active"),
        "tags": F.array().cast("array<string>"),
        "archived": F.lit(False),
    })


def _runs(s, d):
    return table(s, d, "lineitem").where("l_quantity > 25").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), _pair().alias("combo_id"), F.col("l_orderkey").alias("experiment_id")
    )


_usage = lambda s, d: r.prompt_usage(_nodes(s, d), _combos(s, d), _experiments(s, d))
_combo_usage = lambda s, d: r.combo_usage(_combos(s, d), _nodes(s, d), _experiments(s, d), _runs(s, d))
_summary = lambda s, d: r.experiment_summary(_experiments(s, d), _combos(s, d), _runs(s, d))
def _details(s, d):
    """Combos and experiments are grouped from the lines once, and all three usages are made from them."""
    nodes, combos, experiments, runs = _nodes(s, d), save(_combos(s, d)), save(_experiments(s, d)), _runs(s, d)
    usage, prompts = r.combo_usage(combos, nodes, experiments, runs), r.prompt_usage(nodes, combos, experiments)
    return r.combo_details(usage, prompts, r.experiment_summary(experiments, combos, runs))


_join = lambda df, *cs: df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in cs})


def _pools(s, d):
    ids = table(s, d, "supplier").select(F.col("s_suppkey").alias("i"))
    return {"system": table(s, d, "nation").select(F.col("n_nationkey").cast("long")), "user": ids}


def _fewshot(s, d):
    """Sets of four examples: a good one, one without input, one without a question, one whose answer breaks rules; every fifth is no list."""
    i = F.col("item_id")
    kind = f"struct<id:string,input:map<string,string>,answer:{ANSWER}>"
    answer = lambda sure: F.struct(
        F.lit("theory").alias("request_type"),
        F.col("text").alias("short_answer"),
        F.lit("so").alias("explanation"),
        F.lit(sure).alias("certainty"),
        F.struct(F.lit("none").alias("kind"), F.lit("why").alias("reason")).alias("experiment"),
    )
    asked = lambda key: F.create_map(F.lit(key), F.col("text"))
    parts = [
        F.to_json(F.struct(asked("question").alias("input"), answer("high").alias("answer"))),
        F.to_json(F.struct(answer("high").alias("answer"))),
        F.to_json(
            F.struct(F.concat(F.lit("x"), i.cast("string")).alias("id"), asked("topic").alias("input"), answer("high").alias("answer"))
        ),
        F.to_json(F.struct(asked("question").alias("input"), answer("sure").alias("answer"))),
    ]
    ok = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return table(s, d, "benchmark").select(
        i.alias("set_id"), F.when(i % 5 == 0, F.col("text")).when(i % 5 == 1, " [] ").otherwise(ok).alias("text")
    )


def _variants(s, d):
    """Nodes with the metadata that titles and descriptions come from."""
    i = F.col("id")
    return _nodes(s, d).select(
        "id",
        "type",
        "parent_id",
        F.when(i % 4 > 0, F.concat(F.lit(" Node  "), i.cast("string"))).alias("title"),
        F.when(i % 5 == 0, "context_variant").alias("kind"),
        F.when(i % 7 == 0, F.concat(F.lit("Shown\n "), i.cast("string"))).alias("display_title"),
        F.when(i % 3 == 0, "system").alias("prompt_role"),
        F.when(i % 11 == 0, " some   text ").alias("description"),
    )


def _edges(s, d):
    return _nodes(s, d).where("parent_id is not null").select(
        F.col("parent_id").alias("from"), F.col("id").alias("to"), F.when(F.col("id") % 2 == 0, "child").otherwise("branch").alias("kind")
    )


def _snapshots(s, d):
    made = _combos(s, d).where("base_combo_id is not null")
    few = F.when(F.col("prompt_ids.system") % 3 == 0, F.col("prompt_ids.user"))
    return r.snapshot(
        made.select("base_combo_id", F.col("id").alias("active_combo_id"), few.alias("fewshot_id")), _combos(s, d), _nodes(s, d)
    )


def _rendered(s, d):
    base = F.concat(F.lit("Teach {language} {x} to {question}: "), "title")
    return _nodes(s, d).select(
        "id",
        r.render_prompt(
            base,
            "system",
            {"language": F.col("type"), "notes": F.lit("")},
            {"teaching_style": F.col("tree_id")},
            {"language": F.col("type")},
        ).alias("t"),
    )


QUERIES = {
    "p6_archived": lambda s, d: _nodes(s, d).select("id", r.archived().alias("is_archived")),
    "p7_listing": lambda s, d: r.listing(_nodes(s, d), type="de", tree_id="src3", parent_id=None).select("id"),
    "p7_edges": lambda s, d: r.listing(_edges(s, d), kind="child", **{"from": None}).select("from", "to"),
    "p7_combos": lambda s, d: r.listing(_combos(s, d), status="archived").select("id"),
    "p7_experiments": lambda s, d: r.listing(_experiments(s, d), status="active").select("id"),
    "p7_runs": lambda s, d: r.listing(_runs(s, d), combo_id=None, experiment_id=1).select("id", "combo_id"),
    "j18_tree": lambda s, d: r.tree_listing(_nodes(s, d)),
    "f11_titles": lambda s, d: _variants(s, d).select("id", r.display_title().alias("title"), r.description().alias("description")),
    "j18_lineage": lambda s, d: _join(r.lineage(_nodes(s, d)), "lineage_ids"),
    "j18_children": lambda s, d: _join(r.children(_nodes(s, d)), "child_prompt_ids"),
    "j8_prompt_usage": lambda s, d: _usage(s, d).select("id", "child_count", "combo_count", "experiment_count", "depth", "is_archived"),
    "j9_combo_usage": lambda s, d: _join(_combo_usage(s, d), "missing_prompt_ids", "experiment_ids", "derived_combo_ids").select(
        "combo_id",
        "missing_prompt_ids",
        "experiment_ids",
        F.size("result_experiment_ids").alias("n_results"),
        "derived_combo_ids",
        "run_count",
        "is_archived",
    ),
    "j10_experiment_summary": lambda s, d: _summary(s, d).select(
        "experiment_id", "combo_count", "tested_combo_count", "untested_combo_count", "missing_combo_count", "run_count", "is_archived"
    ),
    "j11_composition": lambda s, d: r.composition(_experiments(s, d), _combos(s, d)).select(
        "experiment_id", "position", "combo_id", "title", "result_score", "combo_missing"
    ),
    "j12_results_table": lambda s, d: r.results_table(
        _experiments(s, d), _combos(s, d), _nodes(s, d)
    ).groupBy("experiment_id", "combo_id", "score").agg(F.max("total_char_count").alias("total_char_count")),
    "a16_prompt_totals": lambda s, d: r.prompt_totals(_combos(s, d), _nodes(s, d)).select("combo_id", "total_char_count"),
    "j13_generate_combos": lambda s, d: r.generate_combos(_pools(s, d), _combos(s, d)).select(
        F.col("prompt_ids.system").alias("system"), F.col("prompt_ids.user").alias("user"), "combo_key"
    ),
    "j14_find_combo": lambda s, d: r.find_combo(
        _combos(s, d), _combos(s, d).select(F.col("id").alias("wanted"), "prompt_ids")
    ).select("wanted", "combo_id"),
    "j15_untested": lambda s, d: r.untested(_combos(s, d), _experiments(s, d)).select("id"),
    "j15_experiment_untested": lambda s, d: r.experiment_untested(_experiments(s, d)).select("experiment_id", "position", "combo_id"),
    "j16_combo_experiments": lambda s, d: _join(r.combo_experiments(_experiments(s, d)), "experiment_ids", "result_experiment_ids"),
    "j17_prompt_blockers": lambda s, d: _join(r.prompt_dependencies(_usage(s, d)), "blockers").select("id", "blockers", "safe_to_delete"),
    "j17_combo_blockers": lambda s, d: _join(
        r.combo_dependencies(_combo_usage(s, d)), "blockers"
    ).select("combo_id", "blockers", "safe_to_delete"),
    "j17_experiment_blockers": lambda s, d: _join(
        r.experiment_dependencies(_summary(s, d)), "blockers"
    ).select("experiment_id", "blockers", "safe_to_delete"),
    "j13_prompt_pool": lambda s, d: r.prompt_pool(_variants(s, d), "de", context_variants=False),
    "j17_link_blockers": lambda s, d: _join(
        r.link_dependencies(
            _runs(s, d).select("experiment_id", "combo_id").union(r.experiment_combos(_experiments(s, d)).select("experiment_id", "combo_id")).distinct(),
            _experiments(s, d),
            _runs(s, d),
            _runs(s, d).where("experiment_id % 3 = 0"),
        ),
        "blockers",
    ).select("experiment_id", "combo_id", "result_count", "run_count", "blockers", "safe_to_detach"),
    "j22_snapshots": lambda s, d: _join(_snapshots(s, d), "changed_roles").select(
        "base_combo_id",
        "active_combo_id",
        "changed_roles",
        F.array_join(
            F.transform(
                "roles",
                lambda x: F.concat_ws(":", x["role"], x["prompt_id"].cast("string"), x["node"]["title"], F.size("roles").cast("string")),
            ),
            "|",
        ).alias("roles"),
        F.col("fewshot.missing").alias("fewshot_missing"),
        F.col("fewshot.node.title").alias("fewshot_title"),
    ),
    "j23_prompt_details": lambda s, d: r.prompt_details(_usage(s, d)).select(
        "id",
        F.array_join(
            F.transform("child_rows", lambda x: F.concat_ws(":", x["id"].cast("string"), x["title"], x["type"])), "|"
        ).alias("children"),
        F.array_join(F.transform("combo_ids", lambda x: x), ",").alias("combos"),
        F.size("lineage_ids").alias("n_lineage"),
    ),
    "j23_combo_details": lambda s, d: _details(s, d).select(
        "combo_id",
        "part",
        "role",
        "key",
        F.get_json_object("summary", "$.is_archived").alias("is_archived"),
        F.get_json_object("summary", "$.run_count").cast("long").alias("run_count"),
        F.get_json_object("summary", "$.child_count").cast("long").alias("child_count"),
    ),
    "a13_workspace": lambda s, d: r.workspace_counts(_nodes(s, d), _combos(s, d), _experiments(s, d)),
    "a18_case_sets": lambda s, d: r.case_sets(
        table(s, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(
            F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).alias("c")
        ).select("id", F.when(F.col("id") % 3 > 0, F.col("c")).alias("cases"))
    ),
    "u2_all_experiments": lambda s, d: r.all_experiments(_experiments(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("id"))),
    "f15_render_prompt": _rendered,
    "f18_similarity_text": lambda s, d: _nodes(s, d).select(
        "id", F.md5(r.similarity_text("title")).alias("title_text"), F.md5(r.similarity_text("metadata")).alias("metadata_text")
    ),
    "f19_fewshot": lambda s, d: r.fewshot_examples(_fewshot(s, d)).select(
        "set_id", "example_id", "question", F.get_json_object("answer", "$.certainty").alias("certainty"), "problem"
    ),
}

_N = (
    "nodes as (select doc_id as id, lang as type, source as tree_id, case when doc_id // 20 > 0 then ((doc_id // 20 - 1) // 3) * 20 + "
    "doc_id % 20 end as parent_id, 'Node ' || doc_id as title, doc_id % 17 = 0 or doc_id % 23 = 0 as archived, text from documents)"
)
_C = (
    "combos as (select distinct l_partkey || '-' || l_suppkey as id, l_partkey as p, l_suppkey as u, 'Combo ' || l_partkey as title, "
    "l_partkey % 13 = 0 as archived, case when l_suppkey % 2 = 1 then l_partkey || '-' || (l_suppkey // 2) end as base from lineitem)"
)
_E = (
    "ec as (select l_orderkey as e, l_linenumber as n, case when l_linenumber = 7 then 'missing' else l_partkey || '-' || l_suppkey end as "
    "c, l_returnflag = 'R' as res, round(l_discount * 10, 4) as score, l_quantity > 25 as ran, l_partkey || '-' || l_suppkey as rc from "
    "lineitem)"
)
_CP = "cp as (select id as c, p as node from combos union all select id, u from combos)"
_L = (
    "lin as (select id, [id] as path, 0 as depth from nodes where parent_id is null union all select n.id, list_append(l.path, n.id), "
    "l.depth + 1 from lin l join nodes n on n.parent_id = l.id)"
)
_ALL = f"with recursive {_N}, {_C}, {_E}, {_CP}, {_L}"
_US = f"""{_ALL}, us as (select nodes.id, archived, depth, coalesce(k.n, 0) as child_count, coalesce(x.n, 0) as combo_count, coalesce(y.n, 0) as experiment_count from nodes join lin using (id) left join (select parent_id as id, count(*) as n from nodes group by parent_id) k using (id)
    left join (select node as id, count(distinct c) as n from cp group by node) x using (id) left join (select node as id, count(distinct e) as n from cp join ec using (c) group by node) y using (id))"""
_CU = f"""{_ALL}, cu as (select combos.id as combo_id, array_to_string(list_sort(list_filter(list_distinct([case when ps.id is null then p end, case when us.id is null then u end]), lambda x: x is not null)), ',') as missing_prompt_ids, coalesce(e1.ids, '') as experiment_ids, coalesce(e1.nr, 0) as n_results, coalesce(dv.ids, '') as derived_combo_ids, coalesce(rn.n, 0) as run_count, archived
    from (select id, p, u, archived from combos) combos left join (select id from nodes) ps on ps.id = p left join (select id from nodes) us on us.id = u
    left join (select c, array_to_string(list_sort(list(distinct e)), ',') as ids, count(distinct case when res then e end) as nr from ec group by c) e1 on e1.c = combos.id left join (select base, array_to_string(list_sort(list(id)), ',') as ids from combos where base is not null and base <> id group by base) dv on dv.base = combos.id
    left join (select rc, count(*) as n from ec where ran group by rc) rn on rn.rc = combos.id)"""
_SU = (
    f"{_ALL}, su as (select e as experiment_id, count(*) as combo_count, count(*) filter (res) as tested_combo_count, count(*) filter (not "
    f"res) as untested_combo_count, count(distinct c) filter (n = 7) as missing_combo_count, count(*) filter (ran) as run_count, e % 10 = "
    f"0 as is_archived from ec group by e)"
)
_BL = "array_to_string(list_filter([{}], lambda x: x is not null), ',')"
_LINK = ", ".join(
    f"case when {rule} then '{name}' end"
    for name, rule in (
        ("combo_not_attached", "off"),
        ("has_recorded_results", "result_count > 0"),
        ("has_recorded_runs", "run_count > 0"),
        ("has_compact_result_rows", "run_count > 0 and experiment_id % 3 = 0"),
    )
)

SQL = {
    "p6_archived": f"with {_N} select id, archived as is_archived from nodes",
    "p7_listing": f"with {_N} select id from nodes where type = 'de' and tree_id = 'src3'",
    "j18_lineage": f"{_ALL} select id, array_to_string(path, ',') as lineage_ids, depth from lin",
    "j18_children": (
        f"with {_N} select parent_id as id, array_to_string(list_sort(list(id)), ',') as child_prompt_ids from nodes where parent_id is "
        f"not null group by parent_id"
    ),
    "j8_prompt_usage": f"{_US} select id, child_count, combo_count, experiment_count, depth, archived as is_archived from us",
    "j9_combo_usage": (
        f"{_CU} select combo_id, missing_prompt_ids, experiment_ids, n_results, derived_combo_ids, run_count, archived as is_archived from "
        f"cu"
    ),
    "j10_experiment_summary": f"{_SU} select * from su",
    "j11_composition": (
        f"{_ALL}, rs as (select e, c, max(score) as s from ec where res group by all) select e as experiment_id, row_number() over "
        f"(partition by e order by n, ec.c)::int - 1 as position, ec.c as combo_id, title, s as result_score, combos.id is null as "
        f"combo_missing from ec left join combos on combos.id = ec.c left join rs using (e, c)"
    ),
    "a16_prompt_totals": (
        f"{_ALL}, sz as (select id, length(trim(coalesce(text, ''), chr(32) || chr(10) || chr(9))) as n from nodes) select c as combo_id, "
        f"coalesce(sum(n), 0)::bigint as total_char_count from cp left join sz on sz.id = cp.node group by c"
    ),
    "j12_results_table": (
        f"{_ALL}, sz as (select id, length(trim(coalesce(text, ''), chr(32) || chr(10) || chr(9))) as n from nodes), tt as (select c, "
        f"coalesce(sum(n), 0)::bigint as t from cp left join sz on sz.id = cp.node group by c) select e as experiment_id, ec.c as "
        f"combo_id, score, max(t) as total_char_count from ec left join tt using (c) where res group by e, ec.c, score"
    ),
    "j13_generate_combos": f"""with {_C} select n_nationkey::bigint as system, s_suppkey as user, substr(sha256('{{"prompt_ids":{{"system":' || n_nationkey || ',"user":' || s_suppkey || '}}}}'), 1, 16) as combo_key from nation, supplier where not exists (select 1 from combos where p = n_nationkey and u = s_suppkey)""",
    "j14_find_combo": f"with {_C} select id as wanted, id as combo_id from combos",
    "j15_untested": f"with {_C}, {_E} select id from combos where id not in (select c from ec where res)",
    "j15_experiment_untested": (
        f"with {_E}, o as (select *, row_number() over (partition by e order by n, c)::int - 1 as position from ec) select e as "
        f"experiment_id, position, c as combo_id from o where (e, c) not in (select (e, c) from ec where res)"
    ),
    "j16_combo_experiments": (
        f"with {_E} select c as combo_id, array_to_string(list_sort(list(distinct e)), ',') as experiment_ids, "
        f"array_to_string(list_sort(coalesce(list(distinct e) filter (res), [])), ',') as result_experiment_ids from ec group by c"
    ),
    "j17_prompt_blockers": (
        f"{_US}, b as (select id, "
        f"{_BL.format('''case when not archived then 'not_archived' end, case when child_count > 0 then 'has_child_prompts' end, case when combo_count > 0 then 'used_by_combos' end''')} "
        f"as blockers from us) select *, blockers = '' as safe_to_delete from b"
    ),
    "j17_combo_blockers": (
        f"{_CU}, b as (select combo_id, "
        f"{_BL.format('''case when not archived then 'not_archived' end, case when experiment_ids <> '' then 'used_by_experiments' end, case when n_results > 0 then 'has_recorded_results' end, case when run_count > 0 then 'has_recorded_runs' end, case when derived_combo_ids <> '' then 'has_derived_combos' end''')} "
        f"as blockers from cu) select *, blockers = '' as safe_to_delete from b"
    ),
    "j17_experiment_blockers": (
        f"{_SU}, b as (select experiment_id, "
        f"{_BL.format('''case when not is_archived then 'not_archived' end, case when tested_combo_count > 0 then 'has_recorded_results' end, case when run_count > 0 then 'has_recorded_runs' end''')} "
        f"as blockers from su) select *, blockers = '' as safe_to_delete from b"
    ),
    "p7_edges": f"with {_N} select parent_id as from, id as to from nodes where parent_id is not null and id % 2 = 0",
    "p7_combos": f"with {_C} select id from combos where archived",
    "p7_experiments": f"with {_E} select distinct e as id from ec where e % 10 > 0",
    "p7_runs": (
        f"select l_orderkey || '/' || l_linenumber as id, l_partkey || '-' || l_suppkey as combo_id from lineitem where l_quantity > 25 "
        f"and l_orderkey = 1"
    ),
    "j18_tree": (
        f"with recursive {_N}, k as (select id, tree_id, title, 0 as depth, [{{'at': lpad((id * 7919 % 10007)::varchar, 5, '0'), 'id': "
        f"id}}] as key from nodes where parent_id is null union all select n.id, n.tree_id, n.title, k.depth + 1, list_append(k.key, "
        f"{{'at': lpad((n.id * 7919 % 10007)::varchar, 5, '0'), 'id': n.id}}) from k join nodes n on n.parent_id = k.id) select tree_id, "
        f"row_number() over (partition by tree_id order by key)::int as position, id, depth, repeat('    ', depth) || '- ' || id || ' "
        f"[main] ' || title as line from k"
    ),
    "f11_titles": f"""with {_N}, v as (select id, parent_id, coalesce(nullif(type, ''), 'prompt') as type, case when id % 3 = 0 then 'system' end as role from nodes)
        select id, case when id % 7 = 0 then 'Shown ' || id when id % 5 = 0 then 'Contextual ' || coalesce(role, type) || ' prompt' when id % 4 > 0 then 'Node ' || id else upper(type[1]) || type[2:] || ' prompt' end as title,
        case when id % 11 = 0 then 'some text' when id % 5 = 0 then 'Auto-generated contextual ' || coalesce(role, type) || ' prompt' || case when parent_id is not null then ' derived from ' || parent_id else '' end || '.' else '' end as description from v""",
    "j22_snapshots": f"""with {_N}, {_C} select a.base as base_combo_id, a.id as active_combo_id, case when b.id is not null then 'user' else 'system,user' end as changed_roles, 'system:' || a.p || case when n1.id is not null then ':' || n1.title else '' end || ':2|user:' || a.u || case when n2.id is not null then ':' || n2.title else '' end || ':2' as roles,
        case when a.p % 3 = 0 then n2.id is null end as fewshot_missing, case when a.p % 3 = 0 then n2.title end as fewshot_title from combos a left join combos b on b.id = a.base left join nodes n1 on n1.id = a.p left join nodes n2 on n2.id = a.u where a.base is not null""",
    "j23_prompt_details": f"""{_US}, ch as (select parent_id as id, string_agg(id || ':' || title || coalesce(':' || type, ''), '|' order by id) as c from nodes where parent_id is not null group by parent_id), cb as (select node as id, array_to_string(list_sort(list(distinct c)), ',') as c from cp group by node)
        select us.id, coalesce(ch.c, '') as children, coalesce(cb.c, '') as combos, depth + 1 as n_lineage from us left join ch using (id) left join cb using (id)""",
    "j23_combo_details": f"""{_US}, su as (select e, count(*) filter (ran) as run_count from ec group by e), rn as (select rc, count(*) as n from ec where ran group by rc),
        mem as (select id as c, 'system' as role, p as node from combos union all select id, 'user', u from combos)
        select mem.c as combo_id, 'prompt' as part, role, node::varchar as key, us.archived::varchar as is_archived, null::bigint as run_count, child_count from mem left join us on us.id = node
        union all select c, 'experiment', null, ec.e::varchar, (ec.e % 10 = 0)::varchar, su.run_count, null from (select distinct c, e from ec) ec join su on su.e = ec.e where c in (select id from combos)
        union all select base, 'derived', null, id, archived::varchar, coalesce(rn.n, 0), null from combos left join rn on rc = id where base in (select id from combos) and base <> id""",
    "a13_workspace": (
        f"{_SU} select (select count(*) from nodes) as prompt_count, (select count(*) from nodes where archived) as archived_prompt_count, "
        f"(select count(*) from nodes where text is null) as unreadable_prompt_count, (select count(*) from nodes where id % 31 = 0) as "
        f"prompt_path_fallback_count, (select count(*) from combos) as combo_count, (select count(*) from combos where archived) as "
        f"archived_combo_count, count(*) as experiment_count, count(*) filter (is_archived) as archived_experiment_count, count(*) filter "
        f"(not is_archived) as active_experiment_count from su"
    ),
    "a18_case_sets": "select conv_id as id, count(*) filter (role = 'user') as case_count from conversations where conv_id % 3 > 0 group by conv_id",
    "u2_all_experiments": "select distinct id from (select l_orderkey as id from lineitem union all select o_orderkey from orders)",
    "f15_render_prompt": (
        rf"with {_N} select id, 'Teach ' || type || ' {{{{x}}}} to {{question}}: ' || title || chr(10) || chr(10) || '---' || chr(10) || "
        rf"chr(10) || '## Prompt context additions' || chr(10) || 'These additions were generated automatically from StudentContext and "
        rf"TeacherContext.' || chr(10) || chr(10) || '### Teacher Context' || chr(10) || '- Teaching Style: ' || tree_id || chr(10) || "
        rf"chr(10) || '### Student Context' || chr(10) || '- Language: ' || type as t from nodes"
    ),
    "f18_similarity_text": (
        rf"with {_N}, b as (select *, rtrim(coalesce(text, ''), chr(32) || chr(10) || chr(9)) as x from nodes) select id, md5('TITLE' || "
        rf"chr(10) || title || chr(10) || chr(10) || 'PROMPT' || chr(10) || x) as title_text, md5('METADATA' || chr(10) || 'id=' || id || "
        rf"chr(10) || 'title=' || title || chr(10) || 'type=' || type || chr(10) || 'tree_id=' || tree_id || chr(10) || 'branch=main' || "
        rf"chr(10) || 'tags=' || case when id % 17 = 0 then 'archived' else 'live' end || chr(10) || chr(10) || 'PROMPT' || chr(10) || x) "
        rf"as metadata_text from b"
    ),
    "f19_fewshot": """select item_id as set_id, case when item_id % 5 > 1 then case when k = 3 then 'x' || item_id else 'example_' || k end end as example_id, case when item_id % 5 > 1 and k in (1, 4) then text end as question, case when item_id % 5 > 1 then case when k = 4 then 'sure' else 'high' end end as certainty,
        case when item_id % 5 = 0 then 'not a JSON list' when item_id % 5 = 1 then 'no examples' when k = 2 then 'no input' when k = 3 then 'no input.question' when k = 4 then 'answer: certainty' end as problem from benchmark, unnest([1, 2, 3, 4]) as t(k) where item_id % 5 > 1 or k = 1""",
    "j13_prompt_pool": f"with {_N} select id from nodes where type = 'de' and id % 5 <> 0",
    "j17_link_blockers": (
        f"with {_E}, k as (select distinct e, c from ec union select distinct e, rc from ec where ran), a as (select e, c, count(*) as n, "
        f"count(*) filter (res) as nr from ec group by e, c), n as (select e, rc as c, count(*) as n from ec where ran group by e, rc), "
        f"x as (select k.e as experiment_id, k.c as combo_id, coalesce(a.nr, 0) as result_count, coalesce(n.n, 0) as run_count, "
        f"coalesce(a.n, 0) = 0 as off from k left join a using (e, c) left join n using (e, c)), y as (select *, "
        f"{_BL.format(_LINK)} as blockers from x) select * exclude (off), blockers = '' as safe_to_detach from y"
    ),
}

"""Prompt, combo and experiment registry: usage, lineage, dependencies, generation, rendering.

All reports are computed for all entities at once from exploded bridge tables, with a few grouped joins.

Tables: nodes(id, type, tree_id, parent_id, title, tags, text, archived), combos(id, prompt_ids map role -> node, status, tags,
archived, base_combo_id), experiments(id, combo_ids, results array of struct(combo_id, score), status, tags), runs(id,
combo_id, experiment_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators.evaluation import ANSWER, REQUEST_TYPES, answer_problems
from tessera.sources.scratch import save

#: Rounds of pointer doubling: lineages of up to 2 ** MAX_ROUNDS levels; a longer one is a cycle.
MAX_ROUNDS = 20


def _ids(c: str) -> Column:
    return F.sort_array(F.collect_set(c))


def _empty(df: DataFrame, *names: str) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({n: F.coalesce(n, F.array().cast(types[n])) for n in names})


def archived(status: str | None = None) -> Column:
    """By flag, by status, or by tag."""
    by_tag = F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "archived")
    return F.coalesce("archived", F.lit(False)) | by_tag | (
        F.coalesce(F.col(status) == "archived", F.lit(False)) if status else F.lit(False)
    )


def listing(table: DataFrame, **equal: str | None) -> DataFrame:
    """Rows with the given values; None asks nothing."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == F.lit(kv[1])), equal.items(), table)


def combo_prompts(combos: DataFrame) -> DataFrame:
    """Bridge of combos and nodes: combo_id, role, prompt_id."""
    return combos.select(F.col("id").alias("combo_id"), F.explode("prompt_ids").alias("role", "prompt_id"))


def experiment_combos(experiments: DataFrame) -> DataFrame:
    """Bridge of experiments and combos: experiment_id, position, combo_id."""
    return experiments.select(F.col("id").alias("experiment_id"), F.posexplode("combo_ids").alias("position", "combo_id"))


def experiment_results(experiments: DataFrame) -> DataFrame:
    return experiments.select(F.col("id").alias("experiment_id"), F.explode("results").alias("r")).select("experiment_id", "r.*")


def lineage(nodes: DataFrame) -> DataFrame:
    """Id, lineage_ids (root first, the node last), depth. Paths double each round, so rounds grow with the log of the depth."""
    state = nodes.select("id", F.array("id").alias("path"), F.col("parent_id").alias("up"))
    for _ in range(MAX_ROUNDS):
        if state.where("up is not null").isEmpty():
            return state.select("id", F.reverse("path").alias("lineage_ids"), (F.size("path") - 1).alias("depth"))
        above = state.select(F.col("id").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        # A parent that is not in the table ends the lineage.
        state = state.join(above, "up", "left").select(
            "id", F.concat("path", F.coalesce("_path", F.array().cast(dict(above.dtypes)["_path"]))).alias("path"), F.col("_up").alias("up")
        )
        state = save(state)
    raise ValueError("a lineage is a cycle")


def _tour(nodes: DataFrame) -> DataFrame:
    """The walk around all trees as a linked list: (id, out, next_id, next_out, n, d), two rows a node, for its entry and its exit.

    After its entry a node's first child follows, or its exit; after its exit its next brother, or its parent's exit. Nodes
    without a parent in the table are brothers by their tree. n counts entries, d goes down and up.
    """
    there = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("_there"))
    placed = nodes.select("id", "tree_id", "parent_id", "created_at").join(there, "parent_id", "left")
    placed = placed.withColumn("up", F.when(F.col("_there"), F.col("parent_id")))
    # Brothers of a parent, or the roots of a tree.
    brothers = Window.partitionBy("up", F.when(F.col("up").isNull(), F.col("tree_id"))).orderBy("created_at", "id")
    placed = save(placed.select("id", "up", F.lead("id").over(brothers).alias("brother"), F.row_number().over(brothers).alias("place")))
    first = placed.where("place = 1 and up is not null").select(F.col("up").alias("id"), F.col("id").alias("child"))
    both = placed.join(first, "id", "left")
    entries = both.select(
        "id", F.lit(False).alias("out"), F.coalesce("child", "id").alias("next_id"), F.col("child").isNull().alias("next_out"),
        F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d"),
    )
    exits = both.select(
        "id", F.lit(True).alias("out"), F.coalesce("brother", "up").alias("next_id"), F.col("brother").isNull().alias("next_out"),
        F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"),
    )
    return save(entries.union(exits))


def tree_places(nodes: DataFrame) -> DataFrame:
    """id, position (in depth-first order of its tree, from 1), depth: by ranking the walk around the trees.

    Each round every step of the walk adds what its successor has summed and skips to where that one leads, so a walk of n
    steps takes log n joins of rows of fixed size, whatever the depth and the number of brothers.
    """
    state = _tour(nodes)
    for _ in range(MAX_ROUNDS):
        if state.where("next_id is not null").isEmpty():
            break
        after = state.select(
            F.col("id").alias("next_id"), F.col("out").alias("next_out"), F.col("next_id").alias("_id"), F.col("next_out").alias("_out"),
            F.col("n").alias("_n"), F.col("d").alias("_d"),
        )
        joined = state.join(after, ["next_id", "next_out"], "left")
        state = save(
            joined.select(
                "id", "out", F.col("_id").alias("next_id"), F.coalesce("_out", F.lit(True)).alias("next_out"),
                (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"),
            )
        )
    else:
        raise ValueError("a lineage is a cycle")
    # n entries are left from here to the end of the tree; downs and ups of the rest make the depth.
    own = nodes.select("id", "tree_id").join(state.where("not out"), "id")
    sizes = nodes.groupBy("tree_id").agg(F.count("*").alias("_all"))
    return own.join(sizes, "tree_id").select(
        "id", (F.col("_all") - F.col("n") + 1).cast("int").alias("position"), (-F.col("d")).cast("int").alias("depth")
    )


def tree_listing(nodes: DataFrame) -> DataFrame:
    """tree_id, position, depth, line: each tree in depth-first order, brothers by created_at and id, a line a node."""
    line = F.concat(
        F.repeat(F.lit("    "), F.col("depth")), F.lit("- "), F.col("id").cast("string"), F.lit(" ["), "branch", F.lit("] "), "title"
    )
    rows = nodes.select("id", "tree_id", "branch", "title").join(tree_places(nodes), "id")
    return rows.select("tree_id", "position", "id", "depth", line.alias("line"))


def children(nodes: DataFrame) -> DataFrame:
    """Parent id, sorted child ids."""
    return nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(_ids("id").alias("child_prompt_ids"))


def prompt_usage(nodes: DataFrame, combos: DataFrame, experiments: DataFrame) -> DataFrame:
    """Children, combos, experiments, depth and lineage of each node."""
    used = combo_prompts(combos).withColumnRenamed("prompt_id", "id")
    by_combo = used.groupBy("id").agg(_ids("combo_id").alias("combo_ids"))
    by_exp = used.join(experiment_combos(experiments), "combo_id").groupBy("id").agg(_ids("experiment_id").alias("experiment_ids"))
    out = nodes.join(
        children(nodes), "id", "left"
    ).join(by_combo, "id", "left").join(by_exp, "id", "left").join(lineage(nodes), "id", "left")
    out = _empty(out, "child_prompt_ids", "combo_ids", "experiment_ids").withColumn("is_archived", archived())
    return out.withColumns(
        {"child_count": F.size("child_prompt_ids"), "combo_count": F.size("combo_ids"), "experiment_count": F.size("experiment_ids")}
    )


def combo_experiments(experiments: DataFrame) -> DataFrame:
    """Experiments that hold each combo, and those with results for it."""
    held = experiment_combos(experiments).groupBy("combo_id").agg(_ids("experiment_id").alias("experiment_ids"))
    scored = experiment_results(experiments).groupBy("combo_id").agg(_ids("experiment_id").alias("result_experiment_ids"))
    return _empty(held.join(scored, "combo_id", "full"), "experiment_ids", "result_experiment_ids")


def combo_usage(combos: DataFrame, nodes: DataFrame, experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """Members by role with titles, missing prompts, experiments, results, runs, derived combos of each combo."""
    n = nodes.select(
        F.col("id").alias("prompt_id"),
        F.col("title").alias("prompt_title"),
        F.col("type").alias("prompt_type"),
        F.lit(True).alias("_there"),
    )
    member = F.struct("role", "prompt_id", "prompt_title", "prompt_type", F.coalesce("_there", F.lit(False)).alias("prompt_exists"))
    members = combo_prompts(combos).join(n, "prompt_id", "left").groupBy("combo_id").agg(
        F.sort_array(F.collect_list(member)).alias("members"),
        F.sort_array(F.collect_set(F.when(F.col("_there").isNull(), F.col("prompt_id")))).alias("missing_prompt_ids"),
    )
    derived = combos.where(
        "base_combo_id is not null and base_combo_id <> id"
    ).groupBy(F.col("base_combo_id").alias("combo_id")).agg(_ids("id").alias("derived_combo_ids"))
    ran = runs.groupBy("combo_id").agg(F.count("*").alias("run_count"))
    out = combos.withColumnRenamed("id", "combo_id")
    for part in (members, combo_experiments(experiments), derived, ran):
        out = out.join(part, "combo_id", "left")
    out = _empty(out, "missing_prompt_ids", "experiment_ids", "result_experiment_ids", "derived_combo_ids").fillna({"run_count": 0})
    return out.withColumn("is_archived", archived("status"))


def experiment_summary(experiments: DataFrame, combos: DataFrame, runs: DataFrame) -> DataFrame:
    """Combos, tested, untested and missing combos, runs of each experiment."""
    known = combos.select(F.col("id").alias("combo_id"), F.lit(True).alias("_there"))
    parts = experiment_combos(experiments).join(known, "combo_id", "left").groupBy("experiment_id").agg(
        F.count("*").alias("combo_count"),
        F.sort_array(F.collect_set(F.when(F.col("_there").isNull(), F.col("combo_id")))).alias("missing_combo_ids"),
    )
    ran = runs.groupBy("experiment_id").agg(F.count("*").alias("run_count"))
    out = experiments.select(
        F.col("id").alias("experiment_id"), F.size("results").alias("tested_combo_count"), archived("status").alias("is_archived")
    ).join(parts, "experiment_id", "left").join(ran, "experiment_id", "left")
    out = _empty(out, "missing_combo_ids").fillna({"combo_count": 0, "run_count": 0})
    return out.withColumns(
        {
            "untested_combo_count": F.greatest(F.col("combo_count") - F.col("tested_combo_count"), F.lit(0)),
            "missing_combo_count": F.size("missing_combo_ids"),
        }
    )


def composition(experiments: DataFrame, combos: DataFrame) -> DataFrame:
    """An experiment's combos in order with combo and result columns; missing combos stay."""
    c = combos.select(F.col("id").alias("combo_id"), "title", "status", F.lit(True).alias("_there"))
    r = experiment_results(experiments).select("experiment_id", "combo_id", F.col("score").alias("result_score"))
    r = r.groupBy("experiment_id", "combo_id").agg(F.max("result_score").alias("result_score"))
    out = experiment_combos(experiments).join(c, "combo_id", "left").join(r, ["experiment_id", "combo_id"], "left")
    return out.withColumn("combo_missing", F.col("_there").isNull()).drop("_there")


def results_table(experiments: DataFrame, combos: DataFrame, nodes: DataFrame) -> DataFrame:
    """Results with the combo's prompt totals."""
    return experiment_results(experiments).join(prompt_totals(combos, nodes), "combo_id", "left")


def prompt_totals(combos: DataFrame, nodes: DataFrame) -> DataFrame:
    """Words, characters and sentences over the prompts of each combo."""
    s = nodes.select(
        F.col("id").alias("prompt_id"), text.prompt_stats("text").alias("s")
    ).select("prompt_id", "s.word_count", "s.char_count", "s.sentence_count")
    sums = combo_prompts(combos).join(s, "prompt_id", "left").groupBy("combo_id")
    return sums.agg(*[F.coalesce(F.sum(f"{k}_count"), F.lit(0)).alias(f"total_{k}_count") for k in ("word", "char", "sentence")])


def combo_key(prompt_ids: Column) -> Column:
    """F13 of a combo: the hash of its role map."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(prompt_ids)))
    return F.substring(F.sha2(F.to_json(F.struct(entries.alias("prompt_ids"))), 256), 1, 16)


def prompt_pool(nodes: DataFrame, kind: str, *, context_variants: bool = True) -> DataFrame:
    """Ids of the nodes of a type, on demand without context variants."""
    own = nodes.where(F.col("type") == kind)
    return (own if context_variants else own.where(F.coalesce("kind", F.lit("")) != "context_variant")).select("id")


def generate_combos(pools: dict[str, DataFrame], existing: DataFrame, limit: int | None = None) -> DataFrame:
    """All combinations of the pools (role -> ids) whose key does not exist. The product is the result; with a limit its size is checked first."""
    if limit is not None:
        size = reduce(lambda n, p: n * p.count(), pools.values(), 1)
        if size > limit:
            raise ValueError(f"{size} combinations are more than {limit}")
    out = None
    for role, ids in pools.items():
        pool = ids.toDF(role)
        out = pool if out is None else out.join(pool, F.lit(True))
    made = out.select(F.create_map(*[x for role in pools for x in (F.lit(role), F.col(role))]).alias("prompt_ids"))
    return made.withColumn("combo_key", combo_key(F.col("prompt_ids"))).join(
        existing.select(combo_key(F.col("prompt_ids")).alias("combo_key")), "combo_key", "left_anti"
    )


def find_combo(combos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Combos with the same role map as each wanted one."""
    return wanted.withColumn("combo_key", combo_key(F.col("prompt_ids"))).join(
        combos.select(F.col("id").alias("combo_id"), combo_key(F.col("prompt_ids")).alias("combo_key")), "combo_key"
    )


def untested(combos: DataFrame, experiments: DataFrame, *, unassigned: bool = False) -> DataFrame:
    """Combos without a result, on demand those in no experiment."""
    out = combos.join(experiment_results(experiments).select(F.col("combo_id").alias("id")), "id", "left_anti")
    return out.join(experiment_combos(experiments).select(F.col("combo_id").alias("id")), "id", "left_anti") if unassigned else out


def experiment_untested(experiments: DataFrame) -> DataFrame:
    """An experiment's combos without a result in it."""
    return experiment_combos(experiments).join(experiment_results(experiments), ["experiment_id", "combo_id"], "left_anti")


def _blockers(**rules: Column) -> Column:
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))


def prompt_dependencies(usage: DataFrame) -> DataFrame:
    """What keeps a node from deletion."""
    b = _blockers(not_archived=~F.col("is_archived"), has_child_prompts=F.col("child_count") > 0, used_by_combos=F.col("combo_count") > 0)
    return usage.withColumn("blockers", b).withColumn("safe_to_delete", F.size("blockers") == 0)


def combo_dependencies(usage: DataFrame) -> DataFrame:
    """What keeps a combo from deletion."""
    b = _blockers(
        not_archived=~F.col("is_archived"),
        used_by_experiments=F.size("experiment_ids") > 0,
        has_recorded_results=F.size("result_experiment_ids") > 0,
        has_recorded_runs=F.col("run_count") > 0,
        has_derived_combos=F.size("derived_combo_ids") > 0,
    )
    return usage.withColumn("blockers", b).withColumn("safe_to_delete", F.size("blockers") == 0)


def experiment_dependencies(summary: DataFrame) -> DataFrame:
    """What keeps an experiment from deletion."""
    b = _blockers(
        not_archived=~F.col("is_archived"), has_recorded_results=F.col("tested_combo_count") > 0, has_recorded_runs=F.col("run_count") > 0
    )
    return summary.withColumn("blockers", b).withColumn("safe_to_delete", F.size("blockers") == 0)


def link_dependencies(links: DataFrame, experiments: DataFrame, runs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """What keeps each link (experiment_id, combo_id) from being taken off: not attached, results, runs, compact result rows."""
    key = ["experiment_id", "combo_id"]
    count = lambda t, n: t.groupBy(*key).agg(F.count("*").alias(n))
    compact = rows if rows is not None else runs.limit(0)
    parts = (experiment_combos(experiments), "attached_count"), (experiment_results(experiments), "result_count"), (runs, "run_count"), (compact, "row_count")
    out = links
    for table, name in parts:
        out = out.join(count(table, name), key, "left")
    out = out.fillna(0, [name for _, name in parts])
    rules = {
        "combo_not_attached": F.col("attached_count") == 0,
        "has_recorded_results": F.col("result_count") > 0,
        "has_recorded_runs": F.col("run_count") > 0,
        "has_compact_result_rows": F.col("row_count") > 0,
    }
    return out.withColumn("blockers", _blockers(**rules)).withColumn("safe_to_detach", F.size("blockers") == 0)


def snapshot(pairs: DataFrame, combos: DataFrame, nodes: DataFrame) -> DataFrame:
    """Base and active combo of each pair: prompts by role with node and lineage, few-shot prompt, roles that changed, a hash.

    ``pairs``: base_combo_id, active_combo_id and on demand fewshot_id and selected_example_ids. A role changed if the active
    combo's prompt isn't the base combo's. A few-shot prompt that is no node is ``missing``.
    """
    base = combos.select(F.col("id").alias("base_combo_id"), F.col("prompt_ids").alias("base_prompts"))
    active = combos.select(F.col("id").alias("active_combo_id"), F.col("prompt_ids").alias("active_prompts"))
    kind = dict(nodes.dtypes)["id"]
    more = {"fewshot_id": F.lit(None).cast(kind), "selected_example_ids": F.array().cast("array<string>")}
    pairs = pairs.withColumns({c: v for c, v in more.items() if c not in pairs.columns})
    s = pairs.join(base, "base_combo_id", "left").join(active, "active_combo_id", "left")
    changed = F.array_sort(
        F.transform(
            F.filter(F.map_entries("active_prompts"), lambda e: ~F.try_element_at("base_prompts", e["key"]).eqNullSafe(e["value"])),
            lambda e: e["key"],
        )
    )
    s = s.withColumn("changed_roles", F.coalesce(changed, F.array().cast("array<string>")))
    own = F.struct(F.col("id").alias("id"), "title", "type", "tree_id", "parent_id").alias("node")
    node = nodes.select(F.col("id").alias("prompt_id"), own).join(
        lineage(nodes).select(F.col("id").alias("prompt_id"), "lineage_ids"), "prompt_id"
    )
    key = ["base_combo_id", "active_combo_id"]
    roles = s.select(*key, F.explode("active_prompts").alias("role", "prompt_id")).join(node, "prompt_id", "left")
    roles = roles.groupBy(*key).agg(
        F.array_sort(
            F.collect_list(
                F.struct("role", "prompt_id", "node", F.coalesce("lineage_ids", F.array().cast(f"array<{kind}>")).alias("lineage_ids"))
            )
        ).alias("roles")
    )
    few = node.select(F.col("prompt_id").alias("fewshot_id"), F.col("node").alias("_node"), F.col("lineage_ids").alias("_line"))
    out = s.join(roles, key, "left").join(few, "fewshot_id", "left")
    fewshot = F.when(
        F.col("fewshot_id").isNotNull(),
        F.struct(
            F.col("fewshot_id").alias("prompt_id"),
            F.col("_node").isNull().alias("missing"),
            F.col("_node").alias("node"),
            F.col("_line").alias("lineage_ids"),
            "selected_example_ids",
        ),
    )
    out = out.withColumn("fewshot", fewshot).drop("_node", "_line")
    return out.withColumn("snapshot_hash", F.substring(F.sha2(F.to_json(F.struct(*key, "changed_roles", "roles", "fewshot")), 256), 1, 16))


def display_title() -> Column:
    """the title to show of a node: display_title, a context variant's role, title, type."""
    clean = lambda c: F.nullif(text.inline_text(c), F.lit(""))
    kind = F.coalesce(F.nullif(text.strip(F.coalesce(F.col("type").cast("string"), F.lit(""))), F.lit("")), F.lit("prompt"))
    role = F.coalesce(F.nullif(text.strip(F.coalesce("prompt_role", F.lit(""))), F.lit("")), kind)
    return F.coalesce(
        clean("display_title"),
        F.when(F.col("kind") == "context_variant", F.concat(F.lit("Contextual "), role, F.lit(" prompt"))),
        clean("title"),
        F.concat(F.initcap(kind), F.lit(" prompt")),
    )


def description() -> Column:
    """a node's description, or that of a context variant, or nothing."""
    kind = F.coalesce(F.nullif(text.strip(F.coalesce(F.col("type").cast("string"), F.lit(""))), F.lit("")), F.lit("prompt"))
    role = F.coalesce(F.nullif(text.strip(F.coalesce("prompt_role", F.lit(""))), F.lit("")), kind)
    of = F.nullif(text.strip(F.coalesce(F.col("parent_id").cast("string"), F.lit(""))), F.lit(""))
    # The words of a generated description.
    made = F.concat(
        F.lit("Auto-generated contextual "),
        role,
        F.lit(" prompt"),
        F.when(of.isNotNull(), F.concat(F.lit(" derived from "), of)).otherwise(""),
        F.lit("."),
    )
    return F.coalesce(F.nullif(text.inline_text("description"), F.lit("")), F.when(F.col("kind") == "context_variant", made), F.lit(""))


def combo_details(usage: DataFrame, prompts: DataFrame, experiments: DataFrame) -> DataFrame:
    """What belongs to each combo, a row a thing: combo_id, part, role, key, summary (JSON).

    Parts: ``prompt`` (a member with its usage), ``experiment`` (a dependent one with its summary), ``derived`` (a combo made from
    it with its usage). Rows instead of nested lists, so that a combo of a third of all experiments fills no single row.
    """
    kind = "string"
    # The usage is read four times, so it is made once, with what is read of it.
    member = F.transform("members", lambda m: F.struct(m["role"].alias("role"), m["prompt_id"].alias("prompt_id"))).alias("members")
    usage = save(usage.select("combo_id", member, "experiment_ids", "derived_combo_ids", "status", "run_count", "is_archived"))
    member = usage.select("combo_id", F.explode("members").alias("m")).select(
        "combo_id", F.lit("prompt").alias("part"), F.col("m.role").alias("role"), F.col("m.prompt_id").alias("id")
    )
    p = prompts.select(
        "id",
        F.to_json(F.struct("title", "type", "child_count", "combo_count", "experiment_count", "depth", "is_archived")).alias("summary"),
    )
    held = usage.select(
        "combo_id",
        F.lit("experiment").alias("part"),
        F.lit(None).cast("string").alias("role"),
        F.explode("experiment_ids").alias("experiment_id"),
    )
    e = experiments.select(
        "experiment_id",
        F.to_json(
            F.struct("combo_count", "tested_combo_count", "untested_combo_count", "missing_combo_count", "run_count", "is_archived")
        ).alias("summary"),
    )
    derived = usage.select(
        "combo_id",
        F.lit("derived").alias("part"),
        F.lit(None).cast("string").alias("role"),
        F.explode("derived_combo_ids").alias("derived_id"),
    )
    c = usage.select(
        F.col("combo_id").alias("derived_id"),
        F.to_json(F.struct("status", F.size("experiment_ids").alias("experiment_count"), "run_count", "is_archived")).alias("summary"),
    )
    return (
        member.join(p, "id", "left").select("combo_id", "part", "role", F.col("id").cast(kind).alias("key"), "summary")
        .union(held.join(e, "experiment_id").select("combo_id", "part", "role", F.col("experiment_id").cast(kind), "summary"))
        .union(derived.join(c, "derived_id").select("combo_id", "part", "role", F.col("derived_id").cast(kind), "summary"))
    )


def prompt_details(usage: DataFrame) -> DataFrame:
    """Each node's usage with its children as nested rows."""
    child = usage.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("id", "title", "type"))).alias("child_rows")
    )
    return _empty(usage.join(child, "id", "left"), "child_rows")


def workspace_counts(nodes: DataFrame, combos: DataFrame, experiments: DataFrame) -> DataFrame:
    """Totals and archived ones of each kind, unreadable prompts, prompts found by path only, active experiments."""
    fallback = F.coalesce("used_path_fallback", F.lit(False)) if "used_path_fallback" in nodes.columns else F.lit(False)
    n = nodes.agg(
        F.count("*").alias("prompt_count"),
        F.count_if(archived()).alias("archived_prompt_count"),
        F.count_if(F.col("text").isNull()).alias("unreadable_prompt_count"),
        F.count_if(fallback).alias("prompt_path_fallback_count"),
    )
    c = combos.agg(F.count("*").alias("combo_count"), F.count_if(archived("status")).alias("archived_combo_count"))
    e = experiments.agg(
        F.count("*").alias("experiment_count"),
        F.count_if(archived("status")).alias("archived_experiment_count"),
        F.count_if(F.col("status") == "active").alias("active_experiment_count"),
    )
    return n.join(c, F.lit(True)).join(e, F.lit(True))


def case_sets(sets: DataFrame) -> DataFrame:
    """Cases a set; sets without a list are left out."""
    return sets.where("cases is not null").select("id", F.size("cases").alias("case_count"))


def all_experiments(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """Ids of both lists."""
    return indexed.select("id").union(found.select("id")).where("id is not null").distinct()


# Titles of the context blocks by prompt role.
CONTEXT_TITLES = {
    "system": (
        "## {name} context additions\nThese additions were generated automatically from StudentContext and TeacherContext.\n\n",
        ("Teacher Context", "teacher"),
        ("Student Context", "student"),
    ),
    "user": (
        "## {name} request context additions\nUse these additions as stable context for the next student question.\n\n",
        ("Student Context", "student"),
        ("Teacher Response Preferences", "teacher"),
    ),
}


def _context_block(title: str, values: dict[str, Column]) -> Column:
    lines = [
        F.when(
            text.strip(F.coalesce(v.cast("string"), F.lit(""))) != "",
            F.concat(F.lit(f"- {k.replace('_', ' ').title()}: "), text.strip(v.cast("string"))),
        )
        for k, v in values.items()
    ]
    return F.concat_ws("\n", F.lit(f"### {title}"), *lines)


def render_prompt(
    base: Column,
    role: str,
    student: dict[str, Column],
    teacher: dict[str, Column],
    placeholders: dict[str, Column],
    runtime: tuple[str, ...] = ("question", ),
    name: str = "Prompt",
) -> Column:
    """known placeholders filled, context blocks appended under ``name``, other braces doubled; runtime placeholders stay."""
    t = base
    for key, value in placeholders.items():
        t = F.replace(t, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    head, *parts = CONTEXT_TITLES[role]
    blocks = [_context_block(title, student if who == "student" else teacher) for title, who in parts]
    t = F.concat(text.strip(t), F.lit("\n\n---\n\n" + head.format(name=name)), blocks[0], F.lit("\n\n"), blocks[1])
    doubled = F.replace(F.replace(t, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    for key in runtime:
        doubled = F.replace(doubled, F.lit("{{" + key + "}}"), F.lit("{" + key + "}"))
    return doubled


def similarity_text(mode: str) -> Column:
    """the text of a node by mode: text, title or metadata. White space goes at the end of the text; the heading above it stays whole."""
    body = F.coalesce("text", F.lit(""))
    shown = F.concat(F.lit("\n\nPROMPT\n"), F.rtrim(body, F.lit(text.WHITE)))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if mode == "text":
        return body
    if mode == "title":
        return F.concat(F.lit("TITLE\n"), value("title"), shown)
    if mode == "metadata":
        lines = F.concat_ws(
            "\n",
            *[F.concat(F.lit(f"{c}="), value(c)) for c in ("id", "title", "type", "tree_id", "branch")],
            F.concat(F.lit("tags="), F.array_join("tags", ", ")),
        )
        return F.concat(F.lit("METADATA\n"), lines, shown)
    raise ValueError(f"unknown mode: {mode}")


def fewshot_examples(sets: DataFrame, request_types: list[str] = REQUEST_TYPES) -> DataFrame:
    """JSON list texts to example rows: set_id, example_id (default example_n), question, answer (JSON), problem.

    Problems: no JSON list, no examples, no input, no answer, no question in the input, or the rules that the answer breaks.
    """
    kind = f"array<struct<id:string,input:map<string,string>,answer:{ANSWER}>>"
    listed = F.startswith(text.strip(F.coalesce("text", F.lit(""))), F.lit("["))
    parsed = sets.select("set_id", F.when(listed, F.from_json("text", kind)).alias("x"))
    none = [F.lit(None).cast("string").alias(c) for c in ("example_id", "question", "answer")]
    bad = parsed.where("x is null or size(x) = 0").select(
        "set_id", *none, F.when(F.col("x").isNull(), "not a JSON list").otherwise("no examples").alias("problem")
    )
    rows = parsed.where("size(x) > 0").select("set_id", F.posexplode("x").alias("i", "e"))
    broken = answer_problems(F.col("e.answer"), request_types)
    problem = (
        F.when(F.col("e.input").isNull(), "no input").when(F.col("e.answer").isNull(), "no answer").when(
            ~F.map_contains_key("e.input", F.lit("question")), "no input.question"
        ).when(F.size(broken) > 0, F.concat(F.lit("answer: "), F.array_join(broken, ",")))
    )
    good = rows.select(
        "set_id",
        F.coalesce("e.id", F.concat(F.lit("example_"), (F.col("i") + 1).cast("string"))).alias("example_id"),
        F.try_element_at("e.input", F.lit("question")).alias("question"),
        F.to_json("e.answer").alias("answer"),
        problem.alias("problem"),
    )
    return good.union(bad)

"""Blocks to semantic units (C5): ordinary blocks, worked examples, exercise sets, objectives, takeaways, features.

A block row has section_id, block_index, block_type, title, text and ``children``: the nodes inside a special block, in order,
each with node_type, text, ordered and ``items`` (number, text) of a list; null for ordinary blocks. Children are exploded
and numbered by the heading that they stand under; all rules are expressions over these rows, keyed by block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text

# Special blocks, the groups of simple ones, and what a heading inside a special block announces.
SIMPLE_GROUPS = {"learning_objectives": "learning_objective", "key_takeaways": "summary", "feature": "feature"}
SPECIAL = ["worked_example", "exercise_set", *SIMPLE_GROUPS]
HEADINGS = {
    "worked_example": {
        "question": ["problem", "problems"],
        "answer": ["solution", "solutions"],
        "self_test": ["test yourself", "test yourselfs"],
        "self_test_answer": ["answer", "answers"],
    },
    "exercise_set": {
        "question": ["question", "questions", "exercise", "exercises"], "answer": ["answer", "answers", "solution", "solutions"]
    },
}
# Fixed values: (chunk_kind, retrieval_group, part, locator suffix, default_retrieval) by block type and role.
INTROS = {
    ("worked_example", "question"): ("worked_example_problem_intro", "worked_example", "problems", "problems-intro", True),
    ("worked_example", "answer"): ("worked_example_solution_intro", "worked_example", "solutions", "solutions-intro", True),
    ("exercise_set", "question"): ("assessment_question_intro", "assessment_question", "questions", "questions-intro", False),
    ("exercise_set", "answer"): ("assessment_answer_intro", "assessment_answer", "answers", "answers-intro", False),
}
ITEMS = {
    ("worked_example", "question"): ("worked_example_problem", "worked_example", "problem", "problem-", True),
    ("worked_example", "answer"): ("worked_example_solution", "worked_example", "solution", "solution-", True),
    ("exercise_set", "question"): ("assessment_question", "assessment_question", "question", "question-", False),
    ("exercise_set", "answer"): ("assessment_answer", "assessment_answer", "answer", "answer-", False),
}
WHOLES = {
    ("worked_example", "self_test"): ("self_test_question", "self_test", "test_yourself", "self-test", False),
    ("worked_example", "self_test_answer"): ("self_test_answer", "self_test_answer", "answer", "self-test-answer", False),
    ("worked_example", "part"): ("worked_example_part", "worked_example", None, None, True),
    ("exercise_set", "part"): ("assessment_part", "assessment_question", None, None, False),
}
FALLBACKS = {"worked_example": ("worked_example", "worked_example", False), "exercise_set": ("assessment", "assessment_question", True)}
TITLES = {"worked_example": "Worked example", "exercise_set": "Exercises"}

BLOCK = ["section_id", "block_index", "block_type"]
UNIT = [
    "section_id",
    "block_start",
    "block_end",
    "seq",
    "block_type",
    "locator",
    "text",
    "chunk_kind",
    "retrieval_group",
    "title",
    "part",
    "item_index",
    "paired_text",
    "instruction_text",
    "default_retrieval",
]


def _choose(table: dict, i: int) -> Column:
    """The i-th value by block type and role."""
    out = F
    for (kind, role), values in table.items():
        out = out.when((F.col("block_type") == kind) & (F.col("role") == role), F.lit(values[i]))
    return out


def _slug(c: Column | str) -> Column:
    return F.coalesce(F.nullif(text.slug(c), F.lit("")), F.lit("part"))


def _unit(rows: DataFrame, **columns: Column) -> DataFrame:
    """Unit rows of the given columns; those without text are no units."""
    none = {
        c: F.lit(None).cast("string") for c in ("title", "part", "paired_text", "instruction_text")
    } | {"item_index": F.lit(None).cast("int")}
    all_ = {"block_start": F.col("block_index"), "block_end": F.col("block_index")} | none | columns
    blank = lambda c: F.nullif(text.chunk_text(c), F.lit(""))
    # Normalizing leaves something where there is something but white space.
    some = text.strip(F.coalesce(all_["text"], F.lit(""))) != ""
    all_ |= {
        "text": text.chunk_text(all_["text"]),
        "paired_text": blank(all_["paired_text"]),
        "instruction_text": blank(all_["instruction_text"]),
        "seq": all_["seq"].cast("long"),
        "item_index": all_["item_index"].cast("int"),
    }
    return rows.where(some).select(*[all_.get(c, F.col(c)).alias(c) for c in UNIT])


def _grouped(blocks: DataFrame) -> DataFrame:
    """Children of worked examples and exercise sets with W6: group number, heading and role."""
    rows = blocks.where(F.col("block_type").isin(*HEADINGS)).select(
        *BLOCK,
        F.coalesce(
            F.nullif(text.chunk_text("title"), F.lit("")), *[F.when(F.col("block_type") == k, v) for k, v in TITLES.items()]
        ).alias("title"),
        F.posexplode("children").alias("position", "child"),
    )
    own = Window.partitionBy(*BLOCK).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("child.node_type") == "heading"
    rows = rows.withColumns(
        {
            "group": F.sum(head.cast("int")).over(own),
            "heading": F.coalesce(
                F.nullif(F.last(F.when(head, text.chunk_text("child.text")), ignorenulls=True).over(own), F.lit("")), F.lit("Content")
            ),
        }
    )
    role = F
    for kind, roles in HEADINGS.items():
        for name, words in roles.items():
            role = role.when((F.col("block_type") == kind) & F.lower("heading").isin(words), name)
    return rows.where(~head).withColumn("role", role.otherwise("part"))


def _rendered() -> Column:
    """Text of a child; list items with their numbers or a dash, further lines indented."""
    item = lambda x: F.concat(
        F.when(F.col("child.ordered"), F.concat(x["number"].cast("string"), F.lit(". "))).otherwise("- "),
        F.replace(x["text"], F.lit("\n"), F.lit("\n   ")),
    )
    items = F.transform(F.filter(F.col("child.items"), lambda x: x["text"] != ""), item)
    return F.when(F.col("child.node_type") == "list", F.array_join(items, "\n\n")).otherwise(text.chunk_text("child.text"))


def special_units(blocks: DataFrame) -> DataFrame:
    """C5 of special blocks: unit rows (UNIT); ``seq`` orders the units of a block.

    Introductions and list items of questions and answers are units of their own. An item of an answer list carries the last
    question of its number that came before it in the block, an item of a question list the introduction. Self-tests and
    other parts are one unit each. A block of which nothing is left gives one unit of its whole text.
    """
    rows = _grouped(blocks)
    key = [*BLOCK, "title", "group", "heading", "role"]
    plain = F.col("child.node_type") != "list"
    shown = F.when((F.col("role") == "self_test_answer") & F.col("child.node_type").isin("figure", "media"), "").otherwise(_rendered())
    in_order = lambda c, cond: F.array_join(
        F.transform(
            F.array_sort(F.filter(F.collect_list(F.struct("position", c.alias("t"), cond.alias("c"))), lambda x: x["c"] & (x["t"] != ""))),
            lambda x: x["t"],
        ),
        "\n\n",
    )
    groups = rows.groupBy(*key).agg(
        F.min("position").alias("position"), in_order(shown, F.lit(True)).alias("whole"), in_order(shown, plain).alias("intro")
    )
    prefix = F.when(
        F.col("block_type") == "worked_example", F.concat(F.lit("example-"), _slug("title"))
    ).otherwise(F.concat(F.lit("exercise-"), F.col("block_index").cast("string")))
    locator = lambda suffix: F.concat(prefix, F.lit("-"), suffix)
    seq = lambda item: F.col("group") * 1_000_000 + item  # noqa: E731  introductions first, then items in order

    def named(table: dict, **more: Column) -> dict[str, Column]:
        return {
            "chunk_kind": _choose(table, 0),
            "retrieval_group": _choose(table, 1),
            "part": _choose(table, 2),
            "default_retrieval": _choose(table, 4),
            "title": F.col("title"),
            "locator": locator(_choose(table, 3)),
        } | more

    asked = groups.where(F.col("role").isin("question", "answer"))
    intros = _unit(asked, **named(INTROS, text=F.col("intro"), seq=seq(F.lit(0))))
    part = {
        "part": F.coalesce(_choose(WHOLES, 2), F.lower("heading")), "locator": locator(F.coalesce(_choose(WHOLES, 3), _slug("heading")))
    }
    wholes = _unit(groups.where(~F.col("role").isin("question", "answer")), **named(WHOLES, text=F.col("whole"), seq=seq(F.lit(0)), **part))

    listed = rows.where(F.col("role").isin("question", "answer") & ~plain).select(
        *key, "position", F.posexplode("child.items").alias("place", "item")
    )
    before = Window.partitionBy(*BLOCK, "item.number").orderBy("position", "place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    listed = listed.withColumn("asked", F.last(F.when(F.col("role") == "question", F.col("item.text")), ignorenulls=True).over(before))
    listed = listed.join(asked.select(*BLOCK, "group", "intro"), [*BLOCK, "group"])
    question = F.col("role") == "question"
    number = {"item_index": F.col("item.number"), "locator": F.concat(locator(_choose(ITEMS, 3)), F.col("item.number").cast("string"))}
    items = _unit(
        listed,
        **named(
            ITEMS,
            text=F.col("item.text"),
            seq=seq(1 + F.col("position") * 1000 + F.col("place")),
            paired_text=F.when(~question, F.col("asked")),
            instruction_text=F.when(question, F.col("intro")),
            **number,
        ),
    )

    simple = blocks.where(F.col("block_type").isin(*SIMPLE_GROUPS))
    group = reduce(lambda c, kv: c.when(F.col("block_type") == kv[0], kv[1]), SIMPLE_GROUPS.items(), F)
    simple = _unit(
        simple,
        text=F.col("text"),
        chunk_kind=F.col("block_type"),
        retrieval_group=group,
        seq=F.lit(0),
        default_retrieval=F.lit(True),
        title=F.nullif(text.chunk_text("title"), F.lit("")),
        locator=F.concat_ws("-", F.lit("block"), "block_index", "block_type"),
    )

    found = intros.unionByName(wholes).unionByName(items)
    bare = blocks.where(F.col("block_type").isin(*FALLBACKS)).join(
        found.select("section_id", F.col("block_start").alias("block_index")), ["section_id", "block_index"], "left_anti"
    )
    bare = bare.withColumns(
        {
            "role": F.lit("fallback"),
            "title": F.coalesce(
                F.nullif(text.chunk_text("title"), F.lit("")), *[F.when(F.col("block_type") == k, v) for k, v in TITLES.items()]
            ),
        }
    )
    table = {(k, "fallback"): v for k, v in FALLBACKS.items()}
    bare = _unit(
        bare,
        text=F.col("text"),
        chunk_kind=_choose(table, 0),
        retrieval_group=_choose(table, 1),
        default_retrieval=_choose(table, 2),
        seq=F.lit(0),
        title=F.col("title"),
        locator=prefix,
    )
    return found.unionByName(simple).unionByName(bare)


def attribution_mode(blocks: DataFrame) -> DataFrame:
    """Whether a block stands under a media-attributions heading; only a special block ends that, the heading itself is part."""
    own = Window.partitionBy("section_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.lower(text.chunk_text("text")) == "media attributions"
    marker = F.when(F.col("block_type").isin(SPECIAL), False).when((F.col("block_type") == "heading") & head, True)
    return blocks.withColumn("in_attributions", F.coalesce(F.last(marker, ignorenulls=True).over(own), F.lit(False)))


def ordinary_units(blocks: DataFrame) -> DataFrame:
    """C5 of ordinary blocks: unit rows by block type and attribution mode."""
    b = attribution_mode(blocks).where(~F.col("block_type").isin(SPECIAL))
    by_type = lambda attributed, equation, table, figure: F.when(F.col("in_attributions"), attributed).when(
        F.col("block_type") == "formula_or_equation", equation
    ).when(F.col("block_type") == "table", table).when(F.col("block_type") == "figure", figure).otherwise("theory")
    return _unit(
        b,
        text=F.col("text"),
        chunk_kind=by_type("attribution", "equation_context", "table", "figure_caption"),
        retrieval_group=by_type("attribution", "theory", "reference_table", "figure"),
        seq=F.lit(0),
        default_retrieval=~F.col("in_attributions"),
        locator=F.concat_ws("-", F.lit("block"), "block_index", "block_type"),
    )


def units(blocks: DataFrame) -> DataFrame:
    """The units of all blocks, in the order of block_start and seq."""
    return ordinary_units(blocks).unionByName(special_units(blocks))

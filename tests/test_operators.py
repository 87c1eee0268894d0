"""Helpers and rules on small tables."""

import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunking, compare, evaluation, nearest, pages, registry, retrieval, review, similarity, units
from tessera.sources import io

ROW = "row_id long, combo_id string, combo_title string, combo_kind string, base_combo_id string, active_combo_id string, system_prompt_id string, user_prompt_id string, fewshot_id string, case_id string, question string, model string, experiment_id string, score double, passed boolean, validation_ok boolean, parse_error boolean, duration_seconds double, request_type string, experiment_kind string, created_at string, execution_signature string, tags array<string>"


def _row(i, combo, case, model, score, at, passed=True):
    return (
        i,
        combo,
        combo,
        None,
        combo,
        None,
        "sys_1",
        "usr_1",
        None,
        case,
        "Why?",
        model,
        "exp",
        score,
        passed,
        True,
        False,
        1.0,
        "explain",
        "none",
        at,
        "sig",
        ["a"],
    )


@pytest.fixture
def workspace(spark):
    return spark.createDataFrame(
        [
            _row(1, "A", "intro", "phi4-mini", 1.0, "2026-06-25T12:00:01"),
            _row(2, "B", "intro", "gemma4:12b", 0.8, "2026-06-25T12:00:02"),
            _row(3, "B", "followup", "phi4-mini", 0.9, "2026-06-25T12:00:03"),
        ],
        ROW,
    )


def test_prompt_performance(workspace):
    rows = review.prompt_rows(workspace, "sys_1")
    combos = {r["combo_id"]: r for r in review.prompt_combo_performance(rows).collect()}
    assert (combos["A"]["average_score"], combos["A"]["best_model"]) == (1.0, "phi4-mini")
    assert (combos["B"]["average_score"], combos["B"]["run_count"]) == (0.85, 2)
    models = {r["model"]: r for r in review.prompt_model_performance(rows).collect()}
    assert (models["phi4-mini"]["average_score"], models["phi4-mini"]["best_combo_id"]) == (0.95, "A")
    assert review.prompt_usage_summary(rows).first()["latest_run_at"] == "2026-06-25T12:00:03"
    assert review.prompt_rows(workspace, "unused").isEmpty()


def test_metrics_and_zero_scores(spark):
    rows = spark.createDataFrame([_row(1, "b", "c", "m", 0.95, "1"), _row(2, "a", "c", "m", 1.0, "2")], ROW)
    m = review.metrics(rows).first()
    assert (m["combo_count"], m["case_count"], m["average_score"], m["pass_rate"]) == (2, 1, 0.975, 1.0)
    s = review.score_summary(rows).first()
    assert (s["min_score"], s["max_score"], s["average_score"]) == (0.95, 1.0, 0.975)
    # A zero score counts like none, so the first row in order wins.
    tied = spark.createDataFrame([_row(1, "b", "c", "m", 0.0, "1"), _row(2, "a", "c", "m", None, "2")], ROW)
    assert review.case_summary(tied).first()["best_combo_id"] == "a"


def test_speed_scores(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "combo_id string, average_duration_seconds double")
    assert {r["combo_id"]: r["speed_score"] for r in review.speed_scores(s).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}
    same = spark.createDataFrame([("a", 1.0), ("c", None)], "combo_id string, average_duration_seconds double")
    assert {r["speed_score"] for r in review.speed_scores(same).collect()} == {1.0}


def test_review_text(spark):
    def f(value):
        return spark.createDataFrame([(value,)], "t string").select(text.review_text("t")).first()[0]

    assert f(None) == ""
    assert f("  a \t b  \r\nc\r\r\r\r\nd ") == "a b\nc\n\nd"


def test_keywords_and_scripts(spark):
    one = spark.createDataFrame([(" A, b,a ,,B,c", "10", "n+1")], "t string, d string, x string")
    r = one.select(
        text.tag_list("t").alias("t"), text.unicode_script("d", False).alias("d"), text.unicode_script("x", True).alias("x")
    ).first()
    assert (r["t"], r["d"], r["x"]) == (["A", "b", "c"], "₁₀", "ⁿ⁺¹")


@pytest.mark.parametrize(("answer", "hit"), [("10% acid", False), ("use 0.1m now", True), ("10 mol/l", True), ("ten percent", False)])
def test_concentration(spark, answer, hit):
    a = spark.createDataFrame(
        [("c", (answer, "x", ("none", )))],
        "case_id string, answer struct<short_answer:string,request_type:string,experiment:struct<kind:string>>",
    )
    c = spark.createDataFrame(
        [("c", None, None, True)],
        "case_id string, expected_request_type array<string>, expected_experiment_kind array<string>, forbid_concentration_patterns boolean",
    )
    none = spark.createDataFrame([], "case_id string, phrase string")
    assert evaluation.score_answers(a, c, none).first()["passed"] is not hit


def test_missing_answer(spark):
    a = spark.createDataFrame(
        [("c", None)], "case_id string, answer struct<short_answer:string,request_type:string,experiment:struct<kind:string>>"
    )
    c = spark.createDataFrame(
        [("c", ["x"], ["none"], True)],
        "case_id string, expected_request_type array<string>, expected_experiment_kind array<string>, forbid_concentration_patterns boolean",
    )
    p = spark.createDataFrame([("c", "bad")], "case_id string, phrase string")
    r = evaluation.score_answers(a, c, p).first()
    assert (r["passed_count"], r["total_count"], r["score"]) == (1, 5, 0.2)
    assert evaluation.failed_checks(
        evaluation.score_answers(a, c, p)
    ).first()["failed_checks"] == "parse_ok, request_type, experiment_kind, forbidden_phrases"


def test_plan(spark, workspace):
    cases = spark.createDataFrame([("intro",), ("other",)], "case_id string")
    combos = workspace.select("combo_id").distinct()
    missing = evaluation.plan_runs(combos, cases, workspace, "missing", "sig")
    assert missing.count() == 4
    assert missing.where("should_run").count() == 2
    assert evaluation.plan_runs(combos, cases, workspace, "failed", "sig").where("should_run").count() == 0
    with pytest.raises(ValueError, match="unknown mode"):
        evaluation.plan_runs(combos, cases, workspace, "some", "sig")
    with pytest.raises(ValueError, match="twice"):
        evaluation.require_unique(cases.union(cases), "case_id")


def test_diff_and_alignment(spark):
    left, right = "One two three.\n\nFour five.", "One two four.\n\nFour five. Six."
    d = spark.createDataFrame([(left, right), ("", ""), ("x", "")], "a string, b string")
    r = d.select(
        compare.text_similarity(F.col("a"), F.col("b")).alias("s"),
        compare.unified_diff(F.col("a"), F.col("b")).alias("d"),
        compare.alignment(F.col("a"), F.col("b"), "sentence").alias("o"),
    ).collect()
    assert r[0]["s"] == difflib.SequenceMatcher(None, left, right, autojunk=False).ratio()
    assert (r[1]["s"], r[2]["s"], r[1]["d"]) == (1.0, 0.0, "")
    assert r[0]["d"].startswith("--- baseline\n+++ challenger")
    assert max(o["left_end"] for o in r[0]["o"]) >= 2


def test_split_long(spark):
    body = " ".join(f"Word{i} is here." if i % 9 else f"Word{i}\n\n" for i in range(2000))
    c = chunking.Config()
    got = spark.createDataFrame(
        [(body, ), ("short", ), ("x" * 7000, ), (None, )], "t string"
    ).select(chunking.split_long(F.col("t")).alias("p")).collect()
    assert got[1]["p"] == ["short"]
    assert all(len(p) <= c.most for r in got for p in r["p"])
    joined = " ".join(got[0]["p"])
    assert all(f"Word{i}" in joined for i in range(2000))
    assert sum(len(p) for p in got[2]["p"]) >= 7000


def test_merge_units_covers_text(spark):
    rows = [
        (
            1,
            i,
            i,
            0,
            "paragraph" if i % 2 else "heading",
            f"block-{i}",
            "t" * 700,
            "theory" if i != 4 else "table",
            "theory" if i != 4 else "table",
            None,
            None,
            None,
            None,
            None,
            True,
        )
        for i in range(8)
    ]
    u = spark.createDataFrame(
        rows,
        "section_id long, block_start long, block_end long, seq long, block_type string, locator string, text string, chunk_kind string, retrieval_group string, title string, part string, item_index int, paired_text string, instruction_text string, default_retrieval boolean",
    )
    m = chunking.merge_units(u).orderBy("block_start").collect()
    assert [(r["block_start"], r["block_end"]) for r in m] == [(0, 1), (2, 3), (4, 4), (5, 6), (7, 7)]
    assert [r["locator"] for r in m][2] == "block-4"
    assert m[0]["block_type"] == "mixed"


def _page(spark, *html):
    return pages.parse_nodes(
        spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    )


def test_html(spark):
    html = '<html><body><h1>Title</h1><p>One <b>two<p>three &amp; four <a href="/x">link</a></p><nav><ul><li>menu</li></ul></nav><script>var p="<p>";</script><ol start="7"><li>item</li></ol><img src="a.png" alt="A"></body>'
    nodes = _page(spark, html, None)
    blocks = [(r["block_type"], r["text"]) for r in pages.blocks(nodes).orderBy("block_index").collect()]
    assert blocks[:4] == [("heading", "Title"), ("paragraph", "One two"), ("paragraph", "three & four link"), ("list", "7. item")]
    assert not any("menu" in x or "var p" in x for _, x in blocks)
    assert [(r["href"], r["text"]) for r in pages.links(nodes).collect()] == [("/x", "link")]
    assert pages.media(nodes).first()["alt"] == "A"


BOOK_PAGE = """<html><head><meta name="pb-title" content="A  Book"><meta name="pb-authors" content="X"><meta name="pb-authors" content="Y"><meta name="pb-language" content="fr"></head><body>
<div class="part"><h1 class="part-title">Acids</h1></div>
<div class="chapter" id="c1" title="One"><div class="chapter-ugc">
<p>Water is H<sub>2</sub>O, x<sup>n</sup>.<br>Next <img class="quicklatex" alt="a+b" src="f.png"> and <img class="quicklatex" alt="a+b" src="f.png"></p>
<div class="textbox textbox--examples"><div class="textbox__header"><p class="textbox__title">Example 4.1</p></div><div class="textbox__content">
<h1>Problems</h1><p>Balance each.</p><ol start="3"><li>first</li><li>second<p>with more</p><ul><li>deep</li></ul></li></ol><h1>Solutions</h1><ol start="3"><li>done first</li><li>done second</li></ol>
<h1>Test Yourself</h1><p>Try.</p><h1>Answer</h1><p>Yes.</p></div></div>
<table><caption>Sizes</caption><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>
<div class="wp-caption"><img src="i.png" alt="pic" width="5"><div class="wp-caption-text">A picture</div></div>
<h2>Media Attributions</h2><p>credit</p>
</div></div><div class="chapter"><div class="chapter-ugc"><p>Second section.</p></div></div></body></html>"""


def test_structure_of_a_book_page(spark):
    nodes = _page(spark, BOOK_PAGE).cache()
    blocks = pages.blocks(nodes).where("section_index = 1").orderBy("block_index").collect()
    assert [r["block_type"] for r in blocks] == ["formula_or_equation", "worked_example", "table", "figure", "heading", "paragraph"]
    assert blocks[0]["text"] == "Water is H₂O, xⁿ.\nNext [FORMULA: a+b] and [FORMULA: a+b]"
    assert blocks[1][
        "text"
    ] == "Example 4.1\n\nProblems\n\nBalance each.\n\n3. first\n4. second\n   with more\n   - deep\n\nSolutions\n\n3. done first\n4. done second\n\nTest Yourself\n\nTry.\n\nAnswer\n\nYes."
    assert blocks[2]["text"] == "Table: Sizes\na | b\n1 | 2"
    assert (blocks[1]["title"], blocks[4]["heading_level"]) == ("Example 4.1", 2)
    assert [
        (r["kind"], r["value"]) for r in pages.formulae(nodes).orderBy("formula_index").collect()
    ] == [("latex_image", "a+b"), ("subscript", "2"), ("superscript", "n")]
    assert [(r["src"], r["alt"], r["caption"], r["width"]) for r in pages.media(nodes).collect()] == [("i.png", "pic", "A picture", "5")]
    assert [(r["caption"], r["rows"]) for r in pages.tables(nodes).collect()] == [("Sizes", [["a", "b"], ["1", "2"]])]
    book = pages.books(nodes).first()
    assert (
        book["book_title"], book["language"], book["authors"], book["chapter_title"], book["section_count"]
    ) == ("A Book", "fr", ["X", "Y"], "Acids", 2)
    marked = pages.markdown(nodes).where("section_index = 1").first()["markdown"]
    assert "### Block 2: `worked_example`\n\n**Example 4.1**\n\n#### Problems\n\nBalance each.\n\n3. first" in marked and "**Table:** Sizes\na | b" in marked
    audit = pages.structure_audit(nodes).collect()
    assert {r["name"] for r in audit} == {
        "Example 4.1", "Problems", "Solutions", "Test Yourself", "Answer"
    } and not any(r["missing"] for r in audit)
    s = {
        r["section_index"]: r
        for r in pages.sections(
            nodes, spark.createDataFrame([(0, "http://h/0", BOOK_PAGE)], "page_id long, url string, html string")
        ).collect()
    }
    assert (s[1]["formula_count"], s[1]["media_count"], s[1]["table_count"], s[1]["block_type_counts"]["worked_example"]) == (3, 1, 1, 1)
    assert s[2]["text"] == "Second section."


def test_units_of_a_book_page(spark):
    """From HTML to units: problems and solutions are paired by number, self-tests and attributions are left out of retrieval."""
    b = pages.blocks(_page(spark, BOOK_PAGE)).where("section_index = 1").withColumn("section_id", F.col("page_id"))
    got = {r["locator"]: r for r in units.units(b).collect()}
    kinds = {k: r["chunk_kind"] for k, r in got.items()}
    assert kinds == {
        "block-1-formula_or_equation": "equation_context",
        "example-example-4-1-problems-intro": "worked_example_problem_intro",
        "example-example-4-1-problem-3": "worked_example_problem",
        "example-example-4-1-problem-4": "worked_example_problem",
        "example-example-4-1-solution-3": "worked_example_solution",
        "example-example-4-1-solution-4": "worked_example_solution",
        "example-example-4-1-self-test": "self_test_question",
        "example-example-4-1-self-test-answer": "self_test_answer",
        "block-3-table": "table",
        "block-4-figure": "figure_caption",
        "block-5-heading": "attribution",
        "block-6-paragraph": "attribution",
    }
    assert got[
        "example-example-4-1-solution-3"
    ]["paired_text"] == "first" and got["example-example-4-1-problem-3"]["instruction_text"] == "Balance each."
    assert {k for k, r in got.items() if not r["default_retrieval"]} == {
        "example-example-4-1-self-test", "example-example-4-1-self-test-answer", "block-5-heading", "block-6-paragraph"
    }


def test_pages_with_odd_html(spark):
    nodes = _page(
        spark, "", "just text", "<p>", "<ul><li>a<li>b</ul>", "<table><tr><td>x</table><div><div><p>deep", '<ol start="x9"><li>y</ol>'
    ).cache()
    got = {(r["page_id"], r["block_index"]): r["text"] for r in pages.blocks(nodes).collect()}
    assert got[3, 1] == "- a\n- b" and got[4, 1] == "x" and got[4, 2] == "deep" and got[5, 1] == "9. y"
    assert pages.markdown(nodes).count() > 0 and pages.structure_audit(nodes).count() == 0


def test_pages_of_any_depth(spark):
    n = 100_000
    rows = _page(spark, "<div>" * n + "deep <sup>2<b>n</b></sup>", "<p>" + "<b>" * n + "x", "<ul><li>" * 500 + "low").groupBy("page_id").agg(
        F.count("*").alias("n"), F.max_by("shown", F.col("shown").isNotNull()).alias("shown")
    )
    got = {r["page_id"]: (r["n"], r["shown"]) for r in rows.collect()}
    assert got[0] == (n + 2, "deep ²ⁿ") and got[1] == (n + 1, "x") and got[2][0] == 1000


def test_scripts_in_pages(spark):
    nodes = _page(spark, "<p>x<sup>n</sup> y<sup>2n</sup> z<sup>1 2</sup> w<sub>n</sub> v<sup> a </sup>u<sup></sup></p>")
    assert nodes.where("tag = 'p'").first()["shown"] == "xⁿ y²ⁿ z¹ ² w_(n) v^( a )u"


def test_given_pages_against_the_parser(spark):
    """Every tag of every given page is a node, and every word of an article's paragraphs stands in the blocks, in order."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.words, self.tags = False, [], []

        def handle_starttag(self, tag, attrs):
            self.tags.append(tag)
            self.inside |= tag == "article"

        def handle_endtag(self, tag):
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.words += data.split()

    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    nodes = pages.parse_nodes(p).cache()
    tags = {
        r["page_id"]: r["t"]
        for r in nodes.groupBy("page_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "tag"))), lambda x: x["tag"]).alias("t")
        ).collect()
    }
    texts = {}
    for r in pages.blocks(nodes).orderBy("page_id", "block_index").collect():
        texts.setdefault(r["page_id"], []).append(r["text"])
    for r in p.collect():
        w = Words()
        w.feed(r["html"] or "")
        w.close()
        assert tags.get(r["page_id"], []) == w.tags
        if w.words and "article" in w.tags:
            assert " ".join(texts[r["page_id"]]).split() == w.words


def test_list_starts(spark):
    d = spark.createDataFrame(
        [("7", ), ('7""', ), ("x12", ), ("x", ), (None, )], "v string"
    ).select(chunking.repair_list_start(F.col("v")).alias("r")).select("r.*").collect()
    assert [r["value"] for r in d] == [7, 7, 12, 1, 1]
    assert [r["method"] for r in d] == [None, "trim_surrounding_quotes", "extract_first_integer", "fallback_to_one", None]


def test_pack_context_keeps_budget(spark):
    hits = spark.createDataFrame(
        [(1, i, f"[S{i}]", "y" * n) for i, n in ((1, 300), (2, 400), (3, 5), (4, 50))],
        "query_id long, rank int, header string, text string",
    )
    packed = retrieval.pack_context(hits, 700)
    context = retrieval.contexts(hits.select("query_id").distinct(), hits, packed).first()["context"]
    assert context.startswith("[S1]\ntext:\n")
    assert len(context) <= 700 + len(retrieval.TRUNCATED)
    assert context.endswith("[truncated]")
    assert retrieval.contexts(
        hits.select("query_id").distinct(), hits, retrieval.pack_context(hits, 50)
    ).first()["context"] == retrieval.TOO_SMALL


def test_history(spark):
    t = spark.createDataFrame(
        [
            (1, 0, "assistant"),
            (1, 1, "user"),
            (2, 0, "user"),
            (2, 1, "assistant"),
            (2, 2, "user"),
            (3, 0, "user"),
            (3, 1, "assistant"),
            (3, 2, "assistant"),
        ],
        "conv_id long, turn long, role string",
    )
    got = sorted((r["conv_id"], r["turn"]) for r in retrieval.trim_history(t, 2).collect())
    assert got == [(1, 0), (1, 1), (2, 2)]


def test_lineage_and_cycles(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "id long, parent_id long")
    got = {r["id"]: r for r in registry.lineage(n).collect()}
    assert got[149]["depth"] == 149
    assert got[3]["lineage_ids"] == [0, 1, 2, 3]
    orphan = spark.createDataFrame([(5, 99)], "id long, parent_id long")
    assert registry.lineage(orphan).first()["depth"] == 0


def test_skewed_pairs_match_plain_product(spark):
    vectors = spark.createDataFrame(
        [(i, "g" if i < 40 else "h", [float((i * k) % 7 - 3) for k in range(1, 5)]) for i in range(60)],
        "item_id long, group_id string, vector array<double>",
    )
    got = {(r[0], r[1]): r[2] for r in similarity.pairs(vectors, tile=8).collect()}
    rows = vectors.collect()
    want = {
        (a[0], b[0]): round(sum(x * y for x, y in zip(a[2], b[2], strict=True)), 6) for a in rows for b in rows
        if a[0] < b[0] and a[1] == b[1]
    }
    assert got == want


def test_sources(spark, tmp_path):
    (tmp_path / "book" / "a").mkdir(parents=True)
    (tmp_path / "book" / "a" / "sections.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert io.read_sections(spark, str(tmp_path / "book"), "id int").count() == 2
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        io.read_sections(spark, str(tmp_path / "none"), "id int")
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id int").collect()
    (tmp_path / "runs" / "s").mkdir(parents=True)
    (tmp_path / "runs" / "s" / "a.json").write_text('{"id": "r1",\n "combo_id": "c"}')
    (tmp_path / "runs" / "s" / "b.json").write_text('{"id": ')
    schema = spark.createDataFrame([], "id string, combo_id string, case_id string, execution struct<signature:string>").schema
    got = io.read_scope(spark, str(tmp_path / "runs"), "s", schema, combo_ids=["c"]).collect()
    assert [r["id"] for r in got] == ["r1"]
    assert got[0]["file_path"].endswith("a.json")
    rows = spark.createDataFrame([(1, None, ["x"])], "a int, b string, c array<string>")
    io.write_csv(review.csv_ready(rows), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).first()["a"] == "1"
    similarity.write_bundle(
        spark.createDataFrame([(1, 2, 0.5)], "left_item_id int, right_item_id int, similarity double"),
        str(tmp_path / "sim"),
        scope="s",
        dims=256,
    )
    assert similarity.read_bundle(spark, str(tmp_path / "sim"), scope="s", dims=256).count() == 1


def test_generate_combos_above_a_million(spark):
    pools = {"system": spark.range(1001), "user": spark.range(1000)}
    none = spark.createDataFrame([], "prompt_ids map<string,long>")
    assert registry.generate_combos(pools, none).count() == 1_001_000
    with pytest.raises(ValueError):
        registry.generate_combos(pools, none, limit=1_000_000)


def test_nearest_of_many_selected(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(similarity.TILE + 6, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "item_id long, vector array<double>")
    got = {(r["selected_id"], r["rank"]): r["similarity"] for r in similarity.nearest(d, d, k=2).collect()}
    m = v @ v.T
    np.fill_diagonal(m, -2)
    best = -np.sort(-m, axis=1)
    assert len(got) == 2 * len(v)
    assert all(got[i, k + 1] == pytest.approx(best[i, k], abs=1e-6) for i in range(len(v)) for k in (0, 1))


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_knn_in_passes(spark, metric, monkeypatch):
    """The same neighbours in one pass and in many, with ties, repeated chunks and small batches."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 4)), 1)
    chunks = spark.createDataFrame([(i, v[i % 250].tolist()) for i in range(300)], "chunk_id long, vector array<double>").repartition(7)
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 40, 2)], "query_id long, vector array<double>")
    want = {}
    for i in range(0, 40, 2):
        d = ((v - v[i]) ** 2).sum(1) if metric == "l2sq" else 1 - v @ v[i] / np.maximum(
            np.linalg.norm(v, axis=1) * np.linalg.norm(v[i]), 1e-300
        )
        own = sorted((max(round(float(d[c % 250]), 6), 0.0), c) for c in range(300))[:5]
        want.update({(i, r): c for r, (_, c) in enumerate(own, 1)})
    for block, size in ((512, 64 << 20), (3, 100)):
        monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
        monkeypatch.setattr(nearest, "QUERY_BYTES", size)
        assert {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.knn(queries, chunks, 5, metric).collect()} == want


def test_headings_keep_ampersands_that_begin_no_reference(spark):
    """c1_headings: text that was cut inside a reference stays as it is, in headings, attributes and scripts; whole references are read."""
    html = '<article><h1>A&amp;B &lt;C&gt; &#65;&#x42; R&D &&amp &am &ampx; &copy 2</h1><a href="?a=1&copy=2&amp;b=3">l</a><script>a && b &amp; c</script></article>'
    rows = pages.parse_nodes(spark.createDataFrame([(1, html), (2, "<h1>x &amp")], "page_id long, html string")).collect()
    found = {(r["page_id"], r["tag"]): r for r in rows}
    assert found[1, "h1"]["shown"] == found[1, "h1"]["own_text"] == "A&B <C> AB R&D &&amp &am &ampx; &copy 2"
    assert found[1, "a"]["href"] == "?a=1&copy=2&b=3" and found[1, "script"]["own_text"] == "a && b &amp; c"
    assert found[2, "h1"]["shown"] == "x &amp"


def test_similarity_text_of_blank_texts(spark):
    """the text loses white space at its end; the heading line above a blank one stays, as in the query's SQL."""
    nodes = spark.createDataFrame(
        [(1, "T", "a", "b", "main", ["live"], t) for t in (None, "", " \n\t", "x \n", " y ")],
        "id long, title string, type string, tree_id string, branch string, tags array<string>, text string",
    )
    got = [tuple(r) for r in nodes.select(registry.similarity_text("title"), registry.similarity_text("metadata")).collect()]
    ends = ["", "", "", "x", " y"]
    assert got == [(f"TITLE\nT\n\nPROMPT\n{e}", f"METADATA\nid=1\ntitle=T\ntype=a\ntree_id=b\nbranch=main\ntags=live\n\nPROMPT\n{e}") for e in ends]


def test_page_titles_cut_inside_a_reference(spark):
    """c3_books: the page title keeps what is left of a reference."""
    html = "<html><head><title>Für&amp;&amp;&amp der &quo</title></head><body><p>x</p></body></html>"
    nodes = pages.parse_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert pages.books(nodes).first()["page_title"] == "Für&&&amp der &quo"


def test_combo_details_make_the_usage_once(spark):
    """The usage is read for members, experiments, derived combos and their summaries, but made once."""
    members = "members array<struct<role:string,prompt_id:long,prompt_title:string>>"
    usage = spark.createDataFrame(
        [("a", [("user", 1, "x")], [7], ["b"], "draft", 2, False), ("b", [], [], [], "draft", 0, True)],
        f"combo_id string, {members}, experiment_ids array<long>, derived_combo_ids array<string>, status string, run_count long, is_archived boolean",
    ).coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    prompts = spark.createDataFrame([(1, "x", "t", 0, 1, 1, 0, False)], "id long, title string, type string, child_count int, combo_count int, experiment_count int, depth int, is_archived boolean")
    counts = ", ".join(f"{c}_count int" for c in ("combo", "tested_combo", "untested_combo", "missing_combo", "run"))
    experiments = spark.createDataFrame([(7, 1, 0, 1, 0, 0, False)], f"experiment_id long, {counts}, is_archived boolean")
    rows = registry.combo_details(usage.mapInArrow(count, usage.schema), prompts, experiments).collect()
    assert sorted((r["combo_id"], r["part"], r["key"]) for r in rows) == [("a", "derived", "b"), ("a", "experiment", "7"), ("a", "prompt", "1")]
    assert seen.value == 2

"""Text ratios, diffs and alignments of all compared answers, against the standard library; a pair with known differences."""

import difflib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import compare, evaluation, matching
from tests.test_oracles import SF


def _rows(spark, name):
    return plans.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def texts(spark):
    from tessera.plans.analysis_queries import _compared

    return {(r["case_id"], r["challenger_combo_id"]): (r["baseline_text"], r["challenger_text"]) for r in _compared(spark, SF).collect()}


def test_ratios(spark, texts):
    got = {(r["case_id"], r["challenger_combo_id"]): r["ratio"] for r in _rows(spark, "e9_text_ratio")}
    assert got.keys() == texts.keys()
    for k, (a, b) in texts.items():
        assert got[k] == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), abs=5.1e-5)
    assert {(r["case_id"], r["challenger_combo_id"]): r["full_text_similarity"] for r in _rows(spark, "j1_text_similarity")} == got


def test_average_ratios(spark, texts):
    got = {r["challenger_combo_id"]: r["average_text_similarity"] for r in _rows(spark, "a6_text_similarity")}
    for combo, mean in got.items():
        own = [round(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 4) for (_, c), (a, b) in texts.items() if c == combo]
        assert mean == pytest.approx(sum(own) / len(own), abs=1.1e-4)


def test_field_ratios(spark):
    for r in _rows(spark, "j2_field_similarity"):
        a, b = r["left_text"], r["right_text"]
        matched = r["field_path"] in compare.TEXT_FIELDS + compare.LIST_FIELDS
        want = (
            1.0 if a == b else 0.0 if not a or not b else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        ) if matched else float(a == b)
        assert r["similarity"] == pytest.approx(want, abs=5.1e-5)


def test_diffs(spark, texts):
    got = {(r["case_id"], r["challenger_combo_id"]): r["diff"] for r in _rows(spark, "e10_unified_diff")}
    for k, (a, b) in texts.items():
        assert got[k] == "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), "baseline", "challenger", lineterm=""))
    assert any(d.startswith("--- baseline\n+++ challenger") for d in got.values())


def test_alignments(spark, texts):
    got = {}
    for r in _rows(spark, "e11_alignment"):
        got.setdefault((r["case_id"], r["challenger_combo_id"]), []).append(
            tuple(r[c] for c in ("tag", "left_start", "left_end", "right_start", "right_end"))
        )
    cut = lambda t: [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])", t) if s.strip()]
    for k, (a, b) in texts.items():
        assert sorted(got[k]) == sorted(difflib.SequenceMatcher(None, cut(a), cut(b), autojunk=False).get_opcodes())


ANSWER = ("mixed", "short", "long", ["e"], "high", ["S1"], ("none", "why", None, None, None, None, None, None, None, None, None, None))


def test_changed_fields_of_a_pair(spark):
    """Answers that differ in short answer, explanation and sources: exactly these are named."""
    first = ("mixed", "short", "long", ["e"], "high", ["S1"], ANSWER[6])
    second = ("mixed", "shorter", "longer text", ["e"], "high", ["S1", "S2"], ANSWER[6])
    d = spark.createDataFrame(
        [(i, c, a, a[5]) for i, (c, a) in enumerate((("one", first), ("two", second)))],
        f"id long, combo_id string, parsed_answer {evaluation.ANSWER}, source_ids array<string>",
    )
    d = d.withColumns({"request_type": F.col("parsed_answer.request_type"), "experiment_kind": F.col("parsed_answer.experiment.kind")})
    side = lambda c, n: d.where(F.col("combo_id") == c).select(
        F.struct(F.struct(*[compare.field_value(f).alias(f.replace(".", "__")) for f in compare.FIELDS]).alias("fields")).alias(n)
    )
    pair = side("one", "left").join(side("two", "right"), F.lit(True))
    assert compare.compare_fields(pair).first()["changed_fields"] == ["short_answer", "explanation", "source_ids"]
    rows = {r["field_path"]: r for r in compare.field_comparisons(pair).collect()}
    assert len(rows) == 9 and (rows["source_ids"]["left_count"], rows["source_ids"]["right_count"]) == (1, 2)
    assert rows["request_type"]["similarity"] == 1.0 and 0 < rows["explanation"]["similarity"] < 1


def test_answer_rules(spark):
    plan = (
        "experiment", None, None, "t", "g", [("salt", None, "1 g", True, None, "p")], ["cup"], ["gloves"], ["stir"], ["care"], "sink", True
    )
    answers = [
        ANSWER,
        None,
        ("odd", "", None, ["a", "b", "c"], "sure", list("abcdef"), ("clarification", "", ["1", "2", "3", "4"], *[None] * 9)),
        (*ANSWER[:6], plan),
        (*ANSWER[:6], ("experiment", *[None] * 11)),
        (*ANSWER[:6], None),
    ]
    d = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], f"id int, answer {evaluation.ANSWER}")
    got = {r["id"]: r["broken_rules"] for r in evaluation.validate_answers(d).collect()}
    assert got[0] == [] and got[1] == ["missing"] and got[5] == ["experiment.kind"]
    assert got[2] == [
        "request_type", "short_answer", "explanation", "examples", "certainty", "source_ids", "experiment.questions", "experiment.reason"
    ]
    assert got[3] == ["experiment.ingredients.concentration"]
    assert got[4] == [
        f"experiment.{f}"
        for f in (
            "title",
            "goal",
            "disposal",
            "ingredients",
            "equipment",
            "protective_equipment",
            "steps",
            "safety_notes",
            "adult_supervision_required",
        )
    ]


def test_matching_blocks_of_any_texts():
    """The same blocks as the standard library, ties included, on random, repetitive and similar texts."""
    rng = random.Random(4)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(some(letters, rng.randint(0, 300)), some(letters, rng.randint(0, 300))) for letters in ("a", "ab", "abc ", "abcdefgh é日") for _ in range(40)]
    pairs += [("ab" * 300, "ba" * 300), ("a" * 500, "a" * 499 + "b"), ("", "x"), ("", ""), ("abc" * 100 + "x" + "abc" * 100, "abc" * 150)]
    for _ in range(20):
        a = some("abcdefghij ", 600)
        b = list(a)
        for _ in range(rng.randint(1, 30)):
            b[rng.randrange(len(b))] = rng.choice(["", "z", "yy", "a"])
        pairs.append((a, "".join(b)))
    for a, b in pairs:
        own = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert matching.ratio(a, b) == own.ratio()
        if a and b:
            m = own.find_longest_match(0, len(a), 0, len(b))
            assert matching.longest_block(a, b) == (m.a, m.b, m.size) or m.size == 0


def test_matching_of_long_texts_takes_seconds():
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(100_000))
    b = list(a)
    for i in rng.sample(range(len(b)), 300):
        b[i] = "#"
    start = time.monotonic()
    assert matching.matched(a, "".join(b)) == len(a) - 300
    assert matching.matched("ab" * 50_000, "ab" * 49_999 + "b") == 99_999
    assert time.monotonic() - start < 60

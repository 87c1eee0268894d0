"""Similarity joins and nearest neighbours by pivots, phrases by automaton, merged units, token hashes: against brute force."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, evaluation, nearest, phrases, registry, retrieval, review, rollup, similarity, textindex
from tessera.sources import io
from tessera.sources.adapters import artifacts


def _clustered(rng, n, size=16, centres=20, spread=0.05):
    c = rng.normal(0, 1, (centres, size))
    x = c[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


def _table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, group_id string, vector array<double>")


@pytest.fixture(scope="module")
def vectors(spark):
    """A large group of clusters with copies and zeros, a small group, items without a group or a vector."""
    rng = np.random.default_rng(5)
    x = _clustered(rng, 900)
    x[100:160] = x[100]
    rows = [(i, "large", v.tolist()) for i, v in enumerate(x)] + [(2000 + i, "small", v.tolist()) for i, v in enumerate(x[::31])]
    rows += [(3000 + i, None, v.tolist()) for i, v in enumerate(x[:5])] + [(4000, "large", [0.0] * 16), (4001, "large", [0.0] * 16), (4002, "large", None)]
    return _table(spark, rows), rows


def _every(rows, threshold, same_group=True):
    own = [r for r in rows if r[2] is not None]
    m = np.round(np.array([r[2] for r in own]) @ np.array([r[2] for r in own]).T, 6)
    ids, groups = np.array([r[0] for r in own]), np.array([r[1] or "" for r in own])
    ok = (m >= threshold) & (ids[:, None] < ids[None]) & ((groups[:, None] == groups[None]) | (not same_group))
    return {(int(ids[i]), int(ids[j])): m[i, j] for i, j in zip(*np.nonzero(ok), strict=True)}


def _same(found, wanted):
    got = {(r[0], r[1]): r[2] for r in found.select("left_item_id", "right_item_id", "similarity").collect()}
    return got.keys() == wanted.keys() and all(abs(got[k] - v) < 2e-6 for k, v in wanted.items())


@pytest.mark.parametrize("same_group", [True, False])
@pytest.mark.parametrize("threshold", [0.97, 0.5, -0.2])
def test_pairs_by_pivots(vectors, same_group, threshold):
    v, rows = vectors
    wanted = _every(rows, threshold, same_group)
    assert _same(similarity.pairs(v, same_group=same_group, threshold=threshold, tile=32), wanted)
    assert _same(similarity.pairs(v, same_group=same_group, threshold=threshold), wanted)


def test_pivots_skip_most_of_the_work(spark):
    """Of clustered vectors, most products are left out; four times the vectors leave out as large a share."""
    rng = np.random.default_rng(1)
    shares = []
    for n in (1500, 6000):
        x = _clustered(rng, n, centres=25)
        v = _table(spark, [(i, "g", r.tolist()) for i, r in enumerate(x)])
        r = similarity.skipped_cells(v, threshold=0.9, tile=64).first()
        assert r["items"] == n and r["pairs"] == n * (n - 1) // 2
        shares.append(r["skipped"] / r["pairs"])
    assert shares[1] > shares[0] > 0.5 and shares[1] > 0.8


def test_bundle_written_twice(spark, vectors, tmp_path):
    path, rows = f"file://{tmp_path}/pairs", [(1, 2, 0.5), (1, 3, 0.9)]
    p = spark.createDataFrame(rows, "left_item_id long, right_item_id long, similarity double")
    similarity.write_bundle(p, path, backend="a", threshold="0.5")
    similarity.write_bundle(p.limit(1), path, backend="b", threshold="0.5")
    names = lambda k: {f.name for f in (tmp_path / "pairs" / f"backend={k}").rglob("*.parquet")}
    before = names("b")
    similarity.write_bundle(p, path, backend="a", threshold="0.5")
    assert names("b") == before
    assert sorted(map(tuple, similarity.read_bundle(spark, path, backend="a", threshold="0.5").collect())) == rows


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "dot"])
def test_neighbours_by_cells(spark, metric):
    """More queries than are sent to tasks, by cells of some forty chunks: the same as brute force, ties and zeros included."""
    rng = np.random.default_rng(11)
    x = _clustered(rng, 1200, size=8) * rng.uniform(0.5, 2.0, (1200, 1))
    x[200:260] = x[200]
    x[300:303] = 0.0
    q = np.concatenate([x[:150], rng.normal(0, 1, (100, 8)), np.zeros((1, 8))])
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    d = nearest._distances(q, x, metric)
    wanted = {(i, int(c)) for i in range(len(q)) for c in np.lexsort((np.arange(len(x)), d[i]))[:12]}
    for options in ({"send_bytes": 0, "cell": 40}, {}):
        got = nearest.top_k(queries, chunks, 12, metric, **options).collect()
        odd = {(r["query_id"], r["chunk_id"]) for r in got} ^ wanted
        # Distances that differ by rounding only may change places.
        assert len(got) == len(wanted) and all(abs(d[i, c] - np.sort(d[i])[11]) < 2e-6 for i, c in odd)
        assert all(abs(r["distance"] - d[r["query_id"], r["chunk_id"]]) < 2e-6 for r in got)
    few = nearest.top_k(queries, chunks.limit(5), 12, metric, send_bytes=0)
    assert few.count() == 5 * len(q)
    assert nearest.top_k(queries, chunks.limit(0), 12, metric, send_bytes=0).count() == 0
    assert nearest.top_k(queries.limit(0), chunks, 12, metric).count() == 0


def test_cells_rule_most_of_the_chunks_out(spark):
    rng = np.random.default_rng(12)
    x = _clustered(rng, 4000, size=8, centres=80, spread=0.02)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    dealt, pivots, stats = nearest.cell_table(chunks, "l2sq", 40)
    cells, counts, radius, longest = (np.array(c) for c in zip(*stats, strict=True))
    d = np.sqrt(np.sort(nearest._distances(x[:200], x, "l2sq"), axis=1)[:, 4])
    open_ = nearest._least(x[:200], pivots, cells, radius, longest, "l2sq") <= (d**2)[:, None]
    assert (open_ * counts).sum() < 0.2 * 200 * len(x)


def test_phrases(spark):
    """Ten thousand phrases, in one block and in many, found as a search of each phrase would find them."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本"]
    some = lambda n: " ".join(rng.choice(words, n))
    rows = [(f"c{i % 3}", some(int(rng.integers(1, 4)))) for i in range(10_000)] + [("c0", "W1 w2"), ("c0", "w1 W2"), ("c1", None), (None, "w5"), ("c4", "")]
    texts = [(i, f"c{i % 4}", some(30)) for i in range(200)] + [(900, "c0", "w1 w2"), (901, "c4", "any"), (902, "c0", None), (903, None, "w5"), (904, "c0", "")]
    p = spark.createDataFrame(rows, "case_id string, phrase string")
    t = spark.createDataFrame(texts, "id int, case string, text string")
    wanted = {i: sorted({q for k, q in rows if q is not None and c is not None and k == c and x is not None and q.lower() in x.lower()}) for i, c, x in texts}
    for block_bytes in (phrases.BLOCK_BYTES, 200_000):
        found = phrases.found_phrases(p, F.col("case"), F.lower("text"), block_bytes=block_bytes)
        got = {r["id"]: r["f"] for r in t.select("id", found.alias("f")).collect()}
        got.pop(903)  # a case without a name may have phrases or not
        assert got == {k: v for k, v in wanted.items() if k != 903}


def test_phrases_decide_scores(spark):
    a = spark.createDataFrame(
        [("c", ("The Answer", "x")), ("d", ("fine", "x")), ("e", None)], "case_id string, answer struct<short_answer:string,request_type:string>"
    ).withColumn("answer", F.when(F.col("answer").isNotNull(), F.col("answer").withField("experiment", F.struct(F.lit("none").alias("kind")))))
    c = spark.createDataFrame(
        [("c", None, None, False), ("d", None, None, False), ("e", None, None, False)],
        "case_id string, expected_request_type array<string>, expected_experiment_kind array<string>, forbid_concentration_patterns boolean",
    )
    p = spark.createDataFrame([("c", "the ANSWER"), ("d", "the answer"), ("e", "x")], "case_id string, phrase string")
    got = {r["case_id"]: (r["found_phrases"], r["passed_count"], r["total_count"]) for r in evaluation.score_answers(a, c, p).collect()}
    assert got == {"c": (["the ANSWER"], 1, 2), "d": ([], 2, 2), "e": ([], 0, 2)}


def test_merged_units_brute_force(spark):
    """Sections of any length, units that may merge and others, against a loop."""
    rng = np.random.default_rng(7)
    units = []
    for section in range(30):
        for i in range(int(rng.integers(1, 60))):
            theory = rng.random() < 0.85
            units.append(
                {
                    "section_id": section, "block_start": i // 2, "block_end": i // 2 + int(rng.integers(0, 2)), "seq": i % 2,
                    "block_type": ["paragraph", "figure"][int(rng.random() < 0.2)], "locator": f"l{i}", "text": "x" * int(rng.integers(1, 900)),
                    "chunk_kind": "theory" if theory else "table", "retrieval_group": "theory", "title": f"t{i}", "part": None, "item_index": i,
                    "paired_text": None, "instruction_text": "y", "default_retrieval": bool(rng.random() < 0.9),
                }
            )
    kinds = {"section_id": "long", "block_start": "int", "block_end": "int", "seq": "long", "item_index": "int", "default_retrieval": "boolean"}
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in units[0])
    got = chunking.merge_units(spark.createDataFrame([tuple(u.values()) for u in units], schema)).orderBy("section_id", "block_start", "seq").collect()
    want = []
    for u in units:
        last = want[-1] if want else None
        merge = u["chunk_kind"] == "theory"
        if last and merge and last["m"] and last["section_id"] == u["section_id"] and len(last["text"]) + 2 + len(u["text"]) <= 1800:
            last["text"] += "\n\n" + u["text"]
            last |= {"block_end": u["block_end"], "types": last["types"] | {u["block_type"]}, "default": last["default"] and u["default_retrieval"]}
        else:
            want.append(u | {"m": merge, "types": {u["block_type"]}, "default": u["default_retrieval"]})
    assert len(got) == len(want) < len(units)
    for g, w in zip(got, want, strict=True):
        assert (g["section_id"], g["block_start"], g["block_end"], g["seq"], g["text"]) == tuple(w[c] for c in ("section_id", "block_start", "block_end", "seq", "text"))
        assert g["locator"] == (f"blocks-{w['block_start']}-{w['block_end']}" if w["m"] else w["locator"])
        assert g["block_type"] == ("mixed" if len(w["types"]) > 1 else w["block_type"]) and g["default_retrieval"] == w["default"]
        assert (g["title"], g["instruction_text"]) == ((None, None) if w["m"] else (w["title"], "y"))


def test_token_hashes_brute_force(spark):
    texts = ["One two, TWO one_3!", "", None, "ñ only", "a\r\nb\xa0c  d", "İI K K", "word " * 5000, "日本 x日y"]
    d = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    lowered = {r["item_id"]: r["t"] for r in d.select("item_id", F.lower("text").alias("t")).collect()}
    cells, dense = {}, {r["item_id"]: r["vector"] for r in similarity.token_hash_vectors(d).collect()}
    for r in similarity.token_hash_cells(d).collect():
        cells.setdefault(r["item_id"], {})[r["slot"]] = r["value"]
    for i, t in lowered.items():
        ws = re.findall("[A-Za-z0-9_]+", t or "")
        v = np.zeros(256)
        for f in [*ws, *map("__".join, zip(ws, ws[1:], strict=False))]:
            h = hashlib.sha256(f.encode()).digest()
            v[int.from_bytes(h[:4], "big") % 256] += -1 if h[4] % 2 else 1
        v = v / (np.linalg.norm(v) or 1)
        assert np.allclose(dense[i], v, atol=1e-8)
        assert cells.get(i, {}).keys() == set(np.flatnonzero(v)) and all(abs(cells[i][k] - v[k]) < 1e-8 for k in np.flatnonzero(v))


def test_manifest_notices_changes(spark):
    rows = [(1, "a", True, [0.1]), (2, "b", True, [0.2]), (2, "b", False, [0.2]), (None, None, True, [0.3])]
    schema = "id long, text string, default_retrieval boolean, vector array<double>"
    source = spark.createDataFrame(rows, schema)
    of = lambda changed: retrieval.manifest(source, spark.createDataFrame(changed, schema)).first()
    same = of(rows[::-1])
    assert same["complete"] and same["current"] and (same["source_count"], same["default_count"], same["vector_dimension"]) == (4, 3, 1)
    text = of([*rows[:3], (None, "", True, [0.3])])
    assert text["complete"] and not text["current"]
    assert not of([rows[0], rows[1], rows[1], rows[0]])["current"] and not of(rows[:3])["complete"]
    assert not of([*rows[:3], (None, None, True, None)])["complete"]


def _listing(nodes):
    """Depth-first, brothers by (created_at, id): {id: (position, depth)}."""
    there, below = {n[0] for n in nodes}, {}
    for i, tree, up, at in nodes:
        below.setdefault(up if up in there else ("tree", tree), []).append((at, i))
    out = {}
    for tree in {n[1] for n in nodes}:
        todo, place = [(i, 0) for _, i in sorted(below[("tree", tree)], reverse=True)], 0
        while todo:
            i, depth = todo.pop()
            place += 1
            out[i] = (place, depth)
            todo += [(c, depth + 1) for _, c in sorted(below.get(i, []), reverse=True)]
    return out


def test_trees(spark):
    """Random trees, several roots, a parent that is missing; a chain of ten thousand and a root of a hundred thousand children."""
    rng = np.random.default_rng(2)
    nodes = [(i, f"t{i % 3}", None if i < 9 else int(rng.choice(np.arange(i % 3, i, 3))), f"{rng.integers(0, 50):03d}") for i in range(600)]
    nodes += [(700, "t0", 999, "000")]
    chain = [(1000 + i, "chain", 999 + i if i else None, "a") for i in range(10_000)]
    wide = [(20_000 + i, "wide", 20_000 if i else None, str(i % 7)) for i in range(100_001)]
    rows = nodes + chain + wide
    d = spark.createDataFrame(rows, "id long, tree_id string, parent_id long, created_at string")
    got = {r["id"]: (r["position"], r["depth"]) for r in registry.tree_places(d).collect()}
    assert got == _listing(rows)
    with pytest.raises(ValueError, match="cycle"):
        registry.tree_places(spark.createDataFrame([(1, "t", 2, "a"), (2, "t", 1, "a"), (3, "t", None, "a")], "id long, tree_id string, parent_id long, created_at string"))


def test_partition_upserts(spark, tmp_path):
    """Only folders that the changes name are written; the same changes again leave the same rows."""
    path = f"file://{tmp_path}/results"
    schema = "experiment_id string, combo_id string, score double, subject_score double, updated_at string"
    first = spark.createDataFrame([(f"e{i % 4}", f"c{i % 3}", 0.1 * (i % 11), None, f"2024-01-{i % 28 + 1:02d}") for i in range(60)], schema)
    later = spark.createDataFrame([("e1", "c0", 0.95, 0.5, "2025-01-01"), ("e1", "c9", 0.2, None, "2025-01-01"), ("new", "c0", 0.3, None, "2025-01-01")], schema)
    files = lambda: {f.name for k in ("e0", "e2", "e3") for f in (tmp_path / "results" / f"experiment_id={k}").glob("*.parquet")}
    rows = lambda df: sorted(map(str, df.select("experiment_id", "combo_id", "score", "status").collect()))
    io.upsert_partitions(path, first, "experiment_id", evaluation.merge_results)
    before = files()
    for _ in range(2):
        got = io.upsert_partitions(path, later, "experiment_id", evaluation.merge_results)
        assert rows(got) == rows(evaluation.upsert_results(first, later)) and files() == before


def test_files_and_dead_letters(spark, tmp_path):
    texts = {"a": '{"id": 1,\n "n": "x"}', "b": '{"id": ', "c": " \n", "d": "[1]", "e": '{"id": "one"}', "f": '{"n": null}', "g": "null", "h": '{"id": 2, "more": [1]}'}
    for name, value in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.json").write_text(value)
    (tmp_path / "other.txt").write_text("{")
    good, dead = io.read_files(spark, f"file://{tmp_path}", spark.createDataFrame([], "id int, n string").schema)
    name = F.regexp_extract("file_path", r"(\w+)\.json", 1)
    assert {r["k"]: (r["id"], r["n"]) for r in good.select(name.alias("k"), "id", "n").collect()} == {"a": (1, "x"), "f": (None, None), "h": (2, None)}
    assert {r["k"]: r["reason"] for r in dead.select(name.alias("k"), "reason").collect()} == {
        "b": "not JSON", "c": "blank", "d": "not an object", "e": "a value of another type", "g": "not an object",
    }


def test_batch_review(spark):
    tests = spark.createDataFrame([(1, "q", ["Salt", "acid"]), (2, "r", None)], "query_id long, query string, expected_topics array<string>")
    hits = spark.createDataFrame(
        [(1, 1, 7, 0.5, " The SALT is " + "x" * 30, 3, "s", "theory")],
        "query_id long, rank int, chunk_id long, distance double, text string, chapter_number int, section string, retrieval_group string",
    )
    got = {r["query_id"]: r for r in retrieval.batch_review(tests, hits, max_chars=12).collect()}
    assert (got[1]["found_topics"], got[1]["text"], got[2]["rank"]) == (["Salt"], "The SALT is\n…", None)
    with pytest.raises(ValueError, match="no text"):
        retrieval.batch_review(tests.withColumn("query", F.lit(" ")), hits)


def test_indexed_search_is_the_scan(spark, tmp_path):
    """Queries of one to twenty characters, taken from the texts or made up, against a scan; and few texts are candidates of a rare one."""
    rng = np.random.default_rng(9)
    letters = list("abcdeé日 ABC.")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(300)] + [None, "", "ab", "abc" * 500]
    d = spark.createDataFrame([(i, t, f"x{i % 7}") for i, t in enumerate(texts)], "id long, text string, more string")
    path = f"file://{tmp_path}/index"
    textindex.write_index(d, path, "id", "text", "more")
    queries = ["", " ", "a", "é", "ab", "日 ", "abc", "ABCa", " x3", "%", "_a_"]
    for n in range(1, 21, 3):
        t = texts[int(rng.integers(0, 250))] or "a"
        queries.append(t[: n + 3] if rng.random() < 0.7 else "".join(rng.choice(letters, n)))
    joined = [(i, f"{'' if t is None else t + ' '}x{i % 7}".lower()) for i, t in enumerate(texts)]
    for q in queries:
        want = sorted(i for i, t in joined if q.strip().lower() in t)
        assert sorted(r["id"] for r in textindex.search(spark, path, q).collect()) == want, q
    assert textindex.candidates(spark, path, joined[10][1][:12]).count() < 20


def test_cells_of_parts_are_those_of_the_whole(spark, tmp_path):
    rows = review.flatten_artifacts(artifacts(spark, "/root/testdata/sf0.001"))
    rows = rows.withColumns({"combo_id": F.when(F.col("row_id") % 17 > 0, F.col("combo_id")), "score": F.when(F.col("row_id") % 5 > 0, F.col("score"))}).cache()
    path = f"file://{tmp_path}/cells"
    for part in range(4):
        stored = rollup.keep_up(path, rows.where(F.col("row_id") % 4 == part))
    whole = rollup.cells(rows)
    text_of = lambda df: sorted(map(str, df.collect()))
    assert text_of(stored.select(*whole.columns)) == text_of(whole)
    for name in ("metrics", "combo_summary", "case_summary"):
        a, b = getattr(rollup, name)(stored), getattr(review, name)(rows)
        assert text_of(a.select(*sorted(a.columns))) == text_of(b.select(*sorted(b.columns)))


def test_trigrams_of_large_alphabets_and_many_slices(spark, tmp_path, monkeypatch):
    """Each trigram of each text once, for alphabets whose cubes don't fit 64 bits, and ids of any type over several slices."""
    wide = "".join(chr(i) for i in range(0x4E00, 0x4E00 + 120_000) if not 0xD800 <= i < 0xE000)
    texts = ["", "ab", *["abc"] * 9_000, wide, "xyz" + wide[:5]]
    names, starts, place = textindex._own_grams(texts)
    got = {(g, int(i)) for g, a, b in zip(names, starts, [*starts[1:], len(place)], strict=True) for i in place[a:b]}
    assert len(got) == len(place) and got == {(t[i : i + 3], k) for k, t in enumerate(texts) for i in range(len(t) - 2)}
    monkeypatch.setattr(textindex, "FEW", 3)  # the others are verified by a scan
    d = spark.createDataFrame([(f"k{i}", f"Text {i} " + "ab cd" * (i % 3)) for i in range(40)], "name string, text string")
    path = f"file://{tmp_path}/slices"
    textindex.write_index(d, path, "name", "text")
    for q in ("text 7", "AB CD", "cda", "t 3", "b cdab c"):
        want = sorted(r["name"] for r in d.collect() if q.lower() in r["text"].lower())
        assert sorted(r["id"] for r in textindex.search(spark, path, q).collect()) == want, q


def test_long_text_is_indexed_in_linear_time(spark, tmp_path):
    """A text of two million characters: trigrams cut from its start one by one would read it two million times."""
    d = spark.range(1).selectExpr("id", "concat(repeat('abc ', 500000), 'needle') as text")
    path = f"file://{tmp_path}/long"
    start = time.time()
    textindex.write_index(d, path, "id", "text")
    assert [r["id"] for r in textindex.search(spark, path, "c needle").collect()] == [0]
    assert textindex.search(spark, path, "needles").isEmpty() and time.time() - start < 60


def test_batch_review_looks_for_topics_in_the_whole_text(spark):
    """A topic beyond the cut of a text is found."""
    tests = spark.createDataFrame([(1, "q", ["Salt", "Zinc", "acid"])], "query_id long, query string, expected_topics array<string>")
    hits = spark.createDataFrame(
        [(1, 1, 7, 0.5, "The SALT is " + "x" * 30 + " zinc", 3, "s", "theory")],
        "query_id long, rank int, chunk_id long, distance double, text string, chapter_number int, section string, retrieval_group string",
    )
    row = retrieval.batch_review(tests, hits, max_chars=12).first()
    assert (row["found_topics"], row["text"]) == (["Salt", "Zinc"], "The SALT is\n…")


def test_files_are_written_by_several_tasks(spark, tmp_path):
    """A table in one part: its files come from several tasks, each file whole."""
    rows = spark.range(0, 120, 1, 1).selectExpr("id as file", "concat('v', id) as value")
    io.write_files(rows, f"file://{tmp_path}/files", "file")
    files = sorted(tmp_path.glob("files/file=*/*.txt"))
    assert len({re.search(r"part-(\d+)", f.name)[1] for f in files}) > 1
    assert {f.parent.name: f.read_text() for f in files} == {f"file={i}": f"v{i}\n" for i in range(120)} and len(files) == 120


def test_small_files_are_read_in_few_tasks(spark, tmp_path, monkeypatch):
    """Files that Spark's scan would deal to a task each come in fewer, and none is lost."""
    for i in range(60):
        (tmp_path / f"{i}.json").write_text(f'{{"id": {i}}}' if i % 3 else " ")
    found = []
    monkeypatch.setattr(io, "save", lambda df: found.append(df.rdd.getNumPartitions()) or df)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        good, dead = io.read_files(spark, f"file://{tmp_path}", spark.range(0).schema)
        assert sorted(r["id"] for r in good.collect()) == [i for i in range(60) if i % 3] and dead.count() == 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found[0] <= 4 * spark.sparkContext.defaultParallelism < 60


def test_visits_are_made_a_few_at_a_time(spark, monkeypatch):
    """Bounds of many queries to many cells come in small batches without vectors; cells meet in bundles, large ones in blocks."""
    rng = np.random.default_rng(4)
    x = _clustered(rng, 600, size=8, centres=12, spread=0.3)
    v = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "chunk_id long, vector array<double>")
    monkeypatch.setattr(nearest, "BOUNDS", 200)
    monkeypatch.setattr(nearest, "ROWS", 50)
    stats = [(c, 40 if c else 120, 0.1, 1.0) for c in range(20)]
    shared = type("Shared", (), {"value": (x[:20], *[np.array(c) for c in zip(*stats, strict=True)])})
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(list(x))], names=["query_id", "vector"])
    made = list(nearest._visit(shared, 30, "dot", False)(iter([batch])))
    assert max(m.num_rows for m in made) <= 200 and all(m.schema.names == ["query_id", "cell"] for m in made)
    assert nearest._bundles([(c, n) for c, n, *_ in stats[:4]]) == [(0, 0, 3), (1, 1, 1), (2, 2, 1), (3, 3, 1)]
    assert nearest._bundles([(0, 20), (1, 30), (2, 1)]) == [(0, 0, 1), (1, 0, 1), (2, 1, 1)]
    q = v.select(F.col("chunk_id").alias("query_id"), "vector")
    for metric, d in (("dot", -np.round(x @ x.T, 6)), ("l2sq", np.round(np.maximum(2 - 2 * x @ x.T, 0), 6))):
        got = nearest.top_k(q, v, 5, metric, send_bytes=0, cell=30).groupBy("query_id").agg(F.sort_array(F.collect_list("distance")).alias("d")).collect()
        assert len(got) == 600
        assert all(np.allclose(r["d"], np.sort(d[r["query_id"]])[:5], atol=2e-6) for r in got)


@pytest.mark.parametrize("same_group", [True, False])
def test_pairs_by_strips(vectors, monkeypatch, same_group):
    """Cells of several strips and strips of several cells, tiles in them; a vector goes to each strip once, not to each tile."""
    v, rows = vectors
    for strip, strips in ((40, 2), (300, 3)):
        monkeypatch.setattr(similarity, "STRIP", strip)
        monkeypatch.setattr(similarity, "STRIPS", strips)
        for threshold in (0.5, None):
            wanted = _every(rows, -9 if threshold is None else threshold, same_group)
            assert _same(similarity.pairs(v, same_group=same_group, threshold=threshold, tile=16), wanted)
    grouped = similarity._grouped(v, same_group)
    sizes = grouped.groupBy("g").agg(F.count("*").alias("n"))
    sent = similarity._meeting_strips(grouped, sizes, 16).groupBy("item_id").count().agg(F.max("count")).first()[0]
    assert sent == -(-sizes.agg(F.max("n")).first()[0] // 300)


def test_mirrored_pairs_are_made_once(spark):
    """e4_matrix: both sides of a pair come from one pass over the pairs."""
    p = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25)], "left_item_id long, right_item_id long, similarity double")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    once = p.coalesce(1).mapInArrow(count, p.schema)
    assert sorted(map(tuple, similarity.mirrored(once).collect())) == [(1, 2, 0.5), (1, 3, 0.25), (2, 1, 0.5), (3, 1, 0.25)]
    assert seen.value == 2


def test_outliers_without_pairs(spark, vectors, monkeypatch):
    """e6_outliers: sums made beside the products give what the pairs give, ids that stand twice and lone items included."""
    v = vectors[0].union(spark.createDataFrame([(7, "large", [0.5] * 16), (5000, "lone", [1.0] * 16), (5001, "wide", [1.5e6] * 16), (5002, "wide", [2.5] * 16)], vectors[0].schema))
    monkeypatch.setattr(similarity, "STRIP", 150)
    wanted = sorted(map(tuple, similarity.outliers(v, similarity.pairs(v)).collect()), key=str)
    monkeypatch.setattr(similarity, "pairs", None)
    assert sorted(map(tuple, similarity.outliers(v).collect()), key=str) == wanted
    assert (5000, "lone", 0, None, None, None) in wanted


def test_bundle_counts_without_pairs(spark, vectors, monkeypatch):
    """e8_bundle_counts: counts need no pairs; those of the bundle's other tables are the same."""
    v, rows = vectors
    both = v.union(spark.createDataFrame([(7, "large", [0.5] * 16), (7, "large", [0.25] * 16)], v.schema))
    n = similarity.bundle(both)["pairs"].count()
    pairs = similarity.pairs(v, threshold=0.97)
    wanted = sorted(map(str, similarity.clusters(pairs, v, 0.97).collect()))
    assert wanted and sorted(map(str, similarity.bundle(v, threshold=0.97)["clusters"].collect())) == wanted
    monkeypatch.setattr(similarity, "pairs", None)
    assert tuple(similarity.bundle(both)["counts"].first()) == (len(rows) + 2, n)
    assert similarity.bundle(v, same_group=False)["counts"].first()["pair_count"] == len(_every(rows, -9, False))
    assert similarity.bundle(v.limit(0))["counts"].first()["pair_count"] == 0

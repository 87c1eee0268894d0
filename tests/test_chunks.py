"""The chunk chain over all given documents and conversations, against plain Python."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import chunking
from tessera.plans import corpus_queries
from tests.test_oracles import SF


@pytest.fixture(scope="module")
def want(spark):
    """Chunks from the units of the sections, merged, split and labelled one by one."""
    cfg = chunking.Config()
    by_section = collections.defaultdict(list)
    for r in corpus_queries._units(spark, SF).collect():
        by_section[r["section_id"]].append(r.asDict())
    sections = {r["section_id"]: r for r in corpus_queries._sections(spark, SF).collect()}
    out = []
    for section, own in by_section.items():
        own.sort(key=lambda u: (u["block_start"], u["seq"]))
        runs = []
        for u in own:
            open_ = u["chunk_kind"] in chunking.MERGEABLE and u["retrieval_group"] == "theory"
            if runs and open_ and runs[-1][0] and sum(len(x["text"]) + 2 for x in runs[-1][1]) + len(u["text"]) <= cfg.target:
                runs[-1][1].append(u)
            else:
                runs.append((open_, [u]))
        s = sections[section]
        for merged, us in runs:
            first = us[0] if not merged else us[0] | {
                "title": None,
                "part": None,
                "item_index": None,
                "paired_text": None,
                "instruction_text": None,
                "chunk_kind": "theory",
                "locator": f"blocks-{us[0]['block_start']}-{us[-1]['block_end']}",
            }
            body = "\n\n".join(u["text"] for u in us)
            pieces = [body] if len(body) <= cfg.most else chunking.split_text(body, cfg)
            for i, piece in enumerate(pieces, 1):
                lines = [
                    f"Book: {s['book_title']}",
                    f"Chapter {s['chapter_number']}: {s['chapter_title']}",
                    f"Section {s['section_number']}: {s['section_title']}",
                    f"Content type: {first['chunk_kind'].replace('_', ' ')}",
                ]
                lines += [f"Item: {first['title']}"] * bool(first["title"]) + [
                    f"Part: {(first['part'] or '').replace('_', ' ')}"
                ] * bool(first["part"]) + [f"Number: {first['item_index']}"] * (first["item_index"] is not None)
                lines += [f"Instruction: {first['instruction_text']}"] * bool(first["instruction_text"])
                lines += [
                    f"Related {'problem' if 'solution' in first['chunk_kind'] else 'question'}: {first['paired_text']}"
                ] * bool(first["paired_text"])
                out.append(
                    {
                        "id": f"{section}__{first['locator']}" + (f"__part-{i:02d}" if len(pieces) > 1 else ""),
                        "text": piece,
                        "embedding": ("\n".join(lines) + "\n\n" + piece).strip(),
                        "kind": first["chunk_kind"],
                        "group": first["retrieval_group"],
                        "default": all(u["default_retrieval"] for u in us),
                        "chapter": s["chapter_number"],
                        "order": (s["chapter_number"], s["section_number"], us[0]["block_start"]),
                        "piece": i,
                        "pieces": len(pieces),
                        "section": section,
                    }
                )
    return out


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _rows(spark, name):
    return plans.queries()[name](spark, SF).collect()


def test_chunks(spark, want):
    got = sorted(tuple(r) for r in _rows(spark, "c7_chunks"))
    assert got == sorted((w["id"], w["section"], w["kind"], w["piece"], w["pieces"], _sha(w["text"]), _sha(w["embedding"])) for w in want)
    assert {
        "worked_example_solution", "self_test_answer", "assessment_question", "feature", "attribution", "table"
    } <= {w["kind"] for w in want}
    assert max(w["pieces"] for w in want) > 1 or all(len(w["text"]) <= 3000 for w in want)


def test_embedding_texts(spark, want):
    assert {r["id"]: r["h"] for r in _rows(spark, "f14_embedding_text")} == {
        w["id"]: hashlib.md5(w["embedding"].encode()).hexdigest() for w in want
    }


def test_report(spark, want):
    got = {
        (r["facet"], r["value"]): (
            r["chunk_count"], r["default_count"], r["excluded_count"], r["min_length"], r["max_length"], r["mean_length"]
        )
        for r in _rows(spark, "a9_chunk_report")
    }
    groups = collections.defaultdict(list)
    for w in want:
        for k in (("chunk_kind", w["kind"]), ("retrieval_group", w["group"]), ("chapter_number", str(w["chapter"])), ("all", "")):
            groups[k].append(w)
    assert got.keys() == groups.keys()
    for k, ws in groups.items():
        n = [len(w["text"]) for w in ws]
        assert got[k][:5] == (len(ws), sum(w["default"] for w in ws), sum(not w["default"] for w in ws), min(n), max(n))
        assert got[k][5] == pytest.approx(sum(n) / len(n), abs=0.006)


def test_checks(spark, want):
    got = collections.Counter((r["id"], r["level"], r["problem"]) for r in _rows(spark, "a10_chunk_checks"))
    expected = collections.Counter((w["id"], "warning", "short embedding text") for w in want if len(w["embedding"]) < 95)
    assert got == expected and expected
    odd = chunking.chunks(
        chunking.merge_units(corpus_queries._units(spark, SF)), corpus_queries._sections(spark, SF).withColumn("section_title", F.lit(""))
    ).limit(3)
    assert {r["problem"] for r in chunking.validate(odd.union(odd)).collect()} >= {"missing section_title", "duplicate id"}


def test_order_and_samples(spark, want):
    order = sorted(want, key=lambda w: (*w["order"], w["id"]))
    assert [r["id"] for r in _rows(spark, "t5_corpus_order")] == [w["id"] for w in order]
    ranks = collections.Counter()
    expected = set()
    for w in order:
        ranks[w["kind"]] += 1
        if ranks[w["kind"]] <= 4:
            expected.add((w["kind"], ranks[w["kind"]], w["id"]))
    assert {tuple(r) for r in _rows(spark, "w11_review_sample")} == expected


def test_split_documents(spark):
    """Every chunk is within the limits, chunks stand in the text in order, and no word is lost."""
    texts = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = collections.defaultdict(list)
    for r in _rows(spark, "c6_split_documents"):
        got[r["doc_id"]].append((r["piece"], r["text"]))
    assert got.keys() == texts.keys()
    for i, pieces in got.items():
        parts = [" ".join(t.split()) for _, t in sorted(pieces)]
        assert all(len(t) <= 3000 + 180 for _, t in pieces)
        assert all(p in texts[i] for p in parts) and texts[i].startswith(parts[0]) and texts[i].endswith(parts[-1])
        assert not collections.Counter(texts[i].split()) - collections.Counter(" ".join(parts).split())

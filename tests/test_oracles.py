"""Every query with SQL gives the rows of that SQL; the others are held by tests of their own, and give rows here."""

import pytest

from tessera import plans
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"
#: Queries without SQL: test_chunks, test_compare and the page tests of test_operators hold them.
ELSEWHERE = {
    "c6_split_documents",
    "c7_chunks",
    "f14_embedding_text",
    "a9_chunk_report",
    "a10_chunk_checks",
    "w11_review_sample",
    "t5_corpus_order",
    "j1_text_similarity",
    "j2_field_similarity",
    "a6_text_similarity",
    "e9_text_ratio",
    "e10_unified_diff",
    "e11_alignment",
    "c1_nodes",
    "c1_blocks",
    "c1_outline",
    "c2_links",
    "c3_sections",
    "c4_markdown",
    "c5_page_units",
    "a11_chapters",
    "a11_block_types",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    got = plans.queries()[name](spark, SF).toPandas()
    sql = plans.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(con.execute(sql).df())
    else:
        assert name in ELSEWHERE and list(got.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    first = entry.entry(spark).orderBy("rank").first()
    assert first["rank"] == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Queries of page parsing, and their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.operators import pages, units
from tessera.sources.adapters import table

_pages = lambda s, d: table(s, d, "pages")
_nodes = lambda s, d: pages.parse_nodes(_pages(s, d))
_blocks = lambda s, d: pages.blocks(_nodes(s, d))
_sections = lambda s, d: pages.sections(_nodes(s, d), _pages(s, d))


def _page_units(s, d):
    """C5 on parsed pages: a section is a page's content."""
    return units.units(_blocks(s, d).withColumn("section_id", F.col("page_id") * 1000 + F.col("section_index")))


def _book_nodes(s, d):
    """Nodes of the given pages, and of a book page for each supplier: formulae and scripts, a worked example, a table, a figure."""
    k, n, name = (F.col(c).cast("string") for c in ("s_suppkey", "s_nationkey", "s_name"))
    parts = [k if x == "{k}" else n if x == "{n}" else name if x == "{name}" else F.lit(x) for x in re.split(r"(\{k\}|\{n\}|\{name\})", BOOK_HTML)]
    books = table(s, d, "supplier").select((-1 - F.col("s_suppkey")).cast("long").alias("page_id"), F.concat(F.lit("book/"), k).alias("url"), F.concat(*parts).alias("html"))
    return pages.parse_nodes(_pages(s, d).select("page_id", "url", "html").union(books))


BOOK_HTML = """<html><body><div class="chapter" title="One"><div class="chapter-ugc">
<p>Sum <img class="quicklatex" alt="a+{k}" src="f{k}.png">, x<sup>{n}n</sup>, H<sub>{n}</sub> and <img class="quicklatex" alt="a+{k}" src="f{k}.png"></p>
<div class="textbox textbox--examples"><div class="textbox__header"><p class="textbox__title">Example {k}</p></div><div class="textbox__content">
<h1>Problems</h1><p>Name {name}.</p><ol start="{n}"><li>first</li></ol><h1>Solutions</h1><p>done</p></div></div>
<table><caption>Place of {name}</caption><tr><th>key</th><th>nation</th></tr><tr><td>{k}</td><td> {n} </td></tr></table>
<div class="wp-caption"><img src="i{k}.png" alt="pic  {k}" width="{n}"><div class="wp-caption-text">Picture {k}</div></div>
</div></div></body></html>"""

QUERIES = {
    "c1_nodes": lambda s, d: _nodes(s, d).drop("cells"),
    "c1_blocks": lambda s, d: _blocks(s, d).select(*pages.PLACE, "block_type", "tag", "heading_level", "title", "text"),
    "c1_tag_counts": lambda s, d: _nodes(s, d).groupBy("page_id", "tag").agg(F.count("*").alias("n")),
    "c1_outline": lambda s, d: pages.outline(_nodes(s, d)),
    "c1_headings": lambda s, d: _blocks(s, d).where("block_type = 'heading'").select(
        "page_id", "block_index", "heading_level", F.md5(F.regexp_replace("text", r"\s+", " ")).alias("h")
    ),
    "c2_links": lambda s, d: pages.links(_nodes(s, d)).select("page_id", "link_index", "href", "text"),
    "c2_link_targets": lambda s, d: pages.links(_nodes(s, d)).groupBy("page_id").agg(F.count("*").alias("n")),
    "c2_formulae": lambda s, d: pages.formulae(_book_nodes(s, d)),
    "c2_media": lambda s, d: pages.media(_book_nodes(s, d)),
    "c2_tables": lambda s, d: pages.tables(_book_nodes(s, d)).withColumn("rows", F.to_json("rows")),
    "c3_books": lambda s, d: pages.books(_nodes(s, d)).select("page_id", "book_title", "language", "page_title", "section_count"),
    "c3_sections": lambda s, d: _sections(s, d).select(
        "page_id", "section_index", "section_title", "block_count", "table_count", "source_sha256", "content_sha256"
    ),
    "c4_markdown": lambda s, d: pages.markdown(_nodes(s, d)),
    "c5_page_units": lambda s, d: _page_units(s, d).select("section_id", "block_start", "locator", "chunk_kind", F.md5("text").alias("h")),
    "a11_chapters": lambda s, d: pages.chapter_report(_sections(s, d)),
    "a11_block_types": lambda s, d: pages.block_type_counts(_blocks(s, d)),
    "a12_structure_audit": lambda s, d: pages.structure_audit(_book_nodes(s, d)),
}

_PLAIN = r"regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs')"
_TEXT = (
    r"trim(regexp_replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', "
    r"'\"'), '&amp;', '&'), '\s+', ' ', 'g'))"
)

#: Blocks and elements of a book page, by their numbers; the given pages have no formula, figure, table or worked example.
_PLACE = "(-1 - s_suppkey)::bigint as page_id, 1 as section_index, {} as block_index"

SQL = {
    "c2_formulae": " union all ".join(
        f"select {_PLACE.format(1)}, '{kind}' as kind, {value} as value, {source} as source, {seq} as seq, {i} as formula_index from supplier"
        for i, (kind, value, source, seq) in enumerate(
            [
                ("latex_image", "'a+' || s_suppkey", "'f' || s_suppkey || '.png'", 5),
                ("subscript", "s_nationkey::varchar", "null", 7),
                ("superscript", "s_nationkey || 'n'", "null", 6),
            ]
        )
    ),
    "c2_media": (
        f"select {_PLACE.format(4)}, 28 as seq, 'i' || s_suppkey || '.png' as src, 'pic ' || s_suppkey as alt, 'Picture ' || s_suppkey as caption, "
        "s_nationkey::varchar as width, null as height from supplier"
    ),
    "c2_tables": (
        f"select {_PLACE.format(3)}, 19 as table_seq, 'Place of ' || s_name as caption, "
        """'[["key","nation"],["' || s_suppkey || '","' || s_nationkey || '"]]' as rows from supplier"""
    ),
    "a12_structure_audit": " union all ".join(
        f"select {_PLACE.format(2)}, {seq} as seq, '{kind}' as kind, {name} as name, false as missing from supplier"
        for seq, kind, name in [(-1, "title", "'Example ' || s_suppkey"), (13, "heading", "'Problems'"), (17, "heading", "'Solutions'")]
    ),
    "c1_tag_counts": (
        r"with t as (select page_id, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '<\1>', 'gs'), '<!--.*?-->', '', 'gs') as html from pages), "
        r"x as (select page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) as tag from t) select page_id, tag, count(*) as n from x group by page_id, tag"
    ),
    "c1_headings": (
        f"with t as (select page_id, {_PLAIN} as html from pages), h as (select page_id, regexp_extract(html, '<article><h1>(.*?)</h1>', "
        f"1, 's') as x from t where regexp_matches(html, '<article><h1>')) select page_id, 1 as block_index, 1 as heading_level, "
        f"md5({_TEXT.format('x')}) as h from h"
    ),
    "c2_link_targets": (
        "select page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)))::bigint as n from pages where "
        "regexp_matches(html, '<a href=\"[^\"]+\"')"
    ),
    "c3_books": (
        f"with t as (select page_id, {_PLAIN} as html from pages) select page_id, 'Untitled' as book_title, 'en' as language, "
        f"{_TEXT.format(chr(34) + 'x' + chr(34))} as page_title, 1 as section_count from (select page_id, regexp_extract(html, "
        f"'<title>(.*?)</title>', 1, 's') as x from t)"
    ),
}

"""HTML pages to node rows, blocks, links, media, formulae, tables, sections, outlines and reports.

Parsing one page is a small helper that runs inside the tasks, page by page. It gives flat rows, one an element, in document
order: where the element stands (section, block, path), what it is, and what it holds. All else works on these rows.

The outline of a block is those of its rows that show text: titles, headings, paragraphs, list items with their numbers, table
captions and rows. Rows of one list or table have one ``unit``. Plain text and review markdown are both joined from it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators.chunking import repair_list_start

# Tags that are blocks, that never close, and whose content isn't text.
BLOCK_TAGS = [
    "p",
    "h1",
    "h2",
    "h3",
    "h4",
    "h5",
    "h6",
    "li",
    "blockquote",
    "pre",
    "figcaption",
    "td",
    "th",
    "title",
    "div",
    "article",
    "nav",
    "footer",
    "section",
    "table",
    "ul",
    "ol",
]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
SILENT_TAGS = ["script", "style", "noscript", "template"]
# Elements that carry structure, text boxes by class, and metadata names of a book.
STRUCTURE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div", "blockquote", "pre", "article", "section"}
BOXES = {
    "textbox--learning-objectives": "learning_objectives",
    "textbox--examples": "worked_example",
    "textbox--key-takeaways": "key_takeaways",
    "textbox--exercises": "exercise_set",
}
BOOK = {
    "book_title": "pb-title",
    "language": "pb-language",
    "publisher": "pb-publisher",
    "publication_year": "pb-copyright-year",
    "license": "pb-book-license",
}
FORMULA_CLASS = "quicklatex"

NODES = (
    "page_id long, section_index int, block_index int, seq int, node_path string, parent_path string, tag string, class string, node_type string, heading_level int, own_text string, text string, " "title string, ordered boolean, list_start string, item_index int, unit int, indent int, shown string, cells array<string>, href string, src string, alt string, width string, height string, caption string, name string, content string, id string"
)


#: Levels of a node path; a deeper one starts anew at the node of a number, as ``@number``.
PATH_LEVELS = 256


@dataclass(eq=False)
class _Node:
    """An element. Trees may be of any depth, so nothing here calls itself."""

    tag: str
    attrs: dict
    above: _Node | None
    path: str
    seq: int
    parts: list = field(default_factory=list)  # texts and nodes, in order
    row: dict = field(default_factory=dict)
    level: int = 0
    places: int = 0  # children so far
    has_formula: bool = False  # somewhere below

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def children(self) -> list[_Node]:
        return [p for p in self.parts if isinstance(p, _Node)]

    def below(self) -> Iterator[_Node]:
        """All elements below, each before its own children."""
        todo = self.children()[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(node.children()[::-1])

    def raw(self) -> str:
        """Text as it reads: scripts in Unicode, alternative texts of images, line ends for breaks."""
        todo: list[tuple[_Node, Iterator, list[str]]] = [(self, iter(self.parts), [])]
        while True:
            node, parts, out = todo[-1]
            for p in parts:
                if isinstance(p, str):
                    out.append(p)
                elif p.tag == "img":
                    alt = _inline(p.attrs.get("alt"))
                    out.append(f" [{'FORMULA' if p.formula() else 'IMAGE'}: {alt}] " if alt else "")
                elif p.tag == "br":
                    out.append("\n")
                elif p.tag not in SILENT_TAGS:
                    todo.append((p, iter(p.parts), []))
                    break
            else:
                todo.pop()
                value = "".join(out)
                if not todo:
                    return value
                todo[-1][2].append(text.script_text(value, node.tag == "sup") if node.tag in ("sub", "sup") else value)

    def formula(self) -> bool:
        return self.tag == "img" and FORMULA_CLASS in (self.attrs.get("class") or "")

    def kind(self) -> str:
        classes = self.classes()
        if self.tag == "div" and "textbox" in classes:
            return next((v for k, v in BOXES.items() if k in classes), "feature" if "shaded" in classes else "textbox")
        if self.tag == "div" and "wp-caption" in classes:
            return "figure"
        if self.tag == "p":
            return "formula_or_equation" if self.has_formula else "paragraph"
        return {"table": "table", "ul": "list", "ol": "list"}.get(self.tag) or (
            "heading" if self.tag[0] == "h" and self.tag[1:] in "123456" and len(self.tag) == 2 else "other"
        )


def _inline(value: str | None) -> str:
    return " ".join((value or "").split())


def _readable(raw: str) -> str:
    lines = [" ".join(x.split()) for x in raw.split("\n")]
    out: list[str] = []
    for x in lines:  # at most one empty line in a row
        if x or (out and out[-1]):
            out.append(x)
    return "\n".join(out).strip()


#: An ampersand with what may follow it in a reference, and characters to stand for one: those that no reference stands for come first.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
_MARKS = [chr(c) for c in (*range(0xFDD0, 0xFDF0), *range(0xE000, 0xF900))]


class _Tree(HTMLParser):
    """The elements of one page. Tolerant: a closing tag closes up to its match, a new p or li closes an open one.

    A reference ends in a semicolon, as in XML; where there is none, as in ``&amp`` or ``?a=1&copy=2``, the ampersand is text.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {}, None, "", -1)
        self.open = [self.root]
        self.tags = Counter()  # of the open elements
        self.nodes: list[_Node] = []
        # While the page is parsed, a mark that isn't in it stands for each such ampersand.
        self.mark = next(m for m in _MARKS if m not in html)
        self.feed(_REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else self.mark + m[0][1:], html))
        self.close()

    def _plain(self, value: str | None) -> str | None:
        return value and value.replace(self.mark, "&")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        tag = self._plain(tag)
        if tag == "p" and any(n.tag == "p" for n in self.open[-2:]) or tag == "li" and next(
            (n.tag for n in reversed(self.open) if n.tag in ("li", "ul", "ol")), None
        ) == "li":
            self.handle_endtag(tag)
        above = self.open[-1]
        start = f"@{above.seq}" if above.level and above.level % PATH_LEVELS == 0 else above.path
        path = f"{start}.{above.places}" if start else str(above.places)
        node = _Node(tag, {self._plain(k): self._plain(v) for k, v in attrs}, above, path, len(self.nodes), level=above.level + 1)
        above.places += 1
        above.parts.append(node)
        self.nodes.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)
            self.tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.open.pop()
            self.tags[tag] -= 1

    def handle_endtag(self, tag: str) -> None:
        tag = self._plain(tag)
        while self.tags[tag]:
            closed = self.open.pop().tag
            self.tags[closed] -= 1
            if closed == tag:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(self._plain(data))


def _own_texts(nodes: list[_Node]) -> dict[_Node, str]:
    """Text of each element up to the next block in it; elements come before what is in them, so the last one is first done."""
    out: dict[_Node, str] = {}
    for node in reversed(nodes):
        out[node] = "".join(p if isinstance(p, str) else "" if p.tag in BLOCK_TAGS or p.tag in SILENT_TAGS else out[p] for p in node.parts)
    return out


def _show(block: _Node) -> None:
    """Notes on the rows below a node what they show, in which unit and how far indented."""
    todo: list[tuple[_Node, int | None, int]] = [(block, None, 0)]
    while todo:
        todo += _show_one(*todo.pop())


def _show_one(node: _Node, unit: int | None, indent: int) -> list[tuple[_Node, int | None, int]]:
    """Notes what one node shows; returns those in it that are to be shown."""
    kind, inner = node.row["node_type"], [c for c in node.children() if c.tag in STRUCTURE]
    unit = node.seq if unit is None else unit
    node.row.update(unit=unit, indent=indent)
    if kind == "list":
        later = []
        for i, item in enumerate([c for c in node.children() if c.tag == "li"], 1):
            blocks = [c for c in item.children() if c.tag in STRUCTURE]
            first = item.parts.index(blocks[0]) if blocks else len(item.parts)
            lead = _Node("", {}, None, "", -1, item.parts[:first])
            item.row.update(
                unit=unit,
                indent=indent,
                item_index=i,
                ordered=node.tag == "ol",
                list_start=node.attrs.get("start"),
                shown=_inline(lead.raw()) if blocks else _readable(item.raw()),
            )
            later += [(c, unit, indent + 3) for c in blocks]
        return later
    if kind == "table":
        for c in node.below():
            if c.tag == "caption" and c.above is node:
                c.row.update(unit=unit, indent=indent, shown=_inline(c.raw()))
                node.row["caption"] = c.row["shown"]
            elif c.tag == "tr":
                c.row.update(unit=unit, indent=indent, cells=[_inline(x.raw()) for x in c.children() if x.tag in ("td", "th")])
                c.row["shown"] = " | ".join(c.row["cells"])
        return []
    if kind in ("heading", "paragraph", "formula_or_equation") or not inner:
        node.row["shown"] = _readable(node.raw())
        return []
    if "textbox" in node.classes():
        head = next(
            (
                x for c in node.children() if "textbox__header" in " ".join(c.classes()) for x in c.below()
                if "textbox__title" in " ".join(x.classes())
            ),
            None,
        )
        node.row["title"] = node.row["shown"] = _inline(head.raw()) if head else None
        content = next((c for c in node.children() if "textbox__content" in " ".join(c.classes())), node)
        inner = [c for c in content.children() if c.tag in STRUCTURE]
    return [(c, None if unit == node.seq else unit, indent) for c in inner]


def _page_rows(html: str | None) -> list[dict]:
    tree = _Tree(html or "")
    for n in reversed(tree.nodes):
        n.above.has_formula |= n.has_formula or n.formula()
    own_texts = _own_texts(tree.nodes)
    for n in tree.nodes:
        kind = n.kind()
        caption = None
        if n.tag == "img" and not n.formula():
            box = n.above
            while box is not None and box.tag != "div":
                box = box.above
            found = next(
                (x for x in box.below() if x.tag == "div" and "wp-caption-text" in (x.attrs.get("class") or "")), None
            ) if box else None
            caption = _inline(found.raw()) if found else None
        n.row = {
            "seq": n.seq,
            "node_path": n.path,
            "parent_path": n.above.path or None,
            "tag": n.tag,
            "class": n.attrs.get("class"),
            "node_type": kind,
            "heading_level": int(n.tag[1]) if kind == "heading" else None,
            "own_text": _inline(own_texts[n]),
            "text": _inline(n.raw()) if n.tag in ("a", "sub", "sup") else None,
            "list_start": n.attrs.get("start") if kind == "list" else None,
            "ordered": n.tag == "ol" if kind == "list" else None,
            "href": n.attrs.get("href"),
            "src": n.attrs.get("src"),
            "alt": n.attrs.get("alt"),
            "width": n.attrs.get("width"),
            "height": n.attrs.get("height"),
            "caption": caption,
            "name": n.attrs.get("name"),
            "content": n.attrs.get("content"),
            "id": n.attrs.get("id"),
        }
    # Content: that of each chapter division, or else that of the page's article, main part or body.
    roots = [
        next((c for c in n.children() if "chapter-ugc" in (c.attrs.get("class") or "")), None) for n in tree.nodes
        if n.tag == "div" and "chapter" in n.classes()
    ]
    if not roots:
        roots = [next((n for tag in ("article", "main", "body") for n in tree.nodes if n.tag == tag), tree.root)]
    for i, root in enumerate(roots, 1):
        blocks = [c for c in (root.children() if root else []) if c.tag not in ("nav", "footer", *SILENT_TAGS)]
        for k, block in enumerate(blocks, 1):
            _show(block)
            for n in (block, *block.below()):
                n.row.update(section_index=i, block_index=k)
    return [n.row for n in tree.nodes]


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def parse_nodes(pages: DataFrame) -> DataFrame:
    """Node rows (NODES) of all pages; a null page has none."""
    columns = {n: _KINDS[k] for n, k in (f.split() for f in NODES.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = _page_rows(html.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page] * len(rows) if n == "page_id" else [r.get(n) for r in rows], k) for n, k in columns.items()],
                    names=list(columns),
                )

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, NODES)


def number() -> Column:
    """A list item's number: the repaired start of its list and its place."""
    return (repair_list_start(F.col("list_start"))["value"] + F.col("item_index") - 1).cast("int")


def outline(nodes: DataFrame) -> DataFrame:
    """The rows that show text, in order: page_id, section_index, block_index, seq, unit, indent, node_type, tag, heading_level, number, line, marked.

    ``line`` is plain text, ``marked`` review markdown.
    """
    rows = nodes.where("block_index is not null and shown <> ''").withColumn("number", F.when(F.col("tag") == "li", number()))
    pad = F.repeat(F.lit(" "), F.col("indent"))
    marker = F.when(
        F.col("tag") == "li", F.when(F.col("ordered"), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- ")
    ).otherwise("")
    plain = F.when(F.col("tag") == "caption", F.concat(F.lit("Table: "), "shown")).otherwise(F.col("shown"))
    level = F.least(F.lit(6), F.col("heading_level") + 3)
    marked = (
        F.when(F.col("node_type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "shown")).when(
            F.col("tag") == "caption", F.concat(F.lit("**Table:** "), "shown")
        ).when(F.col("title").isNotNull(), F.concat(F.lit("**"), "shown", F.lit("**"))).otherwise(F.col("shown"))
    )
    return rows.select(
        "page_id",
        "section_index",
        "block_index",
        "seq",
        "unit",
        "indent",
        "node_type",
        "tag",
        "heading_level",
        "number",
        F.concat(pad, marker, plain).alias("line"),
        F.concat(pad, marker, marked).alias("marked"),
    )


def _joined(c: str) -> Column:
    """Lines in order: a line end inside a unit, an empty line between units."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "unit", F.col(c).alias("t"))))
    glued = F.aggregate(
        rows,
        F.struct(F.lit("").alias("t"), F.lit(-1).alias("unit")),
        lambda a, x: F.struct(
            F.concat(a["t"], F.when(a["unit"] < 0, "").when(a["unit"] == x["unit"], "\n").otherwise("\n\n"), x["t"]).alias("t"),
            x["unit"].alias("unit"),
        ),
    )
    return glued["t"]


PLACE = ["page_id", "section_index", "block_index"]


def blocks(nodes: DataFrame) -> DataFrame:
    """A row a block: place, block_type, tag, class, title, heading_level, list_start, text (C4), children (for units).

    Blocks are the elements right below the content of a section; navigation and footers are none. ``children``: what stands
    inside a special block, as the units of chunking take it.
    """
    top = nodes.where("block_index is not null")
    first = Window.partitionBy(*PLACE).orderBy("seq")
    top = top.withColumn("r", F.row_number().over(first)).where("r = 1").select(
        *PLACE,
        F.col("node_type").alias("block_type"),
        "tag",
        "class",
        "title",
        "heading_level",
        "list_start",
        F.col("node_path").alias("path"),
        F.col("seq").alias("top_seq"),
    )
    shown = outline(nodes)
    texts = shown.groupBy(*PLACE).agg(_joined("line").alias("text"))
    # Inside special blocks: one child a unit, but the title; the items of a list stay apart, each with what is nested in it.
    special = top.where(
        (
            "title is not null or block_type in ('learning_objectives', 'worked_example', 'key_takeaways', 'exercise_set', 'feature', "
            "'textbox')"
        )
    ).select(*PLACE, "top_seq")
    inner = shown.join(special, PLACE).where("seq <> top_seq")
    unit = [*PLACE, "unit"]
    heads = (F.col("tag") == "li") & (F.col("indent") == F.min("indent").over(Window.partitionBy(*unit)))
    inner = inner.withColumn("head", heads).withColumn(
        "place",
        F.sum(F.col("head").cast("int")).over(
            Window.partitionBy(*unit).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    bare = F.trim(F.when(F.col("head"), F.regexp_replace("line", r"^\s*(\d+\.|-) ", "")).otherwise(F.col("line")))
    item = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", bare.alias("t")))), lambda x: x["t"]), "\n\n")
    items = inner.where("place > 0").groupBy(*unit, "place").agg(
        F.min_by("number", "seq").alias("number"), item.alias("text"), F.min_by(F.col("line").rlike(r"^\s*\d"), "seq").alias("ordered")
    )
    items = items.groupBy(*unit).agg(
        F.array_sort(F.collect_list(F.struct("place", "number", "text"))).alias("items"), F.bool_or("ordered").alias("ordered")
    )
    child = inner.groupBy(*unit).agg(
        F.min("seq").alias("seq"), F.min_by("node_type", "seq").alias("kind"), _joined("line").alias("text")
    ).join(items, unit, "left").withColumn("node_type", F.when(F.col("items").isNotNull(), "list").otherwise(F.col("kind")))
    packed = F.struct(
        "seq",
        "node_type",
        "text",
        "ordered",
        F.transform("items", lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text"))).alias("items"),
    )
    children = child.groupBy(*PLACE).agg(
        F.transform(
            F.array_sort(F.collect_list(packed)),
            lambda x: F.struct(
                x["node_type"].alias("node_type"), x["text"].alias("text"), x["ordered"].alias("ordered"), x["items"].alias("items")
            ),
        ).alias("children")
    )
    return top.join(texts, PLACE, "left").join(children, PLACE, "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    ).drop("path", "top_seq")


def links(nodes: DataFrame) -> DataFrame:
    """Links with their text, in order, once a page and target."""
    first = nodes.where("tag = 'a' and href <> ''").groupBy("page_id", "href").agg(
        F.min_by("text", "seq").alias("text"), F.min("seq").alias("seq")
    )
    return first.withColumn("link_index", F.row_number().over(Window.partitionBy("page_id").orderBy("seq")) - 1)


def block_links(nodes: DataFrame) -> DataFrame:
    """Every link of the blocks."""
    return nodes.where("tag = 'a' and href is not null and block_index is not null").select(
        *PLACE, "seq", "href", F.coalesce("class", F.lit("")).alias("class"), "text"
    )


def media(nodes: DataFrame) -> DataFrame:
    """Images that aren't formulae, with source, alternative text, caption and size."""
    own = (F.col("tag") == "img") & ~F.coalesce(F.contains("class", F.lit(FORMULA_CLASS)), F.lit(False))
    return nodes.where(own).select(
        *PLACE, "seq", "src", F.trim(F.regexp_replace(F.coalesce("alt", F.lit("")), r"\s+", " ")).alias("alt"), "caption", "width", "height"
    )


def formulae(nodes: DataFrame) -> DataFrame:
    """Formula images, then sub- and superscripts of each block, once each, in order."""
    kind = F.when(
        (F.col("tag") == "img") & F.contains("class", F.lit(FORMULA_CLASS)), "latex_image"
    ).when(F.col("tag") == "sub", "subscript").when(F.col("tag") == "sup", "superscript")
    value = F.trim(
        F.regexp_replace(F.coalesce(F.when(F.col("tag") == "img", F.col("alt")).otherwise(F.col("text")), F.lit("")), r"\s+", " ")
    )
    found = nodes.where("block_index is not null and tag in ('img', 'sub', 'sup')").select(
        *PLACE, kind.alias("kind"), value.alias("value"), F.when(F.col("tag") == "img", F.col("src")).alias("source"), "seq"
    ).where("kind is not null and value <> ''")
    once = found.groupBy(*PLACE, "kind", "value", "source").agg(F.min("seq").alias("seq"))
    return once.withColumn("formula_index", F.row_number().over(Window.partitionBy(*PLACE).orderBy("kind", "seq")) - 1)


def tables(nodes: DataFrame) -> DataFrame:
    """A row a table: caption and cells of its rows in order."""
    heads = nodes.where("tag = 'table' and block_index is not null").select(
        *PLACE, F.col("node_path").alias("path"), F.col("unit").alias("table_unit"), "caption", F.col("seq").alias("table_seq")
    )
    rows = nodes.where("tag = 'tr' and block_index is not null").select(*PLACE, "node_path", "seq", "cells")
    inside = rows.join(heads.select(*PLACE, "path"), PLACE).where(F.startswith("node_path", F.concat("path", F.lit("."))))
    cells = inside.groupBy(*PLACE, "path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "cells"))), lambda x: x["cells"]).alias("rows")
    )
    return heads.join(cells, [*PLACE, "path"], "left").select(
        *PLACE, "table_seq", "caption", F.coalesce("rows", F.array().cast("array<array<string>>")).alias("rows")
    )


def books(nodes: DataFrame) -> DataFrame:
    """Metadata of each page's book: title, language, publisher, year, licence, authors; chapter title and introduction."""
    m = (F.col("tag") == "meta") & (F.trim(F.coalesce("content", F.lit(""))) != "")
    value = F.trim(F.regexp_replace("content", r"\s+", " "))
    first = {c: F.min_by(F.when(m & (F.col("name") == n), value), F.when(m & (F.col("name") == n), F.col("seq"))) for c, n in BOOK.items()}
    authors = F.transform(
        F.array_sort(F.collect_list(F.when(m & (F.col("name") == "pb-authors"), F.struct("seq", value.alias("v"))))), lambda x: x["v"]
    )
    part = (F.col("tag") == "h1") & F.coalesce(F.contains("class", F.lit("part-title")), F.lit(False))
    intro = (F.col("tag") == "div") & F.coalesce(F.contains("class", F.lit("part-ugc")), F.lit(False))
    out = nodes.groupBy("page_id").agg(
        *[v.alias(c) for c, v in first.items()],
        authors.alias("authors"),
        F.min_by(F.when(part, F.col("own_text")), F.when(part, F.col("seq"))).alias("chapter_title"),
        F.min_by(F.when(intro, F.col("own_text")), F.when(intro, F.col("seq"))).alias("chapter_intro"),
        F.min_by(F.when(F.col("tag") == "title", F.col("own_text")), F.when(F.col("tag") == "title", F.col("seq"))).alias("page_title"),
        F.count_if((F.col("tag") == "div") & F.array_contains(F.split("class", r"\s+"), "chapter")).alias("n"),
    )
    return out.withColumns(
        {
            "book_title": F.coalesce("book_title", F.lit("Untitled")),
            "language": F.coalesce("language", F.lit("en")),
            "chapter_intro": F.coalesce("chapter_intro", F.lit("")),
        }
    ).withColumn("section_count", F.greatest("n", F.lit(1))).drop("n")


def sections(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """A record a section: title, text of its blocks in order, counts by block type, book, hashes."""
    b = blocks(nodes)
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("block_index", "text"))))
    s = b.groupBy("page_id", "section_index").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"),
        F.count("*").alias("block_count"),
        F.min_by("text", F.when(F.col("block_type") == "heading", F.col("block_index"))).alias("first_heading"),
    )
    counts = b.groupBy("page_id", "section_index", "block_type").agg(F.count("*").alias("n")).groupBy("page_id", "section_index").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_type", "n")))).alias("block_type_counts")
    )
    extra = [
        rows.groupBy("page_id", "section_index").agg(F.count("*").alias(n))
        for n, rows in (
            ("formula_count", formulae(nodes)),
            ("media_count", media(nodes).where("block_index is not null")),
            ("table_count", tables(nodes)),
        )
    ]
    p = pages.select(
        F.col("page_id").cast("long"),
        "url",
        F.regexp_extract("url", r"//([^/]*)", 1).alias("host"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("source_sha256"),
    )
    out = s.join(counts, ["page_id", "section_index"]).join(p, "page_id").join(books(nodes), "page_id")
    for e in extra:
        out = out.join(e, ["page_id", "section_index"], "left")
    out = out.fillna(0, ["formula_count", "media_count", "table_count"])
    return out.withColumns(
        {"section_title": F.coalesce("first_heading", "page_title", F.lit("")), "content_sha256": F.sha2("text", 256)}
    ).drop("first_heading")


def chapter_report(section_rows: DataFrame, chapter: str = "host") -> DataFrame:
    """Sections, blocks, characters, formulae, media and tables of each chapter."""
    total = {"block_count": "block_count", "formula_count": "formula_count", "media_count": "media_count", "table_count": "table_count"}
    return section_rows.groupBy(chapter).agg(
        F.count("*").alias("section_count"), F.sum(F.length("text")).alias("char_count"), *[F.sum(c).alias(n) for n, c in total.items()]
    )


def block_type_counts(block_rows: DataFrame) -> DataFrame:
    """Blocks by type of each section."""
    return block_rows.groupBy("page_id", "section_index", "block_type").agg(F.count("*").alias("n"))


def markdown(nodes: DataFrame) -> DataFrame:
    """C4: review text of each section: a line for each block's number and type, then its outline."""
    shown = outline(nodes).groupBy(*PLACE).agg(_joined("marked").alias("body"))
    b = blocks(nodes).select(*PLACE, "block_type").join(shown, PLACE, "left")
    body = F.concat(
        F.lit("### Block "),
        F.col("block_index").cast("string"),
        F.lit(": `"),
        "block_type",
        F.lit("`\n\n"),
        F.coalesce("body", F.lit("_[empty structured node]_")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("block_index", body.alias("t"))))
    return b.groupBy("page_id", "section_index").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("markdown"))


def structure_audit(nodes: DataFrame) -> DataFrame:
    """Titles and headings of worked examples, and whether they stand as such in the review markdown of their section."""
    top = blocks(nodes).where("block_type = 'worked_example'").select(*PLACE, "title")
    heads = outline(nodes).where("node_type = 'heading'").join(top.drop("title"), PLACE, "left_semi").select(
        *PLACE, "seq", F.trim("line").alias("name"), F.lit("heading").alias("kind")
    )
    names = top.where("title <> ''").select(
        *PLACE, F.lit(-1).alias("seq"), F.col("title").alias("name"), F.lit("title").alias("kind")
    ).union(heads)
    wanted = F.when(F.col("kind") == "title", F.concat(F.lit("**"), "name", F.lit("**"))).otherwise(F.concat(F.lit("#### "), "name"))
    lines = F.transform(F.split("markdown", "\n"), lambda x: F.regexp_replace(F.trim(x), r"^#{4,6} ", "#### "))
    found = names.join(markdown(nodes), ["page_id", "section_index"], "left")
    return found.select(*PLACE, "seq", "kind", "name", (~F.coalesce(F.array_contains(lines, wanted), F.lit(False))).alias("missing"))

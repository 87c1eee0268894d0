"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate of its host when the pages of the host that contain it, divided by all pages of the host,
exceed a ratio. Counting explodes only 16-byte (host, line hash) pairs and is combined before the shuffle, so neither
a host with a third of all pages nor a line on every page gathers in one task.

The boilerplate of one host is bounded by arithmetic: each listed line is on more than ``max_ratio`` of the pages, so
there are fewer than (mean distinct lines a page) / ``max_ratio`` of them. That short list joins back to the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, packed

MAX_RATIO = 0.1
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(
    pages: DataFrame, *, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Host and the hashes of its boilerplate lines: ``_host``, ``_host_pages``, ``_drop`` (array of long)."""
    rows = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(text).alias("_text"))
    totals = rows.groupBy("_host").agg(F.count("*").alias("_host_pages"))
    counts = (
        rows.where("_text is not null")
        .select("_host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), _has_word), _hash))).alias("_line"))
        .groupBy("_host", "_line").agg(F.count("*").alias("_pages"))
        .where(F.col("_pages") >= min_pages)
    )
    frequent = counts.join(totals, "_host").where(F.col("_pages") > F.lit(float(max_ratio)) * F.col("_host_pages"))
    return frequent.groupBy("_host").agg(F.max("_host_pages").alias("_host_pages"), F.sort_array(F.collect_set("_line")).alias("_drop"))


def dedup_lines(
    pages: DataFrame,
    *,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    keep_boilerplate_pages: bool = False,
) -> DataFrame:
    """All rows and columns of ``pages``, ``text`` without boilerplate lines, plus ``line_total`` and ``line_dropped`` (long).

    * A line counts once a page, however often the page repeats it; all its places on the page go.
    * Lines without a word are neither counted nor dropped; other lines keep their order and line ends.
    * A line on fewer than ``min_pages`` pages of the host stays, whatever its ratio (small hosts).
    * A page made of boilerplate only is left with its blank lines, or stays as it is with ``keep_boilerplate_pages``.
    * Null text stays null with zero lines; the empty text has zero lines with a word. A null host is a host of its own
      (with the empty name). Repeated rows count as pages of their own. An empty table gives an empty table.
    * Columns named like the results are replaced; any other column passes through.
    """
    scratch = Scratch(pages.sparkSession)
    own = [c for c in pages.columns if c not in ("line_total", "line_dropped")]
    # Written, so that its size is known when the join is planned: below Spark's broadcast limit no text is shuffled.
    found = scratch.save(boilerplate(pages, host=host, text=text, max_ratio=max_ratio, min_pages=min_pages), "boilerplate")
    rows = pages.select(
        packed(pages, own).alias("row"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(text).alias("text")
    )
    joined = rows.join(found.select("_host", "_drop"), "_host", "left")
    lines = _lines(F.coalesce("text", F.lit("")))
    dropped = lambda x: F.array_contains("_drop", _hash(x))
    marked = joined.withColumn(
        "kept", F.when(F.col("_drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~_has_word(x) | ~dropped(x)))
    )
    marked = marked.withColumns(
        {"total": F.size(F.filter(lines, _has_word)).cast("long"), "left": F.size(F.filter("kept", _has_word)).cast("long")}
    )
    whole = F.col("_drop").isNull()
    if keep_boilerplate_pages:
        whole = whole | (F.col("left") == 0)
    shown = F.when(F.col("text").isNull() | whole, F.col("text")).otherwise(F.array_join("kept", "\n"))
    return marked.select(
        *[shown.alias(c) if c == text else F.col("row")[c].alias(c) for c in own],
        F.col("total").alias("line_total"),
        F.when(whole, F.lit(0)).otherwise(F.col("total") - F.col("left")).cast("long").alias("line_dropped"),
    )

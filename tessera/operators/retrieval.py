"""Index contracts, filtered exact kNN, diversity, context packing, citations, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import nearest

# Search and context sizes, the smallest remainder worth filling, and the texts that are shown.
TOP_K, CANDIDATES, PER_SECTION, CONTEXT_CHARS, LEAST_REST = 4, 12, 2, 6500, 120
REVIEW_CHARS = 1200
TRUNCATED = "\n[truncated]"
SEPARATOR = "\ntext:\n"
NO_HITS = "No relevant textbook passages were retrieved for this question. Use general knowledge cautiously and return an empty source_ids list."
TOO_SMALL = "Relevant sources were found, but the RAG context budget was too small. Return an empty source_ids list."


def metadata_filter(rows: DataFrame, *, default_only: bool = True, **equal: str | int | None) -> DataFrame:
    """Default chunks unless told otherwise, and equality of the given fields; applied before any top-k."""
    out = rows.where("default_retrieval") if default_only else rows
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    return out


def index_input(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable chunks, errors). Blank required texts and repeated ids are errors; a missing default flag is true."""
    blank = lambda c: text.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    broken = F.array_compact(F.array(*[F.when(blank(c), c) for c in ("id", "text", "embedding_text")]))
    marked = chunks.withColumns({"broken": broken, "default_retrieval": F.coalesce("default_retrieval", F.lit(True))})
    twice = chunks.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem"))
    errors = marked.where(F.size("broken") > 0).select("id", F.array_join("broken", ",").alias("problem")).union(twice)
    return marked.where(F.size("broken") == 0).drop("broken"), errors


def flat_metadata(rows: DataFrame, columns: list[str]) -> Column:
    """P10: the columns as one JSON object without nulls; arrays, maps and structs become JSON text, other values stay as they are."""
    types = dict(rows.dtypes)
    plain = lambda c: F.to_json(c) if types[c].startswith(("array", "map", "struct")) else F.col(c)
    return F.to_json(F.struct(*[plain(c).alias(c) for c in columns]))


def content_hash(rows: DataFrame, key: str, content: str) -> Column:
    """Aggregate over keys and contents of rows in any order: the sum of 60 bits of each row's md5, as decimal text.

    A sum, so that equal rows count each; a changed, missing or repeated row changes it. A null key or content is a value of its own.
    """
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    digest = F.conv(F.substring(F.md5(F.concat(value(key), F.lit("\x1f"), value(content))), 1, 15), 16, 10)
    return F.coalesce(F.sum(digest.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


def manifest(source: DataFrame, index: DataFrame, key: str = "id", content: str = "text", vector: str = "vector") -> DataFrame:
    """One row: counts, vector size and content hashes of the source chunks and of what was indexed.

    ``complete``: as many rows in both, none without a vector. ``current``: ids and contents are the same, so that a text
    that was changed after indexing is noticed.
    """
    a = source.agg(
        F.count("*").alias("source_count"),
        F.count_if("default_retrieval").alias("default_count"),
        content_hash(source, key, content).alias("source_hash"),
    )
    b = index.agg(
        F.count("*").alias("indexed_count"),
        F.count(vector).alias("vector_count"),
        F.max(F.size(vector)).alias("vector_dimension"),
        content_hash(index, key, content).alias("indexed_hash"),
    )
    both = a.join(b, F.lit(True))
    return both.withColumns(
        {
            "complete": (F.col("source_count") == F.col("indexed_count")) & (F.col("vector_count") == F.col("indexed_count")),
            "current": F.col("source_hash") == F.col("indexed_hash"),
        }
    )


def knn(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, metric: str = "l2sq") -> DataFrame:
    """query_id, rank, chunk_id, distance: the exact k nearest chunks, ties to the smaller id."""
    if metric not in ("l2sq", "cosine"):
        raise ValueError(f"unknown metric: {metric}")
    return nearest.top_k(queries, chunks, k, metric)


def batch_review(tests: DataFrame, hits: DataFrame, max_chars: int = REVIEW_CHARS) -> DataFrame:
    """T4: a row for each hit of each test query, for review: rank, score, chunk, its place, text, and which topics it mentions.

    ``tests``: query_id, query, expected_topics; a blank query is an error. ``hits``: query_id, rank, chunk_id, distance, text,
    chapter_number, section, retrieval_group. Texts above ``max_chars`` are cut and end in an ellipsis (0: never); topics are
    looked for in the whole text, in any case. A query without hits keeps one row.
    """
    if not (blank := tests.where(text.strip(F.coalesce("query", F.lit(""))) == "").limit(1)).isEmpty():
        raise ValueError(f"test query {blank.first()['query_id']} has no text")
    t = tests.select("query_id", "query", F.coalesce("expected_topics", F.array().cast("array<string>")).alias("expected_topics"))
    body = text.strip(F.coalesce("text", F.lit("")))
    cut = F.concat(F.regexp_replace(F.substring(body, 1, max_chars), r"(?U)\s+\z", ""), F.lit("\n…"))
    # In a step of its own: beside a new column ``text``, a lambda would take that one for the hit's.
    found = F.filter("expected_topics", lambda topic: F.lower(body).contains(F.lower(topic)))
    out = t.join(hits, "query_id", "left").withColumn("found_topics", found)
    return out.select(
        "query_id", "query", "expected_topics", "rank", F.col("distance").alias("score"), "chunk_id", "chapter_number", "section", "retrieval_group",
        (F.when(F.length(body) > max_chars, cut).otherwise(body) if max_chars > 0 else body).alias("text"), "found_topics",
    )


def section_key() -> Column:
    """Parent section, else section, else chapter and section numbers."""
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return F.coalesce(
        blank("parent_section_id"),
        blank("section_id"),
        F.concat_ws(":", F.coalesce("chapter_number", F.lit("")), F.coalesce("section_number", F.lit(""))),
    )


def diversify(hits: DataFrame, top_k: int = TOP_K, candidates: int = CANDIDATES, per_section: int = PER_SECTION) -> DataFrame:
    """The first top_k of the candidates of a query, each chunk once, no blank text, so many a section; labels S1 and on.

    ``hits``: query_id, chunk_id, distance, text, section. Four stacked windows, all by query.
    """
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("distance", "chunk_id"))
    h = hits.withColumn("_n", number("query_id")).where(F.col("_n") <= max(top_k, candidates))
    h = h.where((text.strip(F.coalesce("text", F.lit(""))) != "") & F.col("chunk_id").isNotNull())
    h = h.withColumn("_n", number("query_id", "chunk_id")).where("_n = 1")
    h = h.withColumn("_n", number("query_id", "section")).where(F.col("_n") <= per_section)
    h = h.withColumn("rank", number("query_id")).where(F.col("rank") <= top_k).drop("_n")
    return h.withColumn("label", F.concat(F.lit("S"), F.col("rank").cast("string")))


def pack_context(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """The hits that fit into the budget in rank order; the last one may be cut.

    ``hits``: query_id, rank, header, text. Adds ``block``; a hit is kept while more than LEAST_REST characters are left.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = F.length("header") + len(SEPARATOR) + 2
    h = hits.withColumn("_before", F.coalesce(F.sum(F.length("header") + len(SEPARATOR) + F.length("text") + 2).over(before), F.lit(0)))
    h = h.withColumn("_rest", F.lit(budget) - F.col("_before") - over)
    h = h.withColumn("_fits", F.min((F.col("_rest") > LEAST_REST).cast("int")).over(upto)).where("_fits = 1")
    body = F.when(
        F.length("text") > F.col("_rest"), F.concat(F.regexp_replace(F.expr("substring(text, 1, _rest)"), r"\s+$", ""), F.lit(TRUNCATED))
    ).otherwise(F.col("text"))
    return h.withColumn("block", F.concat("header", F.lit(SEPARATOR), body)).drop("_before", "_rest", "_fits")


def hit_header() -> Column:
    """Label, chunk id, place in the book and kind of a hit, a line each."""
    none = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    place = F.concat_ws(
        " · ",
        F.concat(F.lit("Chapter "), none("chapter_number")),
        F.concat(F.lit("Section "), none("section_number")),
        none("section_title"),
    )
    place = F.coalesce(F.nullif(place, F.lit("")), F.col("chunk_id").cast("string"))
    return F.concat(
        F.lit("["),
        F.col("label"),
        F.lit("]\nchunk_id: "),
        F.col("chunk_id").cast("string"),
        F.lit("\nsource: "),
        place,
        F.lit("\ncontent_type: "),
        F.coalesce(none("chunk_kind"), none("retrieval_group"), F.lit("unknown")),
    )


def contexts(queries: DataFrame, hits: DataFrame, packed: DataFrame) -> DataFrame:
    """A context text for every query; fixed texts where there was no hit, or none fitted. A budget holds a few hits."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "block")))
    full = packed.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("_full"))
    some = hits.select("query_id").distinct().withColumn("_some", F.lit(True))
    out = queries.select("query_id").join(full, "query_id", "left").join(some, "query_id", "left")
    return out.select("query_id", F.coalesce("_full", F.when(F.col("_some"), TOO_SMALL).otherwise(NO_HITS)).alias("context"))


def source_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk's clean text for each hit, else the indexed text."""
    clean = chunks.select("chunk_id", F.col("text").alias("_clean"))
    return hits.join(clean, "chunk_id", "left").withColumn(
        "text", F.coalesce(F.nullif(text.strip(F.col("_clean")), F.lit("")), F.col("indexed_text"))
    ).drop("_clean")


def check_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Cited labels that were retrieved, in order and once each, and those that were not."""
    known = hits.groupBy("query_id").agg(F.collect_set(F.upper("label")).alias("_known"))
    a = answers.join(known, "query_id", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))
    cited = F.array_distinct(
        F.filter(
            F.transform(F.coalesce("source_ids", F.array().cast("array<string>")), lambda x: F.upper(text.strip(x))), lambda x: x != ""
        )
    )
    a = a.withColumn("_cited", cited)
    return a.withColumns(
        {
            "valid_ids": F.filter("_cited", lambda x: F.array_contains("_known", x)),
            "invalid_ids": F.filter("_cited", lambda x: ~F.array_contains("_known", x)),
        }
    ).drop("_known", "_cited")


def trim_history(turns: DataFrame, n: int) -> DataFrame:
    """The last n messages of longer conversations, from their first user message on; shorter ones as they are."""
    conv = Window.partitionBy("conv_id")
    t = turns.withColumns({"_size": F.count("*").over(conv), "_back": F.row_number().over(conv.orderBy(F.col("turn").desc()))})
    t = t.where(F.col("_back") <= n).withColumn("_user", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(conv))
    return t.where((F.col("_size") <= n) | (F.col("turn") >= F.col("_user"))).drop("_size", "_back", "_user")

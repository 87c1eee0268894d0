"""Exact nearest neighbours of a table of queries.

A few queries (up to QUERY_BYTES of vectors, which is counted first) are sent to all tasks in one pass over the chunks. Any
larger number stays a table: chunks are dealt to cells around pivots, and a cell's radius tells how near its chunks
can be to a query at best.
1. Each query is joined to the cells nearest to it that hold k chunks; the k-th distance there bounds what can still come in.
2. Each query is joined to the other cells whose nearest possible chunk isn't farther than that bound.
So a query meets the cells that the triangle inequality leaves open, whatever the number of queries, in a fixed number of jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import save

#: Queries of one product of matrices, and bytes of query vectors up to which they are sent to the tasks.
QUERY_BLOCK, QUERY_BYTES = 512, 16 << 20
#: Chunks of a cell, about, and bytes of pivots at most; chunks and queries that meet in one task; bounds of queries to cells that are made at once.
CELL, PIVOT_BYTES, ROWS, BOUNDS = 1024, 8 << 20, 16384, 1 << 20


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return -np.round(q @ v.T, 6)
    if metric == "cosine":
        d = 1.0 - q @ v.T / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :], 1e-300)
    else:
        d = (q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * q @ v.T
    return np.round(np.maximum(d, 0.0), 6)


def _first_k(query: np.ndarray, distance: np.ndarray, chunk: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query, ties to the smaller chunk, of rows in any order."""
    order = np.lexsort((chunk, distance, query))
    query, distance, chunk = query[order], distance[order], chunk[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, int)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return query[place < k], distance[place < k], chunk[place < k]


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _best(ids: np.ndarray, vectors: np.ndarray, chunk: np.ndarray, v: np.ndarray, k: int, metric: str) -> list[tuple]:
    """(place of the query, distance, chunk) of the k nearest of some chunks for each query, with all that tie."""
    found = []
    for start in range(0, len(ids), QUERY_BLOCK):
        d = _distances(vectors[start : start + QUERY_BLOCK], v, metric)
        far = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        q, c = np.nonzero(d <= far[:, None])
        found.append((q + start, d[q, c], chunk[c]))
    return found


def _nearest(shared, k: int, metric: str):
    """Batches (chunk_id, vector) to the k nearest of them for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        best = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            found = [best, *_best(ids, vectors, chunk, v, k, metric)]
            best = _first_k(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        yield pa.RecordBatch.from_pydict(
            {"query_id": pa.array(ids[best[0]]), "chunk_id": pa.array(best[2].astype(np.int64)), "distance": pa.array(best[1])}
        )

    return run


def _away(v: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """Distances (rows x pivots) that keep the triangle inequality: Euclidean, or angles; of a zero vector, all the way round."""
    if metric == "l2sq":
        return np.sqrt(np.maximum((v**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * v @ pivots.T, 0.0))
    length = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(pivots, axis=1)[None, :]
    return np.where(length > 0, np.arccos(np.clip(v @ pivots.T / np.maximum(length, 1e-300), -1.0, 1.0)), np.pi)


def _deal(shared, metric: str):
    """Batches (chunk_id, vector) to (chunk_id, vector, cell, away, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            away = _away(v, pivots, metric)
            cell, length = away.argmin(1), np.linalg.norm(v, axis=1)
            own = away[np.arange(len(v)), cell]
            if metric != "l2sq":
                cell[length == 0] = len(pivots)  # a cell of their own, which is always open
            columns = [*batch.columns[:2], pa.array(cell.astype(np.int32)), pa.array(own), pa.array(length)]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "vector", "cell", "away", "length"])

    return run


def _least(v: np.ndarray, pivots: np.ndarray, cells: np.ndarray, radius: np.ndarray, longest: np.ndarray, metric: str) -> np.ndarray:
    """Distances (queries x cells) below which no chunk of a cell can be; rounding is allowed for."""
    real = cells < len(pivots)
    out = np.full((len(v), len(cells)), -np.inf)
    gap = np.maximum(_away(v, pivots[cells[real]], metric) - radius[real] - 1e-7 * (1 + radius[real]), 0.0)
    if metric == "l2sq":
        out[:, real] = gap**2
    elif metric == "cosine":
        out[:, real] = 1 - np.cos(np.minimum(gap, np.pi))
    else:
        out[:, real] = -np.linalg.norm(v, axis=1)[:, None] * longest[real] * np.maximum(np.cos(np.minimum(gap, np.pi)), 0.0)
    return out - 1e-6 - 1e-9 * np.abs(out)


def _visit(shared, k: int, metric: str, again: bool):
    """Batches (query_id, vector[, bound]) to (query_id, cell): the nearest cells with k chunks, or later all in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells, counts, radius, longest = shared.value
        few = max(1, BOUNDS // max(len(cells), 1))
        for batch in (whole.slice(start, few) for whole in batches for start in range(0, whole.num_rows, few)):
            v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            least = _least(v, pivots, cells, radius, longest, metric)
            if again:
                visit = least <= batch.column(2).to_numpy(zero_copy_only=False)[:, None]
            else:
                order = np.lexsort((np.broadcast_to(np.arange(len(cells)), least.shape), least))
                held = np.cumsum(counts[order], axis=1)
                visit = np.zeros(least.shape, bool)
                np.put_along_axis(visit, order, np.c_[np.zeros(len(v), int), held[:, :-1]] < k, axis=1)
            row, cell = np.nonzero(visit)
            columns = [batch.column(0).take(pa.array(row)), pa.array(cells[cell].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "cell"])

    return run


def _bundles(stats: list) -> list[tuple[int, int, int]]:
    """(cell, bundle, blocks): cells of ROWS chunks together share a bundle; a larger one is a bundle of its own, in blocks."""
    out, bundle, held = [], -1, ROWS
    for cell, n in stats:
        if held + n > ROWS:
            bundle, held = bundle + 1, 0
        out.append((cell, bundle, -(-n // ROWS)))
        held += n
    return out


def _meet(visits: DataFrame, q: DataFrame, dealt: DataFrame, bundles: list[tuple[int, int, int]], k: int, metric: str) -> DataFrame:
    """(query_id, chunk_id, distance): the k nearest of the cells that a query visits in each bundle. A vector is sent once a bundle."""

    def join(queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        ids = queries["query_id"].to_numpy()
        if len(queries) and len(chunks):
            vectors, visited = _rows(queries["vector"]), np.concatenate(queries["cells"].to_list())
            row = np.repeat(np.arange(len(ids)), queries["cells"].map(len))
            for cell, own in chunks.groupby("cell"):
                at = row[visited == cell]
                if not len(at):
                    continue
                best = _best(at, vectors[at], own["chunk_id"].to_numpy(), _rows(own["vector"]), k, metric)
                found += [(at[place], d, c) for place, d, c in best]
        at, d, c = _first_k(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        return pd.DataFrame({"query_id": ids[at], "chunk_id": c, "distance": d}).astype({"query_id": np.int64, "chunk_id": np.int64})

    spark = visits.sparkSession
    plan = spark.createDataFrame(bundles, "cell int, bundle int, blocks int")
    met = save(visits.join(F.broadcast(plan), "cell").groupBy("query_id", "bundle").agg(F.collect_list("cell").alias("cells")))
    blocks = {bundle: n for _, bundle, n in bundles}
    loads = met.groupBy("bundle").agg(F.count("*").alias("n")).collect()  # a row a bundle
    parts = spark.createDataFrame([(r["bundle"], blocks[r["bundle"]], -(-r["n"] // ROWS)) for r in loads], "bundle int, blocks int, parts int")
    number = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = "bundle", "block", "part"
    mine = met.join(F.broadcast(parts), "bundle").join(q.select("query_id", "vector"), "query_id").select(
        "query_id", "vector", "cells", "bundle", number("query_id", "parts").alias("part"), each("blocks").alias("block")
    )
    theirs = dealt.join(F.broadcast(plan.drop("blocks")), "cell").join(F.broadcast(parts), "bundle").select(
        "chunk_id", "vector", "cell", "bundle", number("chunk_id", "blocks").alias("block"), each("parts").alias("part")
    )
    return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(join, "query_id long, chunk_id long, distance double")


def cell_table(rows: DataFrame, metric: str, cell: int = CELL):
    """(dealt chunks, pivots, cells): a pivot for each ``cell`` chunks, as far as PIVOT_BYTES allow; cells: (number, count, radius, longest)."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    want = max(1, min(-(-n // cell), PIVOT_BYTES // (8 * max(size, 1))))
    draw = F.pmod(F.xxhash64("chunk_id", F.lit(7)), F.lit(1 << 40))
    sample = rows.where(draw < F.lit(int((1 << 40) * min(1.0, want / max(n, 1))))).select("vector").toArrow()
    if not sample.num_rows:
        sample = rows.select("vector").limit(1).toArrow()
    pivots = np.stack(sample["vector"].to_numpy()).astype(np.float64) if sample.num_rows else np.zeros((1, size))
    dealt = rows.mapInArrow(
        _deal(rows.sparkSession.sparkContext.broadcast(pivots), metric), "chunk_id long, vector array<double>, cell int, away double, length double"
    )
    dealt = save(dealt)
    stats = dealt.groupBy("cell").agg(F.count("*"), F.max("away"), F.max("length")).orderBy("cell").collect()  # a row a cell
    return dealt, pivots, stats


def _by_cells(q: DataFrame, rows: DataFrame, k: int, metric: str, cell: int) -> DataFrame:
    dealt, pivots, stats = cell_table(rows, metric, cell)
    if not stats:
        return q.sparkSession.createDataFrame([], "query_id long, chunk_id long, distance double, rank int")
    columns = [np.array(c) for c in zip(*stats, strict=True)]
    bundles = _bundles([(r[0], r[1]) for r in stats])
    shared = q.sparkSession.sparkContext.broadcast((pivots, *columns))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    schema = "query_id long, cell int"
    first = save(q.mapInArrow(_visit(shared, k, metric, False), schema))
    near = save(best(_meet(first, q, dealt, bundles, k, metric)))
    bound = near.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound")
    )
    reach = q.join(bound, "query_id").select("query_id", "vector", "bound").mapInArrow(_visit(shared, k, metric, True), schema)
    later = save(reach.join(first, ["query_id", "cell"], "left_anti"))
    return best(near.drop("rank").unionByName(_meet(later, q, dealt, bundles, k, metric))).select("query_id", "chunk_id", "distance", "rank")


def top_k(
    queries: DataFrame, chunks: DataFrame, k: int, metric: str, *, send_bytes: int = QUERY_BYTES, cell: int = CELL
) -> DataFrame:
    """query_id, chunk_id, distance, rank: the exact k nearest chunks, ties to the smaller id.

    Metrics: ``l2sq``, ``cosine``, and ``dot`` (the product with its sign turned). Queries of at most ``send_bytes`` are sent to
    all tasks, and the chunks are read once for them; each task keeps its k best of a query, so the shuffle carries k rows a query
    and task. More queries meet the chunks cell by cell. Query ids are unique; rows without a vector play no part.
    """
    spark = chunks.sparkSession
    q = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).where("vector is not null")
    rows = chunks.select(F.col("chunk_id").cast("long"), F.col("vector").cast("array<double>")).where("vector is not null")
    n, size = q.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if n * size * 8 > send_bytes:
        return _by_cells(q, rows, k, metric, cell)
    own = q.toArrow()
    vectors = np.stack(own["vector"].to_numpy()) if own.num_rows else np.empty((0, size))
    shared = spark.sparkContext.broadcast((own["query_id"].to_numpy(), vectors))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    found = rows.mapInArrow(_nearest(shared, k, metric), "query_id long, chunk_id long, distance double")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)

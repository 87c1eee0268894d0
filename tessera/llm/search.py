"""Exact top-k BM25 search: an inverted index by shards, block-max WAND in each, an exact merge.

Shards are runs of documents of one input partition, of bounded size, so building the index shuffles nothing. Documents of
a shard are numbered by id; a row for the empty word lists the ids. Any other row of the index is a block: up to BLOCK
postings of one word in one shard, with the largest frequency and the shortest length
in it, from which any average length gives an upper bound of its scores. Global statistics (documents, mean length,
document frequencies) are summed over all shards before the search, so scores don't depend on the sharding. Each shard
returns its k best for each query; the k best of these are exact.

Queries are a table, too: their words are joined to the index, and only the postings of these words go on, keyed by shard and
block of queries; a block goes to the shards that hold one of its words. A task has the postings of one shard for one block of queries, and the queries of that block.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import LOWER, UPPER, Scratch, lower_ascii, words

K = 10
K1, B = 1.2, 0.75
BLOCK = 64
#: Bounds of a shard.
SHARD_DOCS, SHARD_WORDS = 4096, 4_000_000
#: Queries that are searched together in a shard, about.
QUERY_BLOCK = 4096
#: Scores are compared after rounding to so many places; ties go to the smaller doc_id.
PLACES = 6

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_NAMES = ["shard", "word", "block", "docs", "tf", "length", "max_tf", "min_length", "ids"]
#: Docs are places in the shard; the row of the empty word has the ids of all places.
INDEX_SCHEMA = "shard long, word string, block int, docs array<int>, tf array<int>, length array<int>, max_tf int, min_length int, ids array<{kind}>"


def tokens(t: str | None) -> list[bytes]:
    return (t or "").encode().translate(_LOWER).split()


def _flush(shard: int, ids: list, bags: list[list[bytes]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The blocks of one shard, word by word, documents by id."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    vocabulary: dict[bytes, int] = {}
    words = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in bags[i]), np.int64, len(bags[i])) for i in order]
    lengths = np.array([len(w) for w in words], np.int64)
    code = np.concatenate([w * len(ids) + d for d, w in enumerate(words)] or [np.empty(0, np.int64)])
    code, tf = np.unique(code, return_counts=True)
    word, doc = code // len(ids), code % len(ids)
    new = np.r_[True, word[1:] != word[:-1]] if len(word) else np.empty(0, bool)
    start_of_word = np.maximum.accumulate(np.where(new, np.arange(len(word)), 0))
    place = np.arange(len(word)) - start_of_word
    starts = np.flatnonzero(place % BLOCK == 0)
    names = np.array([w.decode() for w in vocabulary], object)
    size = lengths[doc]
    # The shard's own row: the id of each place.
    none, zero = pa.array([[]], pa.list_(pa.int32())), pa.array([0], pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard]), pa.array([""]), zero, none, none, none, zero, zero, pa.array([[ids[i] for i in order]], pa.list_(kind))],
        names=_NAMES,
    )
    # Slices of a size that Arrow takes easily.
    for a in range(0, len(starts), 50_000):
        s = starts[a : a + 50_000]
        end = starts[a + 50_000] if a + 50_000 < len(starts) else len(word)
        offsets = pa.array(np.r_[s, end] - s[0], pa.int32())
        part = slice(s[0], end)
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(x[part].astype(k), pa.from_numpy_dtype(k)))
            for x, k in ((doc, np.int32), (tf, np.int32), (size, np.int32))
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(s), shard)),
                pa.array(names[word[s]], pa.string()),
                pa.array((place[s] // BLOCK).astype(np.int32)),
                *lists,
                pa.array(np.maximum.reduceat(tf[part], s - s[0]).astype(np.int32)),
                pa.array(np.minimum.reduceat(size[part], s - s[0]).astype(np.int32)),
                pa.nulls(len(s), pa.list_(kind)),
            ],
            names=_NAMES,
        )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, task = count(), TaskContext.get().partitionId()
    ids: list = []
    bags: list[list[bytes]] = []
    held = 0
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            bag = tokens(t.as_py())
            if not bag:
                continue
            ids.append(i)
            bags.append(bag)
            held += len(bag)
            if len(ids) >= SHARD_DOCS or held >= SHARD_WORDS:
                yield from _flush(task << 32 | next(numbers), ids, bags, kind)
                ids, bags, held = [], [], 0
    if ids:
        yield from _flush(task << 32 | next(numbers), ids, bags, kind)


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of INDEX_SCHEMA for all rows with a doc_id and a word. Save it before use: shard numbers go by partition."""
    return docs.where(F.col(doc_id).isNotNull()).select(doc_id, text).mapInArrow(
        _build, INDEX_SCHEMA.format(kind=dict(docs.dtypes)[doc_id])
    )


class _Cursor:
    """Postings of one query word in one shard."""

    __slots__ = ("at", "block", "bounds", "docs", "impacts", "last", "most", "now")

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, float]]):
        self.docs = [b[0].tolist() for b in blocks]
        self.impacts = [b[1].tolist() for b in blocks]
        self.bounds = [b[2] for b in blocks]
        self.last = [d[-1] for d in self.docs]
        self.most, self.block, self.at, self.now = max(self.bounds), 0, 0, self.docs[0][0]

    def seek(self, doc: int) -> None:
        """To the first posting at doc or later; ``now`` is None at the end."""
        b = bisect_left(self.last, doc, self.block)
        if b == len(self.last):
            self.now = None
            return
        self.at = bisect_left(self.docs[b], doc, self.at if b == self.block else 0)
        self.block, self.now = b, self.docs[b][self.at]

    def shallow(self, doc: int) -> tuple[float, int]:
        """Bound of the block that may hold doc, and its last document."""
        b = bisect_left(self.last, doc, self.block)
        return (self.bounds[b], self.last[b]) if b < len(self.last) else (0.0, 1 << 62)


def block_max_wand(cursors: list[_Cursor], k: int) -> list[tuple[float, int]]:
    """The k best (score, doc), ties to the smaller doc. A bound prunes only if it is below the k-th score for sure."""
    heap: list[tuple[float, int]] = []
    slack = 2 * 10.0**-PLACES
    while True:
        cursors = sorted((c for c in cursors if c.now is not None), key=lambda c: c.now)
        if not cursors:
            break
        floor = heap[0][0] - slack if len(heap) == k else -1.0
        bound, pivot = 0.0, None
        for i, c in enumerate(cursors):
            bound += c.most
            if bound >= floor:
                pivot = i
                break
        if pivot is None:
            break
        doc = cursors[pivot].now
        while pivot + 1 < len(cursors) and cursors[pivot + 1].now == doc:
            pivot += 1
        near = [c.shallow(doc) for c in cursors[: pivot + 1]]
        if sum(x for x, _ in near) < floor:
            # No document up to the end of these blocks, or to the next word's posting, can get in.
            after = min(e for _, e in near) + 1
            if pivot + 1 < len(cursors):
                after = min(after, cursors[pivot + 1].now)
            for c in cursors[: pivot + 1]:
                if c.now < max(after, doc + 1):
                    c.seek(max(after, doc + 1))
        elif cursors[0].now == doc:
            score = round(sum(c.impacts[c.block][c.at] for c in cursors[: pivot + 1]), PLACES)
            entry = (score, -doc)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            for c in cursors[: pivot + 1]:
                c.seek(doc + 1)
        else:
            for c in cursors[:pivot]:
                if c.now < doc:
                    c.seek(doc)
    return sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1]))


def _searcher(mean: float, k: int):
    """Searches one shard for a block of queries: (postings, queries) to (query_id, doc_id, score)."""

    def run(postings: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        blocks: dict[str, list] = {}
        ids: list = []
        for r in postings.sort_values(["word", "block"]).itertuples():
            if not r.word:
                ids = list(r.ids)
                continue
            tf, size = np.asarray(r.tf, float), np.asarray(r.length, float)
            impact = r.idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            bound = r.idf * r.max_tf * (K1 + 1) / (r.max_tf + K1 * (1 - B + B * r.min_length / mean))
            blocks.setdefault(r.word, []).append((np.asarray(r.docs), impact, float(bound)))
        rows = []
        for q in queries.itertuples():
            cursors = [_Cursor(blocks[w]) for w in q.words if w in blocks]
            rows += [(q.query_id, ids[doc], score) for score, doc in block_max_wand(cursors, k)]
        return pd.DataFrame(rows, columns=["query_id", "doc_id", "score"])

    return run


def search(
    docs: DataFrame,
    queries: DataFrame,
    *,
    k: int = K,
    doc_id: str = "doc_id",
    text: str = "text",
    query_id: str = "query_id",
    query_text: str = "text",
) -> DataFrame:
    """The k best documents of each query: query_id, rank (from 1), doc_id, score (BM25, rounded).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)) over all documents with a word. Words: between ASCII white space, A-Z
    lower-cased; a query counts each word once, and rows of one query id are one query. Documents that share no word with a
    query are no results, so a query may have fewer than k, or none (null and empty texts, no documents). Ties go to the
    smaller doc_id. Documents without id aren't indexed; repeated rows are results each. Null query ids are left out. Ids keep
    their types.
    """
    scratch = Scratch(docs.sparkSession)
    index = scratch.save(build_index(docs, doc_id=doc_id, text=text), "index")
    # Each posting adds its document's frequency of the word to the words of all documents; the shards' own rows count these.
    total, n = index.agg(
        F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.when(F.col("word") == "", F.size("ids")))
    ).first()
    n = n or 0
    mean = (total or 0) / n if n else 1.0

    each = F.explode(F.array_distinct(words(lower_ascii(F.col(query_text))))).alias("word")
    asked = scratch.save(queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), each).distinct(), "asked")
    parts = max(1, -(-asked.select("query_id").distinct().count() // QUERY_BLOCK))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    # Postings of the words that are asked for, each once for a block of queries that has the word, and the shards' own rows.
    df = index.where("word <> ''").join(
        asked.select("word").distinct(), "word", "left_semi"
    ).groupBy("word").agg(F.sum(F.size("docs")).alias("df"))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    wanted = scratch.save(asked.select("part", "word").distinct().join(df, "word").select("part", "word", idf), "wanted")
    near = index.where("word <> ''").join(wanted, "word")
    # Shards and blocks of queries that have a word in common; others never meet.
    meet = index.where("word <> ''").select("shard", "word").distinct().join(wanted.select("part", "word"), "word")
    meet = scratch.save(meet.select("shard", "part").distinct(), "meet")
    own = index.where("word = ''").join(meet, "shard").withColumn("idf", F.lit(0.0))
    near = near.unionByName(own)
    grouped = asked.groupBy("part", "query_id").agg(F.collect_set("word").alias("words"))
    wide = grouped.join(meet, "part")
    kinds = dict(queries.dtypes)[query_id], dict(docs.dtypes)[doc_id]
    found = near.groupBy("shard", "part").cogroup(wide.groupBy("shard", "part")).applyInPandas(
        _searcher(mean, k), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

"""Ranked lexical search for a set of items, reversed: the items are indexed, the documents stream through the index.

Items (test questions, say) are few next to the documents, so the index is built over the items' terms and sent to the tasks.
1. The items' terms are dealt to blocks of about BLOCK_BYTES, so that what is sent has a bound whatever the number of items;
   each block takes one pass over the documents.
2. A document's terms are counted once: its length and the counts of the terms that an item of the block has go to a narrow
   table. The number of documents, their length and the document frequencies are sums over it, so they cover all documents.
3. The narrow table streams through the inverted index. A task keeps a heap of the k best for each item; a document that
   doesn't beat an item's root costs no heap operation. A task returns its heaps, at most k rows an item, which are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, lower_ascii

K = 10
#: Bytes of item terms (each with OVERHEAD bytes for its places in the index) that are sent to the tasks at once, about.
BLOCK_BYTES, OVERHEAD = 16 << 20, 32
#: Scores, and steps towards them, that a task holds at once.
CELLS = 1 << 20
#: Percent of a document's length norm that follows its length.
LENGTH_PERCENT = 90
#: A term: letters, digits and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes of UTF-8: A-Z lower-cased, what is no part of a term to a blank.
_TERM_BYTES = bytes(b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 or 48 <= b <= 57 else 32 for b in range(256))


def terms(t: str | None) -> list[bytes]:
    return (t or "").encode().translate(_TERM_BYTES).split()


def item_terms(text: Column) -> Column:
    """The distinct terms of an item; a null text has none."""
    return F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def _count(shared):
    """Batches (doc_id, text) to (doc_id, n, terms, tf): documents with a term, counts of the terms of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[bytes, int] = shared.value
        size, get = max(1, len(vocabulary)), vocabulary.get
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            found = []
            for i, t in enumerate(batch.column(1)):
                ts = terms(t.as_py())
                n[i] = len(ts)
                own = [x for x in map(get, ts) if x is not None]
                found.append(np.array(own, np.int64) + i * size)
            code, tf = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            ends = np.searchsorted(code, np.arange(batch.num_rows + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((code % size).astype(np.int32), tf.astype(np.int32))]
            columns = {"doc_id": batch.column(0), "n": pa.array(n), "terms": lists[0], "tf": lists[1]}
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(n > 0))

    return run


class _Heaps:
    """The k best (score, -doc_id) of each item; the roots as arrays, so that most documents are turned away at once."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.floor, self.floor_id = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores (documents x items) of documents."""
        better = (scores > self.floor) | ((scores == self.floor) & (ids[:, None] < self.floor_id))
        doc, item = np.nonzero(better & (scores > 0))
        score, own = scores[doc, item], ids[doc]
        order = np.lexsort((own, -score, item))
        item, score, own = item[order], score[order], own[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, int)
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        first = place < self.k
        for i, s, d in zip(item[first].tolist(), score[first].tolist(), own[first].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))
            if len(heap) == self.k:
                self.floor[i], self.floor_id[i] = heap[0][0], -heap[0][1]


def _length_norms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    rest = 100 - LENGTH_PERCENT
    if LENGTH_PERCENT * int(n.max(initial=0)) * documents < 1 << 63:
        return rest + LENGTH_PERCENT * n * documents // total
    return np.array([rest + LENGTH_PERCENT * x * documents // total for x in n.tolist()], np.int64)


def _rank(shared, k: int):
    """Batches of _count to (item_id, doc_id, score): the k best documents of each item among those of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, items, weights, item_ids, documents, total = shared.value
        count = len(item_ids)
        heaps = _Heaps(count, k)
        for batch in batches:
            ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = np.r_[0, np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))]
            term, tf = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            doc = np.repeat(np.arange(len(n)), np.diff(ends))
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * _length_norms(n, documents, total)[doc]))
            # Documents in runs whose steps and scores fit in memory.
            often = starts[term + 1] - starts[term]
            steps = np.r_[0, np.cumsum(often)][ends]
            a = 0
            while a < len(n):
                b = int(np.searchsorted(steps, steps[a] + CELLS, "right")) - 1
                b = max(a + 1, min(b, a + max(1, CELLS // count), len(n)))
                part = slice(ends[a], ends[b])
                times = often[part]
                at = np.arange(times.sum()) + np.repeat(starts[term[part]] - np.cumsum(times) + times, times)
                cell, added = np.repeat(doc[part] - a, times) * count + items[at], np.repeat(impact[part], times)
                # Halves of numbers are added as doubles, which hold them exactly for items of any number of terms.
                high, low = (np.bincount(cell, x, (b - a) * count).astype(np.int64) for x in (added >> 20, added & 0xFFFFF))
                heaps.offer(ids[a:b], ((high << 20) + low).reshape(b - a, count))
                a = b
        rows = [(i, -d, s) for i, heap in enumerate(heaps.heaps) for s, d in heap]
        item, doc, score = (pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ())))
        yield pa.RecordBatch.from_arrays([item_ids.take(item), doc, score], names=["item_id", "doc_id", "score"])

    return run


def _block(scratch: Scratch, docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score) of the heaps of all tasks for one block of (item_id, term)."""
    context, kind = docs.sparkSession.sparkContext, dict(asked.dtypes)["item_id"]
    own = asked.toArrow().combine_chunks()
    items, names = (own[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("item_id", "term"))
    item, term = items.indices.to_numpy(), names.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(names.dictionary) + 1))

    vocabulary = context.broadcast({t.encode(): i for i, t in enumerate(names.dictionary.to_pylist())})
    counts = scratch.save(docs.mapInArrow(_count(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>"), "counts")
    documents, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = np.zeros(len(names.dictionary), np.int64)
    # A row for each term of the block.
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    index = context.broadcast((starts, item[order], weights, items.dictionary, documents, total))
    found = counts.where("doc_id is not null and size(terms) > 0").mapInArrow(
        _rank(index, k), f"item_id {kind}, doc_id long, score long"
    )
    found = scratch.save(found, "found")
    scratch.drop(counts)
    return found


def rank_for_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = K,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score (long, above 0).

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z is lower-cased. With N
    documents that have a term, L terms in all of them, and df documents that have a term, the term weighs w = floor(1000
    * ln((2N + 2) / (2df + 1))). With n terms, a document's m is 10 + (90nN) div L. Its score for an item sums w * ((10^9
    * tf) div (1000tf + 8m)) over the item's distinct terms. Equal scores go by doc_id.

    Null and empty texts, of documents or of items, have no terms: they aren't counted, and find nothing. Rows of one item
    id are one item with the terms of all; a null item id is an item, too. doc_id is a whole number of any type; documents
    without one count in the statistics, but are no results. Repeated rows are counted and ranked each. Items for which no
    document scores have no rows; no documents or no items give an empty table. Other columns play no part.
    """
    scratch = Scratch(docs.sparkSession)
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    asked = items.select(F.col(item_id).alias("item_id"), F.explode(item_terms(F.col(item_text))).alias("term")).distinct()
    asked = scratch.save(asked, "asked")
    size = asked.agg(F.sum(F.octet_length("term") + OVERHEAD)).first()[0]
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if size is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")
    blocks = -(-size // block_bytes)
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    parts = [_block(scratch, source, asked.where(part == i), k) for i in range(blocks)]
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    best = reduce(DataFrame.union, parts).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.col("doc_id").cast(kinds[0]).alias("doc_id"), "score")

"""Language-model scoring by cross-entropy difference.

Two bigram models of one vocabulary, which is every word of the corpus and a mark for both ends of a text. The background
model counts all documents, scaled to the target's size; the target model counts the target documents. Both are smoothed
alike, so both sum to one over the vocabulary after any word:

* single(w) = (count(w) + SINGLE_BACKOFF * share of w in the corpus) / (all counts + SINGLE_BACKOFF)
* pair(w after h) = (count(h w) + PAIR_BACKOFF * single(w)) / (count(h) + PAIR_BACKOFF); after an unseen h that is single(w)

A document's score is the mean over its words and its end of the target loss less the background loss: the lower, the closer
to the target. A target document would know its own words, so target documents are dealt to FOLDS folds by the hash of their
text (copies come to one fold), and a document of a fold is scored by the models of the other folds' target documents.

Texts are read three times (sample, counts of hot words, steps), which costs less than writing sixteen bytes a word in between.
Every text is a run of steps (word before, word). Steps go to buckets by the hash of their word, many to a row, as arrays of
distinct pairs and of the documents that hold them. So one bucket has all that a step's loss needs - the counts of the pair
and of the word - and gives back one number for each document that has steps there, again as arrays, a row for each group of
documents that were read together. Nothing is capped, and what is gathered grows with the corpus.

The hottest words and pairs would fill one bucket. A bounded table of them is counted exactly beforehand and sent to the
tasks: their steps are settled where the text is read, or are spread over buckets by pair. Which words and pairs it holds is
drawn from a sample of texts; that decides where a step is settled, never its loss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, Scratch, shuffle_partitions

SINGLE_BACKOFF, PAIR_BACKOFF = 100.0, 1.0
#: Size of the table of hot words and pairs, and about how many texts it is drawn from.
HEAD_WORDS, HEAD_PAIRS, HEAD_SAMPLE = 2048, 8192, 2000
#: Words, and texts, after which the steps read so far are sent on. Places of texts are 16-bit numbers.
FLUSH_WORDS, FLUSH_TEXTS = 1_000_000, 30_000
#: Buckets of steps: so many a shuffle partition at least, and as many more as keep them below so many steps.
BUCKETS_A_PARTITION, BUCKET_STEPS = 4, 2_000_000
#: Folds of the target documents.
FOLDS = 5
#: Bytes of target ids up to which they are sent to all tasks; beyond, the documents are joined to them by a shuffle.
BROADCAST_BYTES = 32 << 20
KEEP_WORDS = 300_000

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_U = np.uint64
#: Hash of the mark at both ends; no word is empty.
END = xxhash.xxh64_intdigest(b"")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _steps(t: str | None, hashes: _Hashes) -> np.ndarray:
    """Hashes of the words, then of the end mark; nothing for a text without words."""
    ws = (t or "").encode().translate(_LOWER).split()
    h = np.full(len(ws) + 1 if ws else 0, END, _U)
    h[: len(ws)] = np.fromiter(map(hashes.__getitem__, ws), _U, len(ws))
    return h


def _before(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each one, over concatenated texts: the end mark of the text before is the mark of the start."""
    out = np.roll(h, 1)
    if len(h):
        out[0] = END
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs."""
    x = (a ^ (b * _U(0x9E3779B97F4A7C15))) * _U(0xC4CEB9FE1A85EC53)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def single(n, share, total):
    """Smoothed probability of a word that was counted n times among ``total``; share: its share of the corpus."""
    return (n + SINGLE_BACKOFF * share) / (total + SINGLE_BACKOFF)


def pair(n, before, one):
    """Smoothed probability of a word after another: n counts of both, ``before`` of the first; one: single() of the word."""
    return (n + PAIR_BACKOFF * one) / (before + PAIR_BACKOFF)


@dataclass
class Totals:
    """Steps of all documents and of the target documents; t may be an array, a number for each step that is scored."""

    n: float
    t: float | np.ndarray

    @property
    def scale(self):
        return self.t / self.n if self.n else 0.0 * self.t

    def pair_part(self, pn, pt, n, t):
        """What a step adds for its pair (counts pn, pt) and word (n, t): numerators of target loss less background loss."""
        share = n / max(self.n, 1.0)
        return np.log(
            pn * self.scale + PAIR_BACKOFF * single(n * self.scale, share, self.t)
        ) - np.log(pt + PAIR_BACKOFF * single(t, share, self.t))

    def before_part(self, n, t):
        """What each occurrence of a word adds as the word before: the denominators."""
        return np.log(t + PAIR_BACKOFF) - np.log(n * self.scale + PAIR_BACKOFF)


def others(by_fold: np.ndarray) -> np.ndarray:
    """Target counts (folds + 1, ...) that score each fold's documents, those of the other folds; last, for the other documents, all."""
    t = by_fold[:FOLDS].sum(axis=0)
    return np.concatenate([t - by_fold[:FOLDS], t[None]])


class Head:
    """Hot words and pairs: sorted hashes and, once counted, their counts."""

    def __init__(self, words: list[int], pairs: list[tuple[int, int]]):
        self.words = np.unique(np.array([*words, END], _U))
        known = set(self.words.tolist())
        pairs = [p for p in pairs if p[1] in known]
        codes = _mixed(np.array([p[1] for p in pairs], _U), np.array([p[0] for p in pairs], _U))
        order = np.argsort(codes)
        self.codes, self.before, self.after = codes[order], np.array(
            [p[0] for p in pairs], _U
        )[order], np.array([p[1] for p in pairs], _U)[order]

    def word_at(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def pair_at(self, before: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.codes, _mixed(h, before)), len(self.codes) - 1)
        return np.where((self.before[at] == before) & (self.after[at] == h), at, -1)

    def counted(self, words: np.ndarray, pairs: np.ndarray, steps: np.ndarray) -> None:
        """Counts by fold (folds + 1 rows, the last one of documents outside the target) of words, pairs and all steps."""
        self.n, self.t, self.steps, self.targets = words.sum(axis=0), others(words), float(steps.sum()), others(steps)
        at, n, t = self.word_at(self.after), pairs.sum(axis=0), others(pairs)
        totals = [Totals(self.steps, float(x)) for x in self.targets]
        self.before_delta = np.stack([x.before_part(self.n, self.t[f]) for f, x in enumerate(totals)])
        self.pair_delta = np.stack([x.pair_part(n, t[f], self.n[at], self.t[f][at]) for f, x in enumerate(totals)])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of single words (before = word) and pairs of a batch."""
    hashes = _Hashes()
    for batch in batches:
        h = np.concatenate([np.empty(0, _U), *(_steps(t.as_py(), hashes) for t in batch.column(0))])
        words, n = np.unique(h, return_counts=True)
        both, m = np.unique(np.stack([_before(h, None), h]), axis=1, return_counts=True)
        kinds = np.repeat([False, True], [len(words), both.shape[1]])
        columns = [np.r_[words, both[0]].view(np.int64), np.r_[words, both[1]].view(np.int64), np.r_[n, m]]
        yield pa.RecordBatch.from_pydict({"pair": pa.array(kinds)} | dict(zip(("a", "b", "n"), map(pa.array, columns), strict=True)))


def _draw_head(narrow: DataFrame) -> Head:
    rows = narrow.count()
    sample = narrow.select("text").sample(min(1.0, HEAD_SAMPLE / max(rows, 1)), seed=1).mapInArrow(
        _sampled, "pair boolean, a long, b long, n long"
    )
    counts = sample.groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))
    top = [
        counts.where(c).orderBy(F.col("n").desc(), "a", "b").limit(k).collect() for c, k in (("not pair", HEAD_WORDS), ("pair", HEAD_PAIRS))
    ]
    bits = (1 << 64) - 1
    return Head([r["a"] & bits for r in top[0]], [(r["a"] & bits, r["b"] & bits) for r in top[1]])


def _count_head(shared):
    """Counts of the head's words (0), pairs (1) and of all steps (2) in each batch, by fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, head = _Hashes(), shared.value
        for batch in batches:
            parts = [_steps(t.as_py(), hashes) for t in batch.column("text")]
            h = np.concatenate([np.empty(0, _U), *parts])
            fold = np.repeat(batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int64), [len(p) for p in parts])
            out = []
            for kind, at in enumerate((head.word_at(h), head.pair_at(_before(h, None), h), np.zeros(len(h), np.int64))):
                n = np.bincount(at[at >= 0] * (FOLDS + 1) + fold[at >= 0])
                some = np.flatnonzero(n)
                out.append((np.full(len(some), kind), some // (FOLDS + 1), some % (FOLDS + 1), n[some]))
            columns = zip(("kind", "at", "fold", "n"), zip(*out, strict=True), strict=True)
            yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v).astype(np.int64)) for k, v in columns})

    return run


def _send(shared, buckets: int):
    """Rows of steps for the buckets, and a row of ids, sizes and settled sums for each group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, head, numbers, task = _Hashes(), shared.value, count(), TaskContext.get().partitionId()
        for batch in batches:
            texts, fold = batch.column("text"), batch.column("fold").to_numpy(zero_copy_only=False)
            start, words, parts = 0, 0, []
            for i in range(len(texts)):
                parts.append(_steps(texts[i].as_py(), hashes))
                words += len(parts[-1])
                if words >= FLUSH_WORDS or len(parts) >= FLUSH_TEXTS or i == len(texts) - 1:
                    group = task << 33 | next(numbers)
                    yield _group_rows(
                        head,
                        buckets,
                        group,
                        parts,
                        fold[start : i + 1],
                        batch.column("doc_id").slice(start, i + 1 - start),
                        batch.schema.field("doc_id").type,
                    )
                    start, words, parts = i + 1, 0, []

    return run


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _group_rows(
    head: Head, buckets: int, group: int, parts: list[np.ndarray], fold: np.ndarray, ids: pa.Array, id_type: pa.DataType
) -> pa.RecordBatch:
    order = np.argsort(fold, kind="stable")  # target documents first, fold by fold
    fold, parts = fold[order], [parts[i] for i in order]
    sizes = np.array([len(p) for p in parts])
    h = np.concatenate([np.empty(0, _U), *parts])
    doc, before = np.repeat(np.arange(len(parts)), sizes), _before(h, sizes)
    hot, known = head.word_at(h), head.pair_at(before, h)
    sums = np.bincount(doc, np.where(hot >= 0, head.before_delta[fold[doc], hot], 0.0), len(parts)).astype(float)
    if len(head.codes):
        sums += np.bincount(doc, np.where(known >= 0, head.pair_delta[fold[doc], known], 0.0), len(parts))
    rest = known < 0
    h, before, doc, hot = h[rest], before[rest], doc[rest].astype(np.int16), hot[rest]
    both = _mixed(h, before)
    # A place decides the bucket: that of the word, for hot words that of the pair. The low bits keep equal pairs together.
    place = np.where(hot >= 0, both, _mixed(h, h)) >> _U(44)
    by = np.argsort((place << _U(44)) | (both & _U((1 << 44) - 1)), kind="stable")
    h, before, doc, bucket = h[by], before[by], doc[by], (place[by] * _U(buckets)) >> _U(20)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (before[1:] != before[:-1])
    starts = np.flatnonzero(new)
    holders, own = np.diff(np.r_[starts, len(h)]), bucket[starts]
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, int)
    pair_bounds, doc_bounds = np.r_[cuts, len(own)], np.r_[starts[cuts], len(h)] if len(own) else np.zeros(1, int)
    k = len(cuts)
    pad = lambda bounds: np.r_[bounds, bounds[-1]] if len(bounds) == k + 1 else np.zeros(k + 2, int)  # noqa: E731  an empty list for the last row
    last = np.r_[np.zeros(k + 1, int), len(parts)]
    own_ids = pa.ListArray.from_arrays(
        pa.array(last.astype(np.int32)), ids.take(pa.array(order)) if len(order) else pa.array([], id_type)
    )
    arrays = {
        "row": pa.array(np.full(k + 1, group), pa.int64()),
        "bucket": pa.array([*own[cuts].tolist(), group % buckets], pa.int32()),
        "folds": _lists(np.tile(np.searchsorted(fold, np.arange(FOLDS), "right"), k + 1).astype(np.int32), np.arange(k + 2) * FOLDS),
        "words": _lists(h[starts].view(np.int64), pad(pair_bounds)),
        "befores": _lists(before[starts].view(np.int64), pad(pair_bounds)),
        "holders": _lists(holders.astype(np.int32), pad(pair_bounds)),
        "docs": _lists(doc, pad(doc_bounds)),
        "sizes": _lists(sizes, last),
        "sums": _lists(sums, last),
        "ids": own_ids,
    }
    return pa.RecordBatch.from_pydict(arrays)


def _settle(shared):
    """A bucket to a row for each group in it: documents that have steps there and their parts; ids, sizes and settled sums pass."""

    def run(table: pa.Table) -> pa.Table:
        head: Head = shared.value
        flat = lambda name: table[name].combine_chunks().flatten()
        each = lambda name: table[name].combine_chunks().value_lengths().to_numpy()
        words, befores, holders, docs = flat("words").to_numpy().view(_U), flat(
            "befores"
        ).to_numpy().view(_U), flat("holders").to_numpy(), flat("docs").to_numpy()
        groups = table["row"].to_numpy()
        pair_of = np.repeat(np.arange(len(words)), holders)
        blob = np.repeat(np.repeat(np.arange(len(groups)), each("words")), holders)
        # Where the documents of each fold end among those of a group.
        ends, fold = flat("folds").to_numpy().reshape(-1, FOLDS), np.zeros(len(docs), np.int64)
        for f in range(FOLDS):
            fold += docs >= ends[blob, f]
        own, at = np.unique(_mixed(words, befores), return_inverse=True)
        step = at[pair_of]
        pairs = np.stack([np.bincount(step[fold == f], minlength=len(own)) for f in range(FOLDS + 1)])
        word = np.empty(len(own), _U)
        word[at] = words
        vocabulary, place = np.unique(word, return_inverse=True)
        singles = np.stack([np.bincount(place, p, len(vocabulary)) for p in pairs])
        hot = head.word_at(vocabulary)
        n, t = np.where(hot >= 0, head.n[hot], singles.sum(axis=0)), np.where(hot >= 0, head.t[:, hot], others(singles))
        # A number for each step of each document, by the models of its fold.
        totals, w = Totals(head.steps, head.targets[fold]), place[step]
        delta = totals.pair_part(pairs.sum(axis=0)[step], others(pairs)[fold, step], n[w], t[fold, w])
        delta += np.where(hot[w] >= 0, 0.0, totals.before_part(n[w], t[fold, w]))
        where, into = np.unique(blob << 16 | docs, return_inverse=True)
        parts = np.bincount(into, delta, len(where)).astype(np.float64)
        bounds = np.searchsorted(where >> 16, np.arange(len(groups) + 1))
        return pa.table(
            {"row": groups, "docs": _lists((where & 0xFFFF).astype(np.int16), bounds), "parts": _lists(parts, bounds)}
            | {c: table[c] for c in ("ids", "sizes", "sums")}
        )

    return run


def _gather(table: pa.Table) -> pa.Table:
    """All rows of a group of documents to (doc_id, size, total)."""
    flat = lambda name: table[name].combine_chunks().flatten()
    ids, sizes, sums = flat("ids"), flat("sizes"), flat("sums").to_numpy()
    total = sums + np.bincount(flat("docs").to_numpy(), flat("parts").to_numpy(), len(sums)) if len(sums) else sums
    return pa.table({"doc_id": ids, "size": sizes, "total": total})


def fold_of(text: Column) -> Column:
    """The fold of a target document: copies of a text share it."""
    return F.pmod(F.xxhash64(text, F.lit(5)), F.lit(FOLDS)).cast("int")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, score (loss of the target model less that of the background model, a step).

    ``target_ids``: one column of ids of the target documents; nulls and repeats play no part. Tokens: words between ASCII
    white space, A-Z lower-cased. Null, empty and blank texts have no tokens and score 0. Target documents are scored by the
    target documents of other folds, so what all of them share with no other text counts for nothing. Without target documents
    every score is 0, and so is that of a target document without others. Repeated rows count and score each. An empty table gives an empty table. Other columns play no part.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    ids = scratch.save(target_ids.toDF("target_id").where("target_id is not null").distinct(), "targets")
    size = ids.agg(F.sum(F.octet_length(F.col("target_id").cast("string")) + 16)).first()[0] or 0
    ids = ids.withColumn("is", F.lit(True))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    flagged = narrow.join(F.broadcast(ids) if size <= BROADCAST_BYTES else ids, F.col("doc_id") == F.col("target_id"), "left")
    flagged = flagged.select("doc_id", "text", F.when(F.col("is"), fold_of(F.col("text"))).otherwise(FOLDS).alias("fold"))

    head = _draw_head(narrow)
    drawn = spark.sparkContext.broadcast(head)
    counts = flagged.select("text", "fold").mapInArrow(_count_head(drawn), "kind long, at long, fold long, n long")
    # At most HEAD_WORDS + HEAD_PAIRS + 2 rows a fold.
    found = counts.groupBy("kind", "at", "fold").agg(F.sum("n").alias("n")).collect()
    tables = [np.zeros((FOLDS + 1, size)) for size in (len(head.words), len(head.codes), 1)]
    for r in found:
        tables[r["kind"]][r["fold"], r["at"]] = r["n"]
    head.counted(tables[0], tables[1], tables[2][:, 0])
    shared = spark.sparkContext.broadcast(head)

    buckets = max(BUCKETS_A_PARTITION * shuffle_partitions(spark), math.ceil(head.steps / BUCKET_STEPS))
    schema = f"row long, bucket int, folds array<int>, words array<long>, befores array<long>, holders array<int>, docs array<short>, sizes array<long>, sums array<double>, ids array<{kind}>"
    sent = flagged.mapInArrow(_send(shared, buckets), schema)
    settled = sent.groupBy("bucket").applyInArrow(
        _settle(shared), f"row long, docs array<short>, parts array<double>, ids array<{kind}>, sizes array<long>, sums array<double>"
    )
    out = settled.groupBy("row").applyInArrow(_gather, f"doc_id {kind}, size long, total double")
    # A step for each word and one for the end.
    return out.select(
        "doc_id",
        F.greatest(F.col("size") - 1, F.lit(0)).alias("n_tokens"),
        F.when(F.col("size") > 0, F.round(F.col("total") / F.col("size"), 6)).otherwise(0.0).alias("score"),
    )

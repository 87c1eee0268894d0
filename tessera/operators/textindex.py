"""Substring search by an index of trigrams.

Texts are stored lower-cased. A task lists the distinct runs of three characters of a slice of its texts at once, and a posting is a run
with the ids of the slice's texts that have it. Postings lie sorted in each file, so a search reads only the pages of a file
whose bounds hold one of its trigrams, and nothing is shuffled. A search keeps the ids that have all of them, and verifies
these in their texts. Searches of fewer than three characters, and those that leave many texts, scan the stored texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Characters of texts whose trigrams are listed at once.
SLICE = 1 << 20
#: Candidates up to which their ids are pushed down into the scan of the texts.
FEW = 1000


def _own_grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct trigrams, where each one's places start, places of the texts that have it), a place once a trigram."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(codes) < GRAM:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    code = (np.cumsum(seen) - 1)[codes]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = row[GRAM - 1 :] == row[: 1 - GRAM]
    gram, row = ((code[:-2] * len(letters) + code[1:-1]) * len(letters) + code[2:])[inside], row[: 1 - GRAM][inside]
    numbered = None
    if len(letters) ** GRAM * len(texts) >= 1 << 63:  # thousands of texts of a hundred thousand different characters
        numbered, gram = np.unique(gram, return_inverse=True)
    pair = np.sort(gram * len(texts) + row)
    pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
    gram, place = np.divmod(pair, len(texts))
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else gram
    distinct = gram[starts] if numbered is None else numbered[gram[starts]]
    parts = np.stack([distinct // len(letters) ** 2, distinct // len(letters) % len(letters), distinct % len(letters)], 1)
    names = letters[parts].astype("<u4").tobytes().decode("utf-32-le")
    return [names[i : i + GRAM] for i in range(0, len(names), GRAM)], starts, place


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of SLICE characters, about."""
    for batch in batches:
        start, size, texts = 0, 0, []
        for t in batch.column(1).cast(pa.binary()):
            texts.append(t.as_py().decode("utf-8", "replace"))
            size += len(texts[-1])
            if size >= SLICE:
                yield batch.column(0).slice(start, len(texts)), texts
                start, size, texts = start + len(texts), 0, []
        if texts:
            yield batch.column(0).slice(start, len(texts)), texts


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, searched) to (gram, ids)."""
    for ids, texts in _slices(batches):
        names, starts, place = _own_grams(texts)
        bounds = pa.array(np.r_[starts, len(place)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.ListArray.from_arrays(bounds, ids.take(pa.array(place)))], names=["gram", "ids"]
        )


def write_index(rows: DataFrame, path: str, key: str, *columns: str) -> None:
    """Texts and postings of the columns, joined by blanks as a plain search joins them; null ones are left out. Keys are unique."""
    spark = rows.sparkSession
    texts = rows.select(F.col(key).alias("id"), F.lower(F.concat_ws(" ", *columns)).alias("searched"))
    texts.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/texts")
    stored = spark.read.parquet(f"{path}/texts")
    postings = stored.mapInArrow(_postings, f"gram string, ids array<{dict(stored.dtypes)['id']}>")
    postings.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id) of the texts that have every trigram of a query of three characters or more."""
    grams = sorted({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})
    found = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(grams)).select(F.explode("ids").alias("id"))
    # A text's trigrams are listed once, in one slice, so a single one needs no count.
    return found if len(grams) == 1 else found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id) of the rows whose joined columns contain the query, in any case; a blank query matches all."""
    q, texts = query.strip().lower(), spark.read.parquet(f"{path}/texts")
    if len(q) == GRAM:
        return candidates(spark, path, q)
    if len(q) > GRAM:
        few = [r["id"] for r in candidates(spark, path, q).limit(FEW + 1).collect()]
        # Many candidates are verified by a scan of all texts: a join would shuffle the texts.
        texts = texts.where(F.col("id").isin(few)) if len(few) <= FEW else texts
    return texts.where(F.col("searched").contains(q)).select("id") if q else texts.select("id")

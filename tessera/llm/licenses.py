"""Licence scan with a positional rare-token index.

Templates are full licence texts and the short notices that stand for them. The words of each template that are rarest among
all documents (highest IDF) are looked up in every file; a hit at place p for a template word at place q votes for the start
p - q. A short notice needs all its votes for one start. A full text needs half of its votes inside a window of starts, so
that edits and line numbers in between don't hide it. At such a start the template's mandatory key phrases are verified word
by word, and the score is the share of template words that stand there: at their place in a notice, in any order within the
reach of a full text. The base phrases are notices whose key phrase is all of them.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER

#: Rare words of a notice and of a full text that are looked up.
RARE, RARE_FULL = 3, 32
#: Share of a full text's votes that must agree, and by what share of its length starts may differ.
AGREE, DRIFT = 0.5, 0.1
#: Share of a template's words that must stand where it was found.
MIN_SCORE = 0.7


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases of the text that must stand as they are.
    mandatory: tuple[str, ...]
    base: bool = False
    full: bool = False


BASE = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0", )),
    Template("apache", "licensed under the apache license", ("apache license", )),
    Template(
        "bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", )
    ),
    Template(
        "cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0", )
    ),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc", )),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa", )),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3", )),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2", )),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("with or without fee is hereby granted", ),
    ),
    Template("mit", "released under the mit license", ("mit license", )),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("free of charge to any person", ),
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license", )),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", )),
)
#: Key phrases of the full texts in the folder license_texts, by file name.
FULL = {
    "apache-2.0": ("terms and conditions for use reproduction and distribution", "grant of patent license"),
    "bsd-2-clause": (
        "redistributions of source code must retain the above copyright notice",
        "redistributions in binary form must reproduce the above copyright notice",
    ),
    "bsd-3-clause": (
        "redistributions in binary form must reproduce the above copyright notice",
        "may be used to endorse or promote products derived from this software",
    ),
    "cc0-1.0": ("waiver", "public license fallback"),
    "gpl-2.0": ("version 2 june 1991", "general public license"),
    "gpl-3.0": ("version 3 29 june 2007", "general public license"),
    "isc": ("with or without fee is hereby granted", "the author disclaims all warranties with regard to this software"),
    "lgpl-2.1": ("lesser general public license", "version 2 1 february 1999"),
    "mit": ("free of charge to any person obtaining a copy", "substantial portions of the software"),
    "mpl-2.0": ("mozilla public license", "covered software"),
    "unlicense": ("free and unencumbered software", "detriment of our heirs and successors"),
    "zlib": ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked"),
}

_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_CLEAN = bytes(_TABLE[b] if b in _WORD_BYTES else 0x20 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of characters beyond ASCII."""
    return (text or "").encode().translate(_CLEAN).split()


def full_texts(folder: Path = Path(__file__).parent / "license_texts") -> tuple[Template, ...]:
    """The licence texts that come with the package, as templates of their words."""
    return tuple(
        Template(k, b" ".join(split_words((folder / f"{k}.txt").read_text())).decode(), phrases, full=True) for k, phrases in FULL.items()
    )


TEMPLATES = BASE + NOTICES + full_texts()


def document_frequency(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> tuple[int, dict[str, int]]:
    """All documents, and how many hold each word of the templates (as many counts as the templates have words)."""
    known = {w for t in templates for w in t.text.encode().split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter({b"": batch.num_rows})
            for t in batch.column(0):
                counts.update(known.intersection(split_words(t.as_py())))
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array([w.decode() for w in counts]), "n": pa.array(list(counts.values()), pa.int64())}
            )

    rows = docs.select(F.col(text).alias("text")).mapInArrow(
        run, "word string, n long"
    ).groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


class Index:
    """Postings of rare words: word -> [(template number, place)]."""

    def __init__(self, templates: tuple[Template, ...], n: int, df: dict[str, int]):
        self.templates = templates
        self.words = [[w.encode() for w in t.text.split()] for t in templates]
        self.phrases = [[[w.encode() for w in p.split()] for p in t.mandatory] for t in templates]
        self.counts = [Counter(ws) for ws in self.words]
        self.drift = [int(DRIFT * len(ws)) if t.full else 0 for t, ws in zip(templates, self.words, strict=True)]
        self.at = [
            [next(i for i in range(len(ws)) if ws[i : i + len(p)] == p) for p in ps]
            for ws, ps in zip(self.words, self.phrases, strict=True)
        ]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed = []
        for k, ws in enumerate(self.words):
            if templates[k].full:
                # Words that stand once in the text, so that a hit names its place.
                places = [i for i, w in enumerate(ws) if self.counts[k][w] == 1]
            else:
                # Words of the mandatory phrases, so that a file without them can't pass.
                places = sorted({a + i for a, p in zip(self.at[k], self.phrases[k], strict=True) for i in range(len(p))})
            places.sort(key=lambda i: (-math.log((n + 1) / (df.get(ws[i].decode(), 0) + 1)), i))
            places = places[: RARE_FULL if templates[k].full else RARE]
            self.needed.append(math.ceil(AGREE * len(places)) if templates[k].full else len(places))
            for i in places:
                self.postings.setdefault(ws[i], []).append((k, i))

    def check(self, ws: list[bytes], k: int, start: int) -> float:
        """The template's score at a start of the words; 0 if a key phrase is missing or the score is too low."""
        own = self.words[k]
        if not self.templates[k].full:
            if any(start + a < 0 or ws[start + a : start + a + len(p)] != p for a, p in zip(self.at[k], self.phrases[k], strict=True)):
                return 0.0
            score = sum(0 <= start + i < len(ws) and ws[start + i] == w for i, w in enumerate(own)) / len(own)
        else:
            near = ws[max(0, start - self.drift[k]) : max(0, start + len(own) + self.drift[k])]
            firsts = {p[0] for p in self.phrases[k]}
            at = [i for i, w in enumerate(near) if w in firsts]
            if any(all(near[i : i + len(p)] != p for i in at) for p in self.phrases[k]):
                return 0.0
            score = (Counter(near) & self.counts[k]).total() / len(own)
        return score if score >= MIN_SCORE else 0.0

    def starts(self, k: int, votes: list[tuple[int, int]]) -> Iterator[int]:
        """Starts of a template that enough of its rare words vote for: votes are (start, place in the template), in order."""
        if not self.drift[k]:
            yield from (s for s, n in Counter(s for s, _ in votes).items() if n >= self.needed[k])
            return
        at = [s for s, _ in votes]
        i = 0
        while i < len(votes):
            j = bisect_right(at, at[i] + self.drift[k])
            if len({q for _, q in votes[i:j]}) >= self.needed[k]:
                yield Counter(at[i:j]).most_common(1)[0][0]
                i = bisect_left(at, at[i] + len(self.words[k]), j)
            else:
                i = bisect_right(at, at[i], i)

    def scan(self, ws: list[bytes]) -> list[tuple[int, int, float]]:
        """(template number, start, score) of each place where a template stands."""
        votes: dict[int, list[tuple[int, int]]] = {}
        for p, w in enumerate(ws):
            for k, q in self.postings.get(w, ()):
                votes.setdefault(k, []).append((p - q, q))
        found = [
            (k, start, score) for k, own in votes.items() if len(own) >= self.needed[k] for start in self.starts(k, sorted(own))
            if (score := self.check(ws, k, start))
        ]
        return sorted(found, key=lambda x: (x[1], x[0]))


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    ``places``: array of struct (label, start, words, score) in order. first_word and last_word are the smallest and largest
    start of base templates, null without any. A full text's start is the one that most of its rare words name; it may lie before
    the file's first word if the file holds a later part. score is the best template's, 0 without any. Null text counts as empty:
    zeros, nulls and empty label lists. Repeated rows give repeated results; an empty table an empty one. Other columns of
    the input play no part. Two passes over the texts: one counts document frequencies, one scans.
    """
    n, df = document_frequency(docs, templates, text)
    index = Index(templates, n, df)
    place_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {
                k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
            }
            for t in batch.column(1):
                ws = split_words(t.as_py())
                found = index.scan(ws)
                base = [(k, start) for k, start, _ in found if templates[k].base]
                starts = [start for _, start in base]
                row = (
                    len(ws), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({templates[k].label for k, _ in base})), ",".join(sorted({templates[k].label for k, _, _ in found})),
                    max((s for _, _, s in found), default=0.0),
                    [{"label": templates[k].label, "start": start, "words": len(index.words[k]), "score": s} for k, start, s in found],
                )
                for values, v in zip(out.values(), row, strict=True):
                    values.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), place_type]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0)} | {k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)}
            )

    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:bigint,words:int,score:double>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, schema)

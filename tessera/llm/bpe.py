"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, one after the other, into a deterministic automaton over tokens that accepts exactly the right
tokenizations. It starts with one state that loops on every base token. The gadget of a merge (u, v):

* the state that u leads to is copied without its arc v, and every u arc is led to the copy: v may no longer follow u;
* wherever u may stand, so may uv, and it leads where v led before.

All arcs of a token lead to one state, so the state is named by the token read last. Its copies form a chain: those of the
token's own gadgets, below them those that its right part had when the token was made, and so on. A merge puts one entry into the
table, (u, v) and the number of the merge; a token keeps its number and its parts. So the table has as many entries as there are
merges, whatever the corpus. ``arc`` reads a transition off the chain, part by part; rows of transitions that were read are kept.

Every prefix of a word has one accepted tokenization at most, hence one state. So a word is encoded left to right along arcs,
the longest first, and each place is left once at most. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept by a Python worker; the store starts anew when it is full, so memory is bounded and results are the same.
KEEP_WORDS = 400_000
KEEP_ARCS = 1_000_000


class Automaton:
    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        self.made = dict.fromkeys(base, -1)  # token -> merge that made it
        self.left: dict[str, str] = {}
        self.right: dict[str, str] = {}
        self.gadgets: dict[tuple[str, str], int] = {}
        for i, (u, v) in enumerate(merges):
            self.add(i, u, v)
        self.longest = max(map(len, self.made), default=0)
        self.rows: dict[str, dict[str, bool]] = {}
        self.kept = 0

    def add(self, i: int, u: str, v: str) -> None:
        """The gadget of merge i."""
        if u not in self.made or v not in self.made or not self.arc(u, v):  # the pair can't arise
            return
        uv = u + v
        if uv in self.made:
            raise ValueError(f"two merges make {uv!r}")
        self.gadgets[u, v] = i
        self.made[uv], self.left[uv], self.right[uv] = i, u, v

    def arc(self, state: str, token: str) -> bool:
        """Whether the token may come next after ``state``, the token read last.

        A copy made by merge i lacks the arc v. A token that was made at i or later stands wherever its left part may, so
        there it counts as its left part.
        """
        made, gadgets, left = self.made, self.gadgets, self.left
        part, newest = state, len(gadgets) + len(made)  # copies of a part count if they are older than what it is part of
        while part is not None:
            t, upto = token, newest
            while t is not None:
                i = gadgets.get((part, t))
                if i is not None and i < newest and i <= upto:
                    return False
                t, upto = left.get(t), made[t]
            part, newest = self.right.get(part), made[part]
        return True

    def encode(self, symbols: list[str]) -> list[str]:
        """The tokenization of a word, given as base tokens; symbols outside the alphabet are dropped, as the vocabulary has no unknown token.

        From each place the longest token with an arc is tried first. A place from which the end can't be reached is
        noted: it has one state, so it stays without use and each place is left once at most.
        """
        made, rows = self.made, self.rows
        symbols = [s for s in symbols if s in made]
        n, word, starts = len(symbols), "".join(symbols), [0, *accumulate(map(len, symbols))]
        if self.kept > KEEP_ARCS:
            rows.clear()
            self.kept = 0
        path: list[tuple[int, str]] = []  # start, token
        dead: set[int] = set()
        at, end = 0, min(n, self.longest)
        while at < n:
            row = rows.setdefault(path[-1][1], {}) if path else None
            while end > at:
                token = word[starts[at] : starts[end]]
                if token in made and end not in dead:
                    if row is None:
                        break
                    ok = row.get(token)
                    if ok is None:
                        ok = row[token] = self.arc(path[-1][1], token)
                        self.kept += 1
                    if ok:
                        break
                end -= 1
            if end > at:
                path.append((at, token))
                at, end = end, min(n, end + self.longest)
            else:
                dead.add(at)
                end = at - 1
                at, _ = path.pop()
        return [token for _, token in path]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Kept(dict):
    """Word -> what ``make`` gives for it, computed once."""

    def __init__(self, make: Callable[[str], str]):
        self.make = make

    def __missing__(self, word: str) -> str:
        if len(self) >= KEEP_WORDS:
            self.clear()
        value = self[word] = self.make(word)
        return value


#: Texts of these characters need no Unicode tables: they are in composed form, and classes and lower case are plain.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]*")
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class Codec:
    """A vocabulary file of a lower-case word-end BPE: normalizer, splitter, automaton and labels."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.labels = {str(i): t for t, i in self.vocabulary.items()} | {str(x["id"]): x["content"] for x in spec["added_tokens"]}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        whole = {u + v for u, v in merges}
        self.suffix = model["end_of_word_suffix"] or ""
        self.automaton = Automaton([t for t in self.vocabulary if t not in whole], merges)
        self.letters = byte_letters()
        self.added = {x["content"]: str(x["id"]) for x in spec["added_tokens"]}
        self.added_re = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        # For other texts, the library's own Unicode tables for composition, case and classes; merging is done here.
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.plain = _Kept(lambda word: self.word_ids("".join([self.letters[b] for b in word.encode()])))
        self.other = _Kept(self.word_ids)

    def word_ids(self, word: str) -> str:
        """Ids, joined by spaces, of a word in byte letters."""
        tokens = self.automaton.encode([*word[:-1], word[-1] + self.suffix])
        return " ".join([str(self.vocabulary[t]) for t in tokens])

    def encode(self, text: str) -> str:
        """Ids of a text, joined by spaces."""
        found = []
        for part in self.added_re.split(text) if self.added else [text]:
            if part in self.added:
                found.append(self.added[part])
            elif PLAIN.fullmatch(part):
                found += map(self.plain.__getitem__, PLAIN_WORD.findall(part.lower()))
            else:
                found += [ids for word, _ in self.split(self.normalize(part)) if (ids := self.other[word])]
        return " ".join(found)

    def decode(self, ids: str) -> str:
        """Labels of the arcs, joined as the library does for a file without a decoder: by single spaces."""
        return " ".join(map(self.labels.__getitem__, ids.split()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One automaton for each vocabulary and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(
    docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, keep_text: bool = False
) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256, and on demand ids (array of int) and decoded.

    Whole texts are encoded; nothing is shuffled. Strings of added tokens in a text become those tokens. Null text counts
    as empty: no tokens, and hashes of the empty string. Repeated rows give repeated results; an empty table an empty one.
    ``vocabulary`` is a file that every executor can open.
    """
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            n, ids_hash, plain_hash, all_ids, plains = [], [], [], [], []
            for t in batch.column(1):
                ids = c.encode(t.as_py() or "")
                plain = c.decode(ids)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                plain_hash.append(hashlib.sha256(plain.encode()).hexdigest())
                if keep_ids:
                    all_ids.append([int(i) for i in ids.split()])
                if keep_text:
                    plains.append(plain)
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array(n, pa.int64()),
                "ids_sha256": pa.array(ids_hash, pa.string()),
                "decoded_sha256": pa.array(plain_hash, pa.string()),
            }
            if keep_ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            if keep_text:
                columns["decoded"] = pa.array(plains, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)

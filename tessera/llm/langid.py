"""Language identification of spans: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts words and letter trigrams by language over labelled rows: a bounded sample, as a model needs. Prediction
looks at whole texts. The script of a word narrows its candidates to the languages seen in that script; a known word is
scored by its frequency, another by its trigrams. Viterbi finds the best sequence of languages when each switch costs a
penalty, which labels the spans of mixed texts.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Bound of the fitted model: labelled rows that are counted. All their words and trigrams are features.
TRAIN_ROWS = 5_000
SWITCH = 12.0
#: Word scores kept by a Python worker; the store starts anew when full.
KEEP_WORDS = 400_000
UNKNOWN = "und"
#: First code points of script ranges, in order; a range ends where the next one starts.
SCRIPTS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "han"),
    (0xFB00, "latin"),
    (0xFB1D, "hebrew"),
    (0xFB50, "arabic"),
    (0xFE00, "other"),
    (0x20000, "han"),
]
_STARTS = [s for s, _ in SCRIPTS]
WORD = regex.compile(r"\p{L}+")
WORD_SQL = r"\p{L}+"


def script(word: str) -> str:
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1]


class Model:
    """Log-probabilities of words and trigrams by language; rows of numbers in the order of ``languages``."""

    def __init__(
        self,
        languages: list[str],
        words: dict[str, int],
        word_counts: np.ndarray,
        trigrams: dict[str, int],
        trigram_counts: np.ndarray,
        scripts: dict[str, list[bool]],
    ):
        self.languages, self.words, self.trigrams = languages, words, trigrams
        self.word_logs = self._logs(word_counts)[:-1]
        #: The last row is that of a trigram that was never seen.
        self.trigram_logs = self._logs(trigram_counts)
        self.scripts = {k: np.where(v, 0.0, -1e3) for k, v in scripts.items()}
        self.any_script = np.zeros(len(languages))

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        rows = np.vstack([counts, np.zeros(counts.shape[1])])
        return np.log(rows + 1.0) - np.log(counts.sum(axis=0) + 2.0 * max(1, len(counts)))

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods (words x languages), each relative to its best and at most the evidence of one frequent word; languages of other scripts are out."""
        unseen, get = len(self.trigrams), self.trigrams.get
        grams, starts, share = [], [], []
        for w in words:
            starts.append(len(grams))
            padded = f" {w} "
            grams += [get(padded[i : i + 3], unseen) for i in range(len(w))]
            share.append(max(1.0, len(w) / 3))
        rows = np.add.reduceat(self.trigram_logs[grams], starts, axis=0) / np.array(share)[:, None]
        known = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        rows[known >= 0] = self.word_logs[known[known >= 0]]
        rows = np.maximum(rows - rows.max(axis=1, keepdims=True), -8.0)
        return rows + np.stack([self.scripts.get(script(w), self.any_script) for w in words])


def spans(emit: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word: emissions (words x languages), a switch costs the penalty."""
    n, k = emit.shape
    if k == 1:
        return np.zeros(n, np.int64)
    best = int(emit.sum(axis=0).argmax())
    # A path of m runs in other languages pays for m - 1 switches at least, and two runs for one. So if no run favours
    # another language by half the price of a switch, one language is the optimum.
    gain = np.cumsum(emit - emit[:, [best]], axis=0)
    floor = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
    before = np.vstack([np.zeros((1, k)), floor[:-1]])
    if (gain - before).max() < penalty / 2:
        return np.full(n, best, np.int64)
    value, back = emit[0].copy(), np.zeros((n, k), np.int64)
    own = np.arange(k)
    for t in range(1, n):
        top = int(value.argmax())
        stay = value >= value[top] - penalty
        back[t] = np.where(stay, own, top)
        value = np.where(stay, value, value[top] - penalty) + emit[t]
    out = np.empty(n, np.int64)
    out[-1] = value.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", order: Column, rows: int = TRAIN_ROWS) -> Model:
    """Counts features over about ``rows`` labelled rows, those with the smallest hash ``order`` (a long); null labels and texts are left out.

    Which rows these are follows from their number alone, so sampling shuffles nothing. The sample's words are counted once and
    written; trigrams are counted from these words. The driver gets a row for each feature of these rows and its language.
    An empty table gives a model without languages.
    """
    scratch = Scratch(labelled.sparkSession)
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    total = usable.count()
    sample = usable.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), order.alias("_o"))
    if total > rows:
        sample = sample.where(F.pmod("_o", F.lit(1 << 40)) < F.lit(int((1 << 40) * (rows / total))))
    tokens = sample.select(
        "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_SQL), F.lit(0))).alias("word")
    ).groupBy("lang", "word").agg(F.count("*").alias("n"))
    tokens = scratch.save(tokens, "words")
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = tokens.select(
        "lang",
        "n",
        F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))).alias("gram"),
    ).groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    word_rows, gram_rows = tokens.select("lang", "word", "n").toArrow(), grams.select("lang", "gram", "n").toArrow()
    languages = sorted(set(word_rows["lang"].unique().to_pylist()))
    at = {x: i for i, x in enumerate(languages)}

    def table(found: pa.Table) -> tuple[dict[str, int], np.ndarray]:
        """Features by number, and their counts (features x languages)."""
        own = found.column(1).combine_chunks().dictionary_encode()
        counts = np.zeros((len(own.dictionary), len(languages)))
        counts[own.indices.to_numpy(), [at[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
        return {w: i for i, w in enumerate(own.dictionary.to_pylist())}, counts

    (words, word_counts), (trigrams, trigram_counts) = table(word_rows), table(gram_rows)
    seen: dict[str, np.ndarray] = {}
    for w, i in words.items():
        seen[script(w)] = seen.get(script(w), 0) + word_counts[i]
    # A language has a script if a hundredth of its counted words are in it.
    all_words = word_counts.sum(axis=0)
    scripts = {s: [bool(c > 0.01 * a) for c, a in zip(counts, all_words, strict=True)] for s, counts in seen.items()}
    scripts = {s: v for s, v in scripts.items() if any(v)}
    return Model(languages, words, word_counts, trigrams, trigram_counts, scripts)


class _Scores:
    """Scores of the words of a Python worker's texts, each computed once while there is room."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows = np.empty((KEEP_WORDS, len(model.languages)))

    def of(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.at]
        if len(new) > KEEP_WORDS // 2:  # a very long text: in parts
            half = len(words) // 2
            return np.concatenate([self.of(words[:half]), self.of(words[half:])])
        if len(self.at) + len(new) > KEEP_WORDS:
            self.at.clear()
            new = list(set(words))
        if new:
            n = len(self.at)
            self.rows[n : n + len(new)] = self.model.score(new)
            self.at.update(zip(new, range(n, n + len(new))))
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def detect(
    docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), penalty: float = SWITCH
) -> DataFrame:
    """One row a document: doc_id, ``keep`` columns, lang_pred, score, spans (array of struct lang, first word, words).

    lang_pred is the language with most letters, score its share of the letters (ties: the first by name). Null texts,
    texts without a letter, and all texts under a model without languages: ``und``, score 0, no spans. Whole texts are
    labelled, nothing is shuffled. Repeated rows give repeated results; an empty table an empty one.
    """
    types = dict(docs.dtypes)
    schema = ", ".join(
        [
            f"doc_id {types[doc_id]}",
            *[f"`{c}` {types[c]}" for c in keep],
            "lang_pred string",
            "score double",
            "spans array<struct<lang:string,start:int,words:int>>",
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kept = _Scores(m)
        for batch in batches:
            names, scores, found = [], [], []
            for t in batch.column(batch.num_columns - 1):
                ws = WORD.findall((t.as_py() or "").lower()) if m.languages else []
                if not ws:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    found.append([])
                    continue
                labels = spans(kept.of(ws), penalty)
                letters = np.bincount(labels, np.fromiter(map(len, ws), np.float64, len(ws)), len(m.languages))
                best = int(letters.argmax())
                names.append(m.languages[best])
                scores.append(float(letters[best] / letters.sum()))
                starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
                ends = np.r_[starts[1:], len(labels)]
                found.append(
                    [{"lang": m.languages[labels[a]], "start": int(a), "words": int(b - a)} for a, b in zip(starts, ends, strict=True)]
                )
            columns = dict(zip(batch.schema.names[:-1], batch.columns[:-1], strict=True))
            yield pa.RecordBatch.from_pydict(
                columns
                | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "spans": pa.array(found, span_type)}
            )

    return docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text")).mapInArrow(run, schema)

"""Quality rules by host, with DataFrame functions only.

Each document gets whole-text counts and rule verdicts. Rule failures are summed by host; a host's failure rate is
shrunk towards the corpus rate by a beta prior fitted to all hosts (method of moments); a host whose posterior lies above the
corpus rate for sure is strict; this verdict joins back to its documents and sets how many rules a document may fail there. Texts are read once: counts go to a narrow scratch table
from which the rest is made, and the hosts are written, so that their size is known when they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, words

WINDOW = 8
#: A host is strict when the lower bound of its failure rate exceeds the corpus rate by this factor.
STRICT_FACTOR = 1.0
#: Standard deviations of the posterior between its mean and the lower bound: nineteen of twenty rates lie above it.
BOUND = 1.645
#: Rules that a document may fail on a strict host and on others.
STRICT_FAILURES, OTHER_FAILURES = 0, 1
SYMBOLS = "#*$%&|<>"


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def _neighbours(h: Column, gap: int) -> Column:
    """A hash of each value and the one ``gap`` places on; the last ``gap`` values have no partner and count for nothing."""
    rest = lambda v: F.slice(v, gap + 1, F.greatest(F.size(v) - gap, F.lit(0)))
    return _once(h, lambda v: F.zip_with(v, rest(v), lambda x, y: F.xxhash64(x, y)))


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs again: equal hashes are neighbours, so n log n steps inside the row."""
    placed = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
    again = _once(
        placed,
        lambda p: F.filter(
            F.transform(p, lambda x, k: F.when((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull(),
        ),
    )
    return F.aggregate(
        F.array_sort(again),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + F.lit(WINDOW)).alias("end")),
        lambda a: a["n"],
    )


def _repeat_words(ws: Column) -> Column:
    """Words in windows of WINDOW words that occur again in the text."""
    # Hashes of one word, of two neighbours, of four and of eight: a window costs three steps, whatever its words.
    h = F.transform(ws, lambda w: F.xxhash64(w))
    for gap in (1, 2, 4):
        h = _neighbours(h, gap)
    windows = F.slice(h, F.lit(1), F.size(ws) - (WINDOW - 1))
    count = _once(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0)))
    return F.when(F.size(ws) > WINDOW, count).otherwise(F.lit(0))


def document_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long); null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = _once(words(t), lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws).alias("repeats")))
    lines = F.filter(F.split(t, "\n", -1), _has_word)
    of_lines = _once(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("again")))
    counted = docs.withColumn(
        "_counts",
        F.struct(
            of_words.alias("words"),
            of_lines.alias("lines"),
            F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).alias("chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("symbols"),
        ),
    )
    columns = {
        "n_words": "words.n",
        "word_chars": "chars",
        "n_symbols": "symbols",
        "n_lines": "lines.n",
        "n_dup_lines": "lines.again",
        "n_repeat_words": "words.repeats",
    }
    return counted.withColumns({k: F.col(f"_counts.{v}").cast("long") for k, v in columns.items()}).drop("_counts")


def rule_failures() -> dict[str, Column]:
    """Rules over the counts; a document fails those that are true."""
    n = F.col("n_words")
    return {
        "short": n < 20,
        "repeats": F.lit(100) * F.col("n_repeat_words") > F.lit(30) * n,
        "symbols": F.lit(10) * F.col("n_symbols") > F.lit(3) * n,
        "dup_lines": F.lit(100) * F.col("n_dup_lines") > F.lit(30) * F.col("n_lines"),
        "word_length": (F.col("word_chars") < F.lit(2) * n) | (F.col("word_chars") > F.lit(15) * n),
    }


def host_quality(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    host: str = "source",
    text: str = "text",
    strict_factor: float = STRICT_FACTOR,
    bound: float = BOUND,
    prior: tuple[float, float] | None = None,
) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept, n_failed_rules, host figures.

    base_failed: the rules ``short`` or ``repeats``. A host's failures are its documents that fail any rule;
    host_rate = (failures + a) / (documents + a + b) with the prior's a and b, whose mean is the corpus rate (``prior`` gives
    others than the fitted ones). host_bound is the lower bound of the posterior beta distribution, by its mean and standard
    deviation. host_strict: host_bound exceeds the corpus rate by the factor, so that a host of few documents, or one that
    differs from the others by no more than chance, is not strict whatever its raw rate. A document is kept unless
    base_failed, or it fails more than STRICT_FAILURES rules on a strict host, or more than OTHER_FAILURES elsewhere. A
    document without a failure stays wherever it is.

    Null or empty text: no words, so base_failed. A null host is one host of its own (the empty name). One host, or hosts
    of equal rates: the prior outweighs all, so no host is strict. Repeated rows count each. An empty table gives an empty
    table. Other columns of the input play no part.
    """
    scratch = Scratch(docs.sparkSession)
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("_text")
    )
    counted = document_counts(narrow, text="_text").drop("_text")
    failed = rule_failures()
    n_failed = sum((c.cast("int") for c in failed.values()), F.lit(0))
    table = scratch.save(counted.withColumns({"base_failed": failed["short"] | failed["repeats"], "n_failed_rules": n_failed}), "counts")

    hosts = scratch.save(
        table.groupBy("host").agg(
            F.count("*").alias("host_documents"), F.sum((F.col("n_failed_rules") > 0).cast("long")).alias("host_failures")
        ),
        "hosts",
    )
    n, k = F.col("host_documents").cast("double"), F.col("host_failures").cast("double")
    # One row of five numbers for all hosts.
    fitted = beta_prior(*hosts.agg(F.count("*"), F.sum(n), F.sum(k), F.sum(n * n), F.sum(k * k / n)).first())
    (a, b), corpus = prior or fitted, fitted[0] / sum(fitted)
    rate = (k + F.lit(a)) / (n + F.lit(a + b))
    lower = F.greatest(F.lit(0.0), rate - F.lit(bound) * F.sqrt(rate * (1 - rate) / (n + F.lit(a + b + 1))))
    hosts = hosts.withColumns({"host_rate": F.round(rate, 6), "host_bound": F.round(lower, 6), "corpus_rate": F.lit(round(corpus, 6))})
    hosts = hosts.withColumn("host_strict", F.col("host_bound") > F.col("corpus_rate") * F.lit(strict_factor))
    allowed = F.when(F.col("host_strict"), F.lit(STRICT_FAILURES)).otherwise(F.lit(OTHER_FAILURES))
    return table.join(hosts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_failed_rules") <= allowed)).alias("kept"),
        "n_lines", "n_failed_rules", "host", "host_documents", "host_failures", "host_rate", "host_bound", "corpus_rate",
        "host_strict",
    )


def beta_prior(hosts: int, n: float | None, k: float | None, n2: float | None, kk: float | None) -> tuple[float, float]:
    """Parameters of the beta distribution of host rates by moments.

    From the number of hosts and, over hosts with n documents of which k fail, the sums of n, k, n * n and k * k / n. Hosts
    count by their documents, and what binomial sampling adds to the spread is taken off. The size a + b is kept within 1 to a
    million.
    """
    mean = min(max(k / n if n else 0.0, 1e-6), 1 - 1e-6)
    spread, room = 0.0, 0.0
    if n:
        spread = (kk - k * k / n) / (mean * (1 - mean)) - (hosts - 1)
        room = n - n2 / n - (hosts - 1)
    share = spread / room if room > 0 else 0.0
    size = min(max(1 / max(share, 1e-9) - 1, 1.0), 1e6)
    return mean * size, (1 - mean) * size

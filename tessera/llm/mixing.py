"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their sums over each dimension meet its targets.
Documents are then sampled with calibrated probabilities: the fitted weight of a document's cell over its tokens, scaled so
that the expected tokens of the sample meet the budget although no probability exceeds 1.

The cells are one partitioned table. A round of raking is three window sums over it, one a dimension, so no factor table is
broadcast or collected; the driver sees two numbers a table: how far the sums were off, and the scale of the probabilities.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, packed, unpacked

#: Raking stops when no sum is off its target by more than this share in a round, at last after MAX_ROUNDS.
TOLERANCE, MAX_ROUNDS = 1e-9, 40
#: Rounds that share one plan; then the weights are written.
ROUNDS_A_TABLE = 2
#: Targets flatten observed shares to this power.
TEMPERATURE = 0.7
#: Share of the corpus tokens to sample.
BUDGET = 0.8

DIMS = ("source", "lang", "topic")
RESULTS = ("mix_tokens", "mix_source", "mix_lang", "mix_topic", "mix_weight", "mix_probability", "mix_kept")


def count_words(text: Column) -> Column:
    """Words between ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_form(text: Column, words: Column) -> Column:
    """A topic for texts that carry none: the form of the text."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    pipes = F.length(text) - F.length(F.translate(text, "|", ""))
    return (
        F.when(F.lit(10) * pipes > words, "table").when(F.lit(10) * symbols > F.lit(3) * words, "symbols")
        .when(words < 50, "short").when(words >= 1000, "long").otherwise("prose")
    )


def with_temperature_targets(cells: DataFrame, dims: list[str], temperature: float = TEMPERATURE) -> DataFrame:
    """Adds ``share_<dim>`` for each dimension: its observed token shares to the power, summing to 1 over the values."""
    if not dims:
        return cells
    sums = {d: F.sum("tokens").over(Window.partitionBy(d)).cast("double") for d in dims}
    raised = cells.withColumns(
        {f"share_{d}": F.pow(s, F.lit(temperature)) for d, s in sums.items()} | {f"sum_{d}": s for d, s in sums.items()}
    )
    # A value's power is the sum over its cells of the power times the cell's part of the value.
    part = lambda d: F.sum(F.when(F.col(f"sum_{d}") > 0, F.col(f"share_{d}") * F.col("tokens") / F.col(f"sum_{d}")).otherwise(0.0))
    totals = raised.agg(*[part(d) for d in dims]).first()
    return raised.withColumns(
        {f"share_{d}": F.col(f"share_{d}") / F.lit(t or 1.0) for d, t in zip(dims, totals, strict=True)}
    ).drop(*[f"sum_{d}" for d in dims])


def rake(
    cells: DataFrame, dims: list[str], scratch: Scratch, *, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS
) -> tuple[DataFrame, int, float]:
    """(cells with ``weight``, rounds, gap): ``cells`` have the dimensions, tokens and ``share_<dim>``.

    Weights start as tokens. A null share counts as 0, so a value that no target names gets weight 0. The gap is the largest
    share by which a sum was off its target in the last round; it stays large if the cells can't meet the targets together.
    """
    now, done, gap = cells.withColumn("weight", F.col("tokens").cast("double")), 0, float("inf")
    while gap > tolerance and done < max_rounds:
        for _ in range(min(ROUNDS_A_TABLE, max_rounds - done)):
            now = now.withColumn("gap", F.lit(0.0))
            for d in dims:
                held = F.sum("weight").over(Window.partitionBy(d))
                factor = F.when(held > 0, F.coalesce(f"share_{d}", F.lit(0.0)) / held).otherwise(0.0)
                now = now.withColumn("factor", factor).withColumns(
                    {
                        "gap": F.when(F.col("weight") > 0, F.greatest("gap", F.abs(F.col("factor") - 1))).otherwise(F.col("gap")),
                        "weight": F.col("weight") * F.col("factor"),
                    }
                )
            done += 1
        last, now = now, scratch.save(now.drop("factor"), "weights")
        gap = now.agg(F.coalesce(F.max("gap"), F.lit(0.0))).first()[0]
    return now.drop("gap"), done, gap


def calibrate(cells: DataFrame, budget_tokens: float) -> float:
    """The factor of weight / tokens at which min(1, factor * weight / tokens) expects ``budget_tokens`` tokens.

    Cells that the factor fills are taken out with all their tokens and the rest is scaled anew, until none is added.
    Infinite if all cells with a weight are filled: the budget can't be met.
    """
    factor = budget_tokens
    while True:
        full = F.col("weight") * F.lit(factor) >= F.col("tokens")
        tokens, weight, n = cells.where("weight > 0 and tokens > 0").agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count_if(full),
        ).first()
        if not weight:
            return float("inf") if n else factor
        if (budget_tokens - tokens) / weight <= factor * (1 + 1e-12):
            return factor
        factor = (budget_tokens - tokens) / weight


def unit(doc_id: Column) -> Column:
    """A number in [0, 1) that the id decides."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None,
    tokens: str | None = None, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET,
) -> DataFrame:
    """All rows and columns of ``docs`` plus mix_tokens, mix_source, mix_lang, mix_topic, mix_weight, mix_probability, mix_kept.

    Tokens: words between ASCII white space, or the column ``tokens``. Topics: the form of the text, or the column
    ``topic``. ``targets``: (value, share) tables named source, lang and topic; the default flattens observed shares to
    the power TEMPERATURE. A document's probability is min(1, factor * weight of its cell / tokens of its cell), with the
    factor at which the sample expects ``budget`` of all tokens; a cell of probability 1 is used up. A document is kept if
    ``unit`` of its id is below, so repeated ids share their fate.

    Null source, language or topic is a value of its own (the empty name). A value that no target names has weight 0 and is
    not sampled; a target for a value without tokens is passed over. Targets that can't be met together are fitted for
    MAX_ROUNDS rounds, with a warning. Documents without tokens are kept with probability 1, as they weigh nothing. An
    empty table gives an empty table. Columns named like the results are replaced; any other name may occur in ``docs``.
    """
    scratch = Scratch(docs.sparkSession)
    own = [c for c in docs.columns if c not in RESULTS]
    body = F.coalesce(F.col(text), F.lit("")) if tokens is None or topic is None else None
    d = docs.select(
        packed(docs, own).alias("row"),
        F.col(doc_id).alias("id"),
        *([body.alias("body")] if body is not None else []),
        (count_words(F.col(text)) if tokens is None else F.coalesce(F.col(tokens).cast("long"), F.lit(0))).alias("n"),
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in zip(DIMS, (source, lang, topic), strict=True)
            if c is not None
        ],
    )
    if topic is None:
        d = d.withColumn("topic", text_form(F.col("body"), F.col("n")))
    cells = scratch.save(d.groupBy(*DIMS).agg(F.sum("n").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    given = targets or {}
    shared = with_temperature_targets(cells, [k for k in DIMS if k not in given])
    for k, target in given.items():
        # Shares of the values that have tokens, made to sum to 1.
        present = scratch.save(cells.where("tokens > 0").select(k).distinct().join(target.toDF(k, "share"), k), "given")
        whole = present.agg(F.sum("share")).first()[0]
        shared = shared.join(present.select(k, (F.col("share") / F.lit(whole or 1.0)).alias(f"share_{k}")), k, "left")
    fitted, rounds, gap = rake(scratch.save(shared, "targets"), list(DIMS), scratch)
    if gap > TOLERANCE:
        warnings.warn(
            f"raking: sums are off by up to {gap:.3g} of their targets after {rounds} rounds; the targets can't be met together",
            stacklevel=2,
        )
    factor = calibrate(fitted, budget * total)
    rate = F.when(F.col("tokens") == 0, 1.0).when(
        F.col("weight") > 0, F.least(F.lit(1.0), F.lit(factor) * F.col("weight") / F.col("tokens"))
    ).otherwise(0.0)
    # Written, so that its size is known when the join is planned.
    fitted = scratch.save(fitted.select(*DIMS, F.round("weight", 6).alias("w"), F.round(rate, 6).alias("p")), "fitted")
    p = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.coalesce("p", F.lit(0.0)))
    return d.join(fitted, list(DIMS), "left").select(
        *unpacked("row", own), F.col("n").alias("mix_tokens"), *[F.col(k).alias(f"mix_{k}") for k in DIMS],
        F.coalesce("w", F.lit(0.0)).alias("mix_weight"), p.alias("mix_probability"), (unit(F.col("id")) < p).alias("mix_kept"),
    )

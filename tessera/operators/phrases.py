"""Many phrases in many texts: a multi-pattern automaton over each text.

Phrases are rows of (case, phrase). They are dealt to blocks of about BLOCK_BYTES, whose size is counted first, and each block is
sent to the tasks, which make one automaton of it. A text is read once a block, whatever the number of phrases, and
only phrases of its own case count. Texts stay where they are: nothing is shuffled.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import save

#: Bytes of phrases (each with OVERHEAD bytes for its nodes) that are sent to the tasks at once, about.
BLOCK_BYTES, OVERHEAD = 16 << 20, 64
#: Automata that a worker keeps, by the block's name.
KEEP = 4
_BUILT: dict = {}


def _automaton(shared):
    """(automaton or None, phrases by case that are empty) of a block {lower-cased phrase: {case: [phrases]}}."""
    if shared.id not in _BUILT:
        if len(_BUILT) >= KEEP:
            _BUILT.clear()
        search = ahocorasick.Automaton()
        for low, cases in shared.value.items():
            if low:
                search.add_word(low, cases)
        search.make_automaton()
        _BUILT[shared.id] = (search if len(search) else None, shared.value.get("", {}))
    return _BUILT[shared.id]


class _Block:
    """What a task gets of a block of phrases: the broadcast and its number."""

    def __init__(self, spark, rows: list):
        table: dict[str, dict[str, list[str]]] = {}
        for case, low, phrase in rows:
            table.setdefault(low, {}).setdefault(case, []).append(phrase)
        self.shared, self.id = spark.sparkContext.broadcast(table), uuid.uuid4().hex

    @property
    def value(self) -> dict:
        return self.shared.value


def _finder(block: _Block):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(case: pd.Series, text: pd.Series) -> pd.Series:
        search, always = _automaton(block)
        out = []
        for c, t in zip(case, text, strict=True):
            if t is None:
                out.append([])
                continue
            found = set(always.get(c, ()))
            for _, cases in search.iter(t) if search else ():
                found.update(cases.get(c, ()))
            out.append(sorted(found))
        return pd.Series(out)

    return find


def found_phrases(phrases: DataFrame, case: Column, lowered: Column, *, block_bytes: int = BLOCK_BYTES) -> Column:
    """The distinct phrases of the case that occur in the text, sorted; a phrase is compared in lower case.

    ``phrases``: case_id and phrase, a row each; null ones are none, an empty one occurs in any text. ``lowered`` is a lower-cased
    text; a null one holds nothing.
    """
    listed = phrases.where("phrase is not null").select(F.col("case_id").cast("string").alias("case_id"), F.lower("phrase").alias("low"), "phrase")
    listed = save(listed.distinct())
    size = listed.agg(F.sum(F.octet_length("phrase") * 2 + F.coalesce(F.octet_length("case_id"), F.lit(0)) + OVERHEAD)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for i in range(blocks):
        # Phrases of a block: their bytes are what was counted, dealt by hash.
        own = listed.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == i).collect()
        found.append(_finder(_Block(listed.sparkSession, own))(case.cast("string"), lowered))
    return found[0] if blocks == 1 else F.array_sort(F.flatten(F.array(*found)))

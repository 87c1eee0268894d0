"""Text functions as column expressions. Three white-space rules exist side by side; they are not one rule."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of previews.
PREVIEW_CHARS = 240
INLINE_PREVIEW_CHARS = 180


# The characters that count as white space at the ends of a text.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def review_text(c: Column | str) -> Column:
    """Line feeds only, blanks of a line collapsed and right-trimmed, outer white space off, three line ends or more made two. Null is empty."""
    t = F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = strip(F.regexp_replace(t, r"(?U)[^\S\n]+(?=\n|\z)", ""))
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def inline_of(normalized: Column) -> Column:
    return strip(F.regexp_replace(normalized, r"(?U)\s+", " "))


def inline_text(c: Column | str) -> Column:
    return inline_of(review_text(c))


def paragraphs_of(normalized: Column) -> Column:
    return F.filter(F.transform(F.split(normalized, r"\n\s*\n"), strip), lambda p: p != "")


def paragraphs(c: Column | str) -> Column:
    return paragraphs_of(review_text(c))


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def text_block(c: Column | str) -> Column:
    """Struct of a normalized text with its counts; the text is normalized once, and all else comes from that."""
    raw = F.coalesce(_c(c).cast("string"), F.lit(""))
    block = lambda n, p: F.struct(
        raw.alias("text"), n.alias("normalized"), inline_of(n).alias("inline_normalized"), p.alias("paragraphs"), F.length(n).alias("char_count"),
        F.regexp_count(n, F.lit(r"(?U)\S+")).alias("word_count"), F.when(n == "", 0).otherwise(F.length(n) - F.length(F.replace(n, F.lit("\n"))) + 1).alias("line_count"), F.size(p).alias("paragraph_count"),
    )
    return once(review_text(raw), lambda n: once(paragraphs_of(n), lambda p: block(n, p)))


def list_block(values: Column | str) -> Column:
    """Text blocks of a list, numbered from 1."""
    return F.transform(
        F.coalesce(_c(values), F.array().cast("array<string>")), lambda v, i: F.struct((i + 1).alias("index"), text_block(v).alias("block"))
    )


def comparison_text(fields: dict[str, Column]) -> Column:
    """``FIELD\\nvalue`` of each non-empty field (text or array of texts), in order, joined by blank lines."""
    parts = []
    for name, value in fields.items():
        parts.append(F.when(value != "", F.concat(F.lit(name.upper() + "\n"), value)))
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def json_string_hash(c: Column) -> Column:
    """First 16 hex digits of the sha256 of the text as a JSON string with its quotes."""
    encoded = F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":', ""), r"\}$", "")
    return F.substring(F.sha2(encoded, 256), 1, 16)


def sentences(c: Column | str) -> Column:
    """Segments cut at white space after . ! ? before a capital, digit, quote or bracket."""
    return F.filter(F.transform(F.split(review_text(c), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"), strip), lambda s: s != "")


def embedding_tokens(c: Column | str) -> Column:
    """Lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(r"[A-Za-z0-9_]+"), F.lit(0))


# The letters of a prompt's words, and the shape of a placeholder.
PROMPT_WORD = r"[A-Za-zА-Яа-яЁёЇїІіЄєҐґ0-9]+(?:[-'][A-Za-zА-Яа-яЁёЇїІіЄєҐґ0-9]+)?"
PLACEHOLDER = r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}"


def prompt_stats(c: Column | str) -> Column:
    """Counts of a trimmed prompt text: characters, lines, words, sentences, averages, placeholders, braces."""
    t = strip(F.coalesce(_c(c), F.lit("")))
    lines = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", -1))
    ws = F.regexp_extract_all(t, F.lit(PROMPT_WORD), F.lit(0))
    parts = F.size(F.filter(F.split(t, r"(?U)(?<=[.!?])\s+"), lambda s: strip(s) != ""))
    marks = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(1))))
    letters = F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w))
    return F.struct(
        F.length(t).alias("char_count"),
        F.size(lines).alias("line_count"),
        F.size(F.filter(lines, lambda x: strip(x) != "")).alias("non_empty_line_count"),
        F.size(ws).alias("word_count"),
        parts.alias("sentence_count"),
        F.when(F.size(ws) > 0, F.round(letters / F.size(ws), 4)).otherwise(0.0).alias("avg_word_length"),
        F.when(parts > 0, F.round(F.size(ws) / parts, 4)).otherwise(0.0).alias("avg_sentence_words"),
        F.size(marks).alias("placeholder_count"),
        marks.alias("placeholders"),
        (F.length(t) - F.length(F.translate(t, "{}", ""))).alias("brace_count"),
    )


def chunk_text(c: Column | str) -> Column:
    """Chunk rule: line feeds only, blanks collapse, none around line ends, three line ends or more made two, outer white space off."""
    t = F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" *\n *", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def slug(c: Column | str) -> Column:
    """Lower-cased letters and digits, other runs made one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


# Characters with a Unicode superscript, and with a subscript.
SUPERSCRIPT_FROM, SUPERSCRIPT = "0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"
SUBSCRIPT_FROM, SUBSCRIPT = "0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"


def unicode_script(c: Column | str, superscript: bool) -> Column:
    """Unicode scripts where all characters have one or are blank, else ^(x) or _(x); blanks stay as they are."""
    t = F.coalesce(_c(c), F.lit(""))
    source, to = (SUPERSCRIPT_FROM, SUPERSCRIPT) if superscript else (SUBSCRIPT_FROM, SUBSCRIPT)
    known = t.rlike(rf"(?U)\A[{re.escape(source)}\s\x1C-\x1F]*\z")
    return F.when(known, F.translate(t, source, to)).otherwise(F.concat(F.lit("^(" if superscript else "_("), t, F.lit(")")))


def script_text(value: str, superscript: bool) -> str:
    """unicode_script of one text, for parsers inside tasks."""
    source, to = (SUPERSCRIPT_FROM, SUPERSCRIPT) if superscript else (SUBSCRIPT_FROM, SUBSCRIPT)
    if all(x in source or x.isspace() for x in value):
        return value.translate(str.maketrans(source, to))
    return f"{'^' if superscript else '_'}({value})"


def inline_preview(c: Column | str, limit: int = INLINE_PREVIEW_CHARS) -> Column:
    """One line of at most ``limit`` characters, with dots where it was cut."""
    t = strip(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))).otherwise(t)


def distinct_keywords(values: Column) -> Column:
    """Trimmed, non-empty keywords, the first spelling of each in its order, whatever the case."""
    clean = F.filter(F.transform(values, strip), lambda v: v != "")
    return F.aggregate(
        clean,
        F.array().cast("array<string>"),
        lambda a, v: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(v)), a).otherwise(F.array_append(a, v)),
    )


def tag_list(c: Column | str) -> Column:
    return distinct_keywords(F.split(F.coalesce(_c(c), F.lit("")), ","))


def content_key(pairs: Column) -> Column:
    """First 16 hex digits of the sha256 of a map as compact JSON with sorted keys."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.substring(F.sha2(F.to_json(F.map_from_entries(entries)), 256), 1, 16)


def contains_text(query: str, *columns: Column) -> Column:
    """Lower-cased, blank-joined columns contain the lower-cased query; a blank query matches all."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.lower(F.concat_ws(" ", *columns)).contains(q)


def has_all(values: Column, wanted: list[str]) -> Column:
    return F.size(
        F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), F.coalesce(values, F.array().cast("array<string>")))
    ) == 0

"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(text: Column, pattern: Column) -> Column:
    """How often the pattern occurs in the text, overlaps counted; 0 for an empty pattern.

    A look-ahead makes each match empty, so that the search moves on by one character. Quotes in the pattern end are
    kept literal.
    """
    literal = F.concat(F.lit("(?=\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.length(pattern) > 0, F.regexp_count(text, literal)).otherwise(0).cast("long")


def bit_size(x: Column) -> Column:
    """Bits of a whole number; 1 for 0."""
    return F.length(F.bin(x)).cast("long")


def elapsed(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h "))).otherwise(""), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m "))).otherwise(""), F.concat((s % 60).cast("string"), F.lit("s")))


def replaced(text: Column, old: str = "\u0000", new: str = "\u0002") -> Column:
    return F.translate(text, old, new)


def holds_any(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")) < F.length(text)


def topic_terms(query: Column) -> Column:
    """Terms of a topic line: what follows the first colon, split on single spaces.

    Leading and inner empty terms stay, one trailing empty term goes, and a line without a colon has no terms.
    """
    at = F.instr(query, ":")
    parts = F.split(query.substr(at + 1, F.length(query)), " ")
    last_empty = F.element_at(parts, -1) == ""
    terms = F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(at == 0, F.array().cast("array<string>")).otherwise(terms)


def common_prefix(a: Column, b: Column, longest: int = 64) -> Column:
    """Length of the longest common prefix, up to ``longest``, by halving steps."""
    step, start = 1, F.lit(0)
    while step * 2 <= longest:
        step *= 2
    steps = []
    while step:
        steps.append(step)
        step //= 2

    def longer(n: Column, by: Column) -> Column:
        to = n + by
        return F.when((to <= F.length(a)) & (to <= F.length(b)) & (a.substr(F.lit(1), to) == b.substr(F.lit(1), to)), to).otherwise(n)

    found = F.aggregate(F.array(*(F.lit(s) for s in steps)), start, longer)
    return F.when(a.isNull() | b.isNull(), 0).otherwise(found)

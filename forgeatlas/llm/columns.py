"""Column helpers for work inside arrays, without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also when it is used inside lambdas."""
    return F.transform(F.array(value), use).getItem(0)


def running(values: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """For every element what ``step`` has gathered of the elements *before* it, plus one last
    entry for all of them. Works in chunks, so a long array costs no quadratic copying."""
    start = F.array(F.lit(zero).cast("long"))

    def fold(items: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(
            items, start, lambda got, x: F.concat(got, F.array(step(F.element_at(got, -1), of(x))))
        )

    def joined(items: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil(F.size(items) / _CHUNK)).cast("int")
        cut = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda c: fold(F.slice(items, c * _CHUNK + 1, F.lit(_CHUNK)), lambda x: x),
        )

        def spread(parts: Column, bases: Column) -> Column:
            moved = F.transform(
                parts,
                lambda part, k: F.transform(
                    F.slice(part, F.lit(1), F.size(part) - 1), lambda v: step(F.get(bases, k), v)
                ),
            )
            return F.concat(F.flatten(moved), F.array(F.element_at(bases, -1)))

        return let(cut, lambda parts: let(fold(parts, lambda p: F.element_at(p, -1)), lambda b: spread(parts, b)))

    return let(values, joined)


def match_spans(text: Column, pattern: str, group: int | None = None) -> Column:
    """``array<struct<start, stop, found, part>>`` of the leftmost non-overlapping matches, in
    code points; ``part`` is the given group (else the match). Texts are cut at the matches,
    and the lengths of pieces and matches are summed up."""
    regex = F.lit(pattern)
    cut = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    part = found if group is None else F.regexp_extract_all(text, regex, F.lit(group))

    def build(pieces: Column, matches: Column, parts: Column) -> Column:
        lengths = F.transform(matches, lambda m, k: (F.length(F.get(pieces, k)) + F.length(m)).cast("long"))
        return let(
            running(lengths, 0, lambda a, b: a + b),
            lambda before: F.transform(
                matches,
                lambda m, k: F.struct(
                    (F.get(before, k) + F.length(F.get(pieces, k))).alias("start"),
                    F.get(before, k + 1).alias("stop"),
                    m.alias("found"),
                    F.get(parts, k).alias("part"),
                ),
            ),
        )

    spans = let(cut, lambda p: let(found, lambda m: let(part, lambda g: build(p, m, g))))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint,found:string,part:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(empty)

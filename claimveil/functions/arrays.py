"""Work on a row's own arrays and text whose cost grows with their length, or little faster; all of it Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the chunks that a text is cut into before parts of it are taken, and elements of an array that is short.
CHUNK, SHORT = 4096, 16


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def add(a: Column, b: Column) -> Column:
    return a + b


def running(numbers: Column, join: Callable[[Column, Column], Column] = add) -> Column:
    """Running totals (or maxima, by join) of an array of non-negative integers, each with its own; empty for an empty one.

    An array that grows by one element a step is copied each time, so it is grown in blocks of sqrt(n) elements, which
    then move by what stands before them.
    """
    state = "struct<at:int,out:array<int>>"

    def scan(x: Column, of: Callable[[Column], Column], told: Callable[[Column, Column], Column]) -> Column:
        def step(s: Column, v: Column) -> Column:
            now = join(s["at"], of(v))
            return F.struct(now.alias("at"), F.array_append(s["out"], told(s["at"], now)).alias("out"))

        return F.aggregate(x, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast(state), step, lambda s: s["out"])

    def blocks(x: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")
        return bind(wide, lambda w: F.transform(F.sequence(F.lit(0), F.size(x) - 1, w), lambda k: F.slice(x, k + 1, w)))

    def joined(x: Column) -> Column:
        inner = F.transform(blocks(x), lambda b: scan(b, lambda v: v, lambda before, now: now))
        return bind(inner, lambda b: F.flatten(F.zip_with(b, scan(b, lambda v: F.element_at(v, -1), lambda before, now: before), lambda v, base: F.transform(v, lambda n: join(n, base)))))

    return bind(numbers, lambda x: F.when(F.size(x) > SHORT, joined(x)).otherwise(scan(x, lambda v: v, lambda before, now: now)))


def matches(text: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """All matches of a pattern from the left, as ``array<struct<start,end,match,g<k>...>>``, in code points.

    Match i ends after the first i+1 pieces between matches and the first i+1 matches.
    """
    told = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        *[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in groups],
    )

    def placed(told: Column) -> Column:
        ends = running(F.transform(told, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))))
        found = F.zip_with(told, ends, lambda x, e: F.struct((e - F.length(x["match"])).alias("start"), e.alias("end"), x["match"].alias("match"), *[x[f"g{k}"].alias(f"g{k}") for k in groups]))
        return F.filter(found, lambda x: x["match"].isNotNull())

    return bind(told, placed)


def chunks(text: Column) -> Column:
    """A text in pieces of CHUNK characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(chunked: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive) of a text in chunks; taking one doesn't read the text from its beginning."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    at = lambda k: F.coalesce(F.get(chunked, k), F.lit(""))
    wide = F.concat(
        F.substring(at(first), start - first * CHUNK + 1, F.lit(CHUNK)),
        F.array_join(F.slice(chunked, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(at(last), F.lit(1), end - last * CHUNK),
    )
    return F.when(end <= start, "").when(first == last, F.substring(at(first), start - first * CHUNK + 1, end - start)).otherwise(wide)

"""Names for values within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it within other lambdas."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def running(a: Column, value: Callable[[Column], Column], zero: Column, join: Callable[[Column, Column], Column], kind: str, block: int = 64) -> Column:
    """For each entry of an array, ``value`` of all entries before it joined, from ``zero`` on.

    ``join`` is associative. The array is dealt with in blocks, so that no long array is copied for
    each of its entries: n entries take about n * block + (n / block)^2 steps.
    """
    none = F.array().cast(f"array<{kind}>")

    def scan(x: Column, begin: Column, of: Callable[[Column], Column]) -> Column:
        start = F.struct(begin.cast(kind).alias("at"), none.alias("out"))
        step = lambda acc, e: F.struct(join(acc["at"], of(e)).cast(kind).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(x, start, step, lambda acc: acc["out"])

    def blocks(x: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / block) - 1, F.lit(0)).cast("int"))
        cut = let(places, lambda p: F.transform(p, lambda b: F.slice(x, b * block + 1, block)))

        def of(parts: Column) -> Column:
            totals = F.transform(parts, lambda c: F.aggregate(c, zero.cast(kind), lambda s, e: join(s, value(e)).cast(kind)))
            return F.flatten(F.zip_with(parts, scan(totals, zero, lambda t: t), lambda c, begin: scan(c, begin, value)))

        return let(cut, of)

    return let(a, blocks)

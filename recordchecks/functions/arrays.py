"""Running computations inside one row's array, in (near) linear time.

Spark has no prefix sum over an array.  A fold that appends to its result
copies it at each step, so the fold runs in two levels: over chunks, then
within each chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, first: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Fold of all elements before each one, starting from ``first``."""
    def fold(some: Column, now: Column) -> Column:
        start = F.struct(now.alias("now"), F.filter(F.array(now), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(some, start, lambda a, v: F.struct(
            merge(a["now"], v).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")))["out"]

    def both(v: Column) -> Column:
        def chunk(k: Column) -> Column:
            return F.slice(v, k * CHUNK + 1, CHUNK)

        # an empty array makes the number 0 alone, whose chunk is empty
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / CHUNK).cast("int"))
        whole = F.transform(numbers, lambda k: F.aggregate(chunk(k), first, lambda a, b: merge(a, b)))
        return F.flatten(F.zip_with(numbers, fold(whole, first), lambda k, now: fold(chunk(k), now)))

    return bind(values, both)


def run_starts(sorted_keys: Column) -> Column:
    """For each element of an array with equal keys side by side, the position of the first of its run."""
    def starts(keys: Column) -> Column:
        begins = F.transform(keys, lambda k, i: F.when((i > 0) & k.eqNullSafe(F.get(keys, i - 1)), F.lit(0)).otherwise(i))
        return F.zip_with(running(begins, F.lit(0), lambda a, b: F.greatest(a, b)), begins, lambda a, b: F.greatest(a, b))

    return bind(sorted_keys, starts)


def occurrences(names: Column) -> Column:
    """1-based number of each element among its equals, in array order."""
    def number(pairs: Column) -> Column:
        first = run_starts(F.transform(pairs, lambda p: p["name"]))
        numbered = F.zip_with(pairs, F.transform(first, lambda s, i: i - s + 1), lambda p, n: F.struct(p["pos"], n.alias("n")))
        return F.transform(F.array_sort(numbered), lambda x: x["n"])

    return bind(F.array_sort(F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("pos")))), number)

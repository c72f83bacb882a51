"""Generators that keep the computed array in one place.

``explode(arr)`` makes Catalyst infer ``size(arr) > 0`` and push that filter
below the projections that compute ``arr`` - which copies the whole
expression (a parsed document, all rule checks) into the filter and computes
it twice.  The outer generators get no inferred filter; the null row they
emit for an empty array is dropped by a filter that sits above the generator
and so cannot be pushed down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_kept(df: DataFrame, keep: Sequence, arr: Column | str, out: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(arr).alias(out)).where(F.col(out).isNotNull())


def posexplode_kept(df: DataFrame, keep: Sequence, arr: Column | str, pos: str, out: str) -> DataFrame:
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, out))
            .where(F.col(pos).isNotNull()))


def inline_kept(df: DataFrame, keep: Sequence, arr: Column | str, key: str) -> DataFrame:
    """``inline`` of an array of structs whose field ``key`` is never NULL."""
    return df.select(*keep, F.inline_outer(arr)).where(F.col(key).isNotNull())

"""List functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import clamp, normalize_name, strip


def unique(xs: Column, key: Callable[[Column], Column] = F.lower) -> Column:
    """Stripped, without blanks, each key once, in the order and casing first seen.

    ``key`` is lower case, or ``normalize_name`` to collapse inner white space as well."""
    own = F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), strip), lambda x: x != "")
    keys = F.transform(own, key)
    return F.filter(own, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def unique_names(xs: Column) -> Column:
    return unique(xs, normalize_name)


def union(*lists: Column) -> Column:
    """Ordered union of several lists, distinct by key."""
    return unique(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    of = lambda both: both / (F.size(a) + F.size(b) - both)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.transform(F.array(F.size(F.array_intersect(a, b))), of)[0])


def overlap_share(wanted: Column, held: Column) -> Column:
    """Share of ``wanted`` that ``held`` has; 0 if nothing is wanted."""
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, held)) / F.size(wanted))


def folded_member(x: Column, xs: Column) -> Column:
    """Membership by stripped lower case."""
    return F.exists(xs, lambda y: F.lower(strip(y)) == F.lower(strip(x)))


def trimmed_overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.filter(F.transform(a, strip), lambda x: x != ""), F.transform(b, strip))


def dot(a: Column, b: Column) -> Column:
    """Of two double arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """A vector brought to length 1, so that the product of two is their cosine; one without length stays."""
    return F.transform(F.array(F.sqrt(dot(a, a))), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 if either has no length."""
    return dot(unit(a), unit(b))

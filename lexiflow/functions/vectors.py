"""Vector functions over array columns. Zero vectors have no direction: their cosine is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def align_width(a: Column, width: int) -> Column:
    """Cut, or filled with zeros, to ``width``."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), width)), 1, width)


def hashed_bag(words: Column, width: int = 64) -> Column:
    """array<float> of a text's words, each counted at the place its hash gives: a deterministic stand-in for an embedder.

    The places are sorted, one of each put in, and counted by their runs, so the words are read once whatever the width.
    """
    every = F.sequence(F.lit(0), F.lit(width - 1))
    places = F.sort_array(F.concat(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int")), every))

    def counts(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda p, i: F.when((i == 0) | (F.get(s, i - 1) != p), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(F.array(starts), lambda at: F.transform(every, lambda i: (F.coalesce(F.get(at, i + 1), F.size(s)) - F.get(at, i) - 1).cast("float"))))

    # One lambda argument each for the sorted places and for where their runs start, so neither is computed again.
    return F.flatten(F.transform(F.array(places), counts))


def is_vector(a: Column) -> Column:
    """Not null, without null, NaN or infinite members, and not all zero."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(a, lambda x: x != 0), F.lit(False))

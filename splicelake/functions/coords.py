"""Half-open interval algebra on columns. Differences never fall below zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minus(a: Column, b: Column) -> Column:
    """a - b, at least 0."""
    return F.greatest(a - b, F.lit(0).cast("long"))


def length(start: Column, end: Column) -> Column:
    return minus(end, start)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases shared by two intervals."""
    return minus(F.least(e1, e2), F.greatest(s1, s2))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def contiguous(end: Column, next_start: Column) -> Column:
    """Whether an interval begins where another ends."""
    return end == next_start


def to_closed(start: Column) -> Column:
    """1-based first base of a half-open interval; the end stays."""
    return start + 1


def from_closed(start: Column) -> Column:
    """0-based start of a 1-based closed interval; the end stays."""
    return minus(start, F.lit(1).cast("long"))


def overlap_fraction_of_smaller(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    small = F.least(length(s1, e1), length(s2, e2))
    return F.when(small > 0, overlap(s1, e1, s2, e2) / small).otherwise(F.lit(0.0))


def reciprocal_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    large = F.greatest(length(s1, e1), length(s2, e2))
    return F.when(large > 0, overlap(s1, e1, s2, e2) / large).otherwise(F.lit(0.0))


def is_strand_mirror(c1, s1, e1, t1, c2, s2, e2, t2, share: float = 0.9) -> Column:
    """Same chromosome, opposite strands, overlap of at least ``share`` of the smaller span."""
    opposite = ((t1 == "+") & (t2 == "-")) | ((t1 == "-") & (t2 == "+"))
    return (c1 == c2) & opposite & (overlap_fraction_of_smaller(s1, e1, s2, e2) >= share)

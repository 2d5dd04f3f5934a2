"""Exon arrays and intron chains.

Exons are ``array<struct<start,end>>`` with half-open bounds in ascending order;
introns are ``array<struct<donor,acceptor>>`` where the donor is the end of an
exon and the acceptor the start of the next. Every function takes and returns
columns; a null array gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXONS = "array<struct<start:bigint,end:bigint>>"


def packed_exons(text: Column) -> Column:
    """Exons from a field of packed ``s-e`` blocks (1-based, both ends included)."""
    blocks = F.regexp_extract_all(text, F.lit("[0-9]+-[0-9]+"), F.lit(0))

    def one(x: Column) -> Column:
        part = F.split(x, "-")
        return F.struct((part[0].try_cast("long") - 1).alias("start"), part[1].try_cast("long").alias("end"))

    return F.transform(blocks, one)


def junctions(exons: Column) -> Column:
    """Junctions between consecutive exons."""
    n = F.size(exons) - 1
    pairs = F.zip_with(
        F.slice(exons, 1, F.greatest(n, F.lit(0))),
        F.slice(exons, 2, F.greatest(n, F.lit(0))),
        lambda a, b: F.struct(a["end"].alias("donor"), b["start"].alias("acceptor")),
    )
    return F.when(exons.isNotNull(), pairs)


def introns(exons: Column, min_gap: int = 1) -> Column:
    """Junctions that are real introns: longer than ``min_gap``."""
    return F.filter(junctions(exons), lambda j: j["acceptor"] - j["donor"] > min_gap)


def deletion_aware_junctions(juncs: Column, left_del: Column, right_del: Column) -> Column:
    """Junctions moved outwards by the deletions beside them (arrays of equal length)."""
    three = F.arrays_zip(juncs.alias("j"), left_del.alias("l"), right_del.alias("r"))
    return F.transform(
        three,
        lambda x: F.struct((x["j"]["donor"] - x["l"]).alias("donor"), (x["j"]["acceptor"] + x["r"]).alias("acceptor")),
    )


def intron_lengths(exons: Column) -> Column:
    """Lengths of the introns of more than one base."""
    return F.transform(introns(exons), lambda j: j["acceptor"] - j["donor"])


def exonic_length(exons: Column) -> Column:
    """Total exon length."""
    return F.aggregate(exons, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def bounds(exons: Column) -> Column:
    """Outer span of the exons."""
    return F.struct(F.get(exons, F.lit(0))["start"].alias("start"), F.try_element_at(exons, F.lit(-1))["end"].alias("end"))


def score(exons: Column, coverage: Column) -> Column:
    """Exonic length times coverage."""
    return exonic_length(exons) * coverage


def is_subchain(small: Column, large: Column) -> Column:
    """Whether ``small`` occurs in ``large`` in order (gaps allowed). Empty chains do."""
    matched = F.aggregate(
        large,
        F.lit(0),
        lambda k, x: F.when((k < F.size(small)) & (F.get(small, k) == x), k + 1).otherwise(k),
    )
    return matched == F.size(small)


def is_proper_subchain(small: Column, large: Column) -> Column:
    """Ordered subsequence with fewer members."""
    return (F.size(small) < F.size(large)) & is_subchain(small, large)


def near_equal(a: Column, b: Column, tolerance: int) -> Column:
    """Equal length and every donor and acceptor within the tolerance."""
    close = F.forall(
        F.arrays_zip(a.alias("a"), b.alias("b")),
        lambda x: (F.abs(x["a"]["donor"] - x["b"]["donor"]) <= tolerance)
        & (F.abs(x["a"]["acceptor"] - x["b"]["acceptor"]) <= tolerance),
    )
    return (F.size(a) == F.size(b)) & close


def contiguous_offset(small: Column, large: Column, tolerance: int) -> Column:
    """First offset at which the numbers of ``small`` stand in ``large`` within the tolerance, else -1."""
    last = F.size(large) - F.size(small)
    at = F.filter(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda o: F.forall(
            F.sequence(F.lit(0), F.size(small) - 1),
            lambda k: F.abs(F.get(large, o + k) - F.get(small, k)) <= tolerance,
        ),
    )
    fits = (last >= 0) & (F.size(small) > 0)
    return F.when(fits & (F.size(at) > 0), F.get(at, F.lit(0))).otherwise(F.lit(-1))


def align_lengths(a: Column, b: Column, gap: float = 500.0, per_base: float = 0.1, cap: float = 2000.0) -> Column:
    """Global alignment score of two intron-length chains.

    A pair costs ``per_base`` times its difference (capped), a gap ``gap``. The
    dynamic program is a fold over one array with the previous row as state.
    """
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j * F.lit(-gap))

    def row(prev: Column, x: Column) -> Column:
        start = F.array(prev[0] - F.lit(gap))

        def cell(acc: Column, j: Column) -> Column:
            diff = F.least(F.abs(x - F.get(b, j)).cast("double"), F.lit(cap))
            best = F.greatest(
                F.get(prev, j) - diff * F.lit(per_base),
                F.get(prev, j + 1) - F.lit(gap),
                F.try_element_at(acc, F.lit(-1)) - F.lit(gap),
            )
            return F.concat(acc, F.array(best))

        steps = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, cell)

    return F.element_at(F.aggregate(a, first, row), -1)


def merge_gaps(exons: Column, gap: int = 0) -> Column:
    """Exons (ascending by start) merged where the gap is at most ``gap``.

    With 0 this is the union of overlapping or touching intervals."""
    empty = F.array().cast(EXONS)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(
            (F.size(acc) > 0) & (x["start"] - F.get(acc, F.size(acc) - 1)["end"] <= gap),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)),
        ).otherwise(F.concat(acc, F.array(x)))

    first = F.array(F.get(exons, F.lit(0)))
    rest = F.slice(exons, 2, F.greatest(F.size(exons) - 1, F.lit(0)))
    return F.when(F.size(exons) > 0, F.aggregate(rest, first.cast(EXONS), step)).otherwise(empty)


def union_intervals(intervals: Column) -> Column:
    """Union of intervals in any order."""
    return merge_gaps(F.array_sort(intervals), 0)


def exons_overlap(a: Column, b: Column) -> Column:
    """Bases shared by two exon arrays."""
    return F.aggregate(
        a,
        F.lit(0).cast("long"),
        lambda acc, x: acc
        + F.aggregate(
            b,
            F.lit(0).cast("long"),
            lambda s, y: s
            + F.greatest(F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]), F.lit(0).cast("long")),
        ),
    )


def contained(a: Column, b: Column) -> Column:
    """Every exon of ``a`` lies inside some exon of ``b``."""
    return F.forall(a, lambda x: F.exists(b, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; 0 where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def shorten_terminal(exons: Column, n: int, last: bool) -> Column:
    """Trim up to ``n`` bases from the last (or first) exon, keeping at least one."""
    k = F.size(exons)
    e = F.try_element_at(exons, F.lit(-1)) if last else F.get(exons, F.lit(0))
    cut = F.least(F.lit(n).cast("long"), e["end"] - e["start"] - 1)
    new = F.struct(
        (e["start"] + (0 if last else cut)).alias("start") if not last else e["start"].alias("start"),
        (e["end"] - cut).alias("end") if last else e["end"].alias("end"),
    )
    if last:
        return F.concat(F.slice(exons, 1, k - 1), F.array(new))
    return F.concat(F.array(new), F.slice(exons, 2, k - 1))


def exons_of_chain(start: Column, chain: Column, end: Column) -> Column:
    """Exons of an intron chain with its outer ends; the inverse of ``junctions``."""
    starts = F.concat(F.array(start), F.transform(chain, lambda j: j["acceptor"]))
    ends = F.concat(F.transform(chain, lambda j: j["donor"]), F.array(end))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

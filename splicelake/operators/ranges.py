"""Joins and sweeps over ranges: overlap, tolerance, nearest, coverage, clustering.

Every sweep is computed over bounded bins of an axis with a carry from the
earlier bins, so no window partition grows with the number of rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.operators.islands import label_islands
from splicelake.session import cut


def _null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    l_range: tuple[str, str] = ("start", "end"),
    r_range: tuple[str, str] = ("start", "end"),
    bin_size: int = 1 << 14,
    prefix: str = "r_",
) -> DataFrame:
    """Pairs of overlapping half-open ranges with equal keys.

    Both sides are copied to the bins they touch and joined on (keys, bin); a
    pair that shares several bins counts in the first common one only. The
    right columns come with ``prefix``. Null or empty ranges match nothing.
    """
    ls, le = l_range
    rs, re_ = r_range
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size)))
    a = left.where(F.col(ls) < F.col(le)).withColumn("__bin", bins(ls, le))
    b = right.where(F.col(rs) < F.col(re_)).withColumn("__bin", bins(rs, re_))
    b = b.select(*[F.col(c).alias(f"{prefix}{c}") for c in b.columns])
    cond = F.col("__bin") == F.col(f"{prefix}__bin")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"{prefix}{k}"))
    s2, e2 = F.col(f"{prefix}{rs}"), F.col(f"{prefix}{re_}")
    first = F.floor(F.greatest(F.col(ls), s2) / bin_size)
    return (
        a.join(b, cond)
        .where((F.col(ls) < e2) & (s2 < F.col(le)) & (F.col("__bin") == first))
        .drop("__bin", f"{prefix}__bin")
    )


def merged_ranges(df: DataFrame, keys: Sequence[str], pad: int = 0) -> DataFrame:
    """The union of the ranges of each key (keys, start, end), padded on both sides. Null and empty ranges don't count."""
    keys = list(keys)
    x = df.where(F.col("start") - pad < F.col("end") + pad).select(*keys, (F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    lab = label_islands(x, keys)
    return lab.groupBy(*keys, F.col("__island").alias("start")).agg(F.max("__e").alias("end"))


def overlap_semi(left: DataFrame, right: DataFrame, keys: Sequence[str], ident: str, anti: bool = False, pad: int = 0, **kw) -> DataFrame:
    """Rows of ``left`` that overlap some (anti: no) range of ``right``, padded by ``pad``.

    The right side is merged first, so that a row meets the few stretches it touches, however many
    ranges lie there."""
    hit = overlap_join(left.select(ident, *keys, "start", "end"), merged_ranges(right, keys, pad), keys, **kw).select(ident).distinct()
    return left.join(hit, ident, "left_anti" if anti else "left_semi")


def tolerance_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: int, prefix: str = "r_"
) -> DataFrame:
    """Pairs with equal keys whose ``columns`` all differ by at most ``tolerance``.

    The first column is bucketed by ``tolerance + 1``; the right side is copied
    to three neighbouring buckets, so the join stays an equi-join.
    """
    w, c = tolerance + 1, columns[0]
    a = left.withColumn("__b", F.floor(F.col(c) / w))
    b = right.withColumn("__b", F.explode(F.array(*[F.floor(F.col(c) / w) + d for d in (-1, 0, 1)])))
    b = b.select(*[F.col(x).alias(f"{prefix}{x}") for x in b.columns])
    cond = F.col("__b") == F.col(f"{prefix}__b")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"{prefix}{k}"))
    close = F.lit(True)
    for x in columns:
        close = close & (F.abs(F.col(x) - F.col(f"{prefix}{x}")) <= tolerance)
    return a.join(b, cond).where(close).drop("__b", f"{prefix}__b")


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str, tolerance: int, ident: Sequence[str]) -> DataFrame:
    """Each left row with the nearest right value within ``tolerance`` (ties: the smaller), or null."""
    values = right.select(*keys, column).distinct()
    near = tolerance_join(left.select(*ident, *[k for k in keys if k not in ident], column), values, keys, [column], tolerance)
    best = near.groupBy(*ident).agg(
        F.min(F.struct(F.abs(F.col(column) - F.col(f"r_{column}")).alias("d"), F.col(f"r_{column}").alias("v"))).alias("m")
    )
    return left.join(best.select(*ident, F.col("m.v").alias(f"nearest_{column}")), list(ident), "left")


def coverage_segments(
    df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", weight: Column | None = None, bin_bits: int = 16
) -> DataFrame:
    """Run-length coverage: (keys, start, end, depth) for every stretch of equal depth > 0.

    Range ends become weighted events, summed per position before any sort; the
    running depth and the next event are completed across bins by a carry.
    Neighbouring stretches of equal depth with an event between them stay apart.
    """
    keys = list(keys)
    w = F.lit(1).cast("long") if weight is None else weight
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("__k")
    both = F.array(F.struct(F.col(start).alias("p"), w.alias("d")), F.struct(F.col(end).alias("p"), (-w).alias("d")))
    ok = df.where(F.col(start) < F.col(end)).select(key, F.explode(both).alias("x"))
    ok = ok.select("__k", F.shiftright("x.p", bin_bits).alias("__b"), F.col("x.p").alias("__p"), F.col("x.d").alias("__d"))
    events = ok.where("__b IS NOT NULL").groupBy("__k", "__b", "__p").agg(F.sum("__d").alias("__d"))
    per_bin = events.groupBy("__k", "__b").agg(F.sum("__d").alias("t"), F.min("__p").alias("f"))
    wb = Window.partitionBy("__k").orderBy("__b")
    carry = per_bin.select(
        "__k",
        "__b",
        F.coalesce(F.sum("t").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.lead("f").over(wb).alias("__after"),
    )
    w1 = Window.partitionBy("__k", "__b").orderBy("__p")
    return (
        events.withColumn("__run", F.sum("__d").over(w1.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__next", F.lead("__p").over(w1))
        .join(carry, ["__k", "__b"])
        .select(
            *[F.col(f"__k.k{i}").alias(k) for i, k in enumerate(keys)],
            F.col("__p").alias("start"),
            F.coalesce("__next", "__after").alias("end"),
            (F.col("__run") + F.col("__before")).alias("depth"),
        )
        .where((F.col("depth") > 0) & F.col("end").isNotNull())
    )


def elementary_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Segments between neighbouring breakpoints with the number of ranges that cover them."""
    return coverage_segments(df, keys, start, end)


def range_coverage(segments: DataFrame, ranges: DataFrame, keys: Sequence[str], ident: Sequence[str], bin_size: int = 1 << 14) -> DataFrame:
    """Sum of depth over the bases of each range, and covered bases."""
    hit = overlap_join(ranges, segments, keys, bin_size=bin_size)
    bases = F.least("end", "r_end") - F.greatest("start", "r_start")
    got = hit.groupBy(*ident).agg(F.sum(bases * F.col("r_depth")).alias("cov_sum"), F.sum(bases).alias("cov_bases"))
    return ranges.join(got, list(ident), "left").fillna(0, ["cov_sum", "cov_bases"])


def regions(df: DataFrame, keys: Sequence[str] = ("chrom",), runoff: int = 200, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with their region: a new one begins where start exceeds the running end by more than ``runoff``.

    Adds region_start (the label) and leaves everything else as it is.
    """
    keys = list(keys)
    lab = label_islands(df, keys, start, end, slack=runoff).select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__s").alias("__r_s"), F.col("__island").alias("region_start")
    )
    on = _null_safe([*keys, start], [*[f"__r_{k}" for k in keys], "__r_s"])
    return df.join(lab, on).drop("__r_s", *[f"__r_{k}" for k in keys])


def region_table(df: DataFrame, keys: Sequence[str] = ("chrom",), runoff: int = 200) -> DataFrame:
    """Regions with their bounds and number of rows."""
    return (
        regions(df, keys, runoff)
        .groupBy(*keys, "region_start")
        .agg(F.max("end").alias("region_end"), F.count(F.lit(1)).alias("n_reads"))
    )


def split_uncovered(segments: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Regions of coverage segments split at uncovered runs of at least ``gap`` bases."""
    lab = label_islands(segments, keys, slack=max(gap - 1, 0))
    return lab.groupBy(*keys, F.col("__island").alias("start")).agg(F.max("__e").alias("end"))


def cluster_positions(df: DataFrame, keys: Sequence[str], pos: str = "pos", weight: str = "weight", window: int = 5, least: float = 20) -> DataFrame:
    """Positions chained while the gap to the previous one is at most ``window``.

    One row per cluster of total weight ``least`` or more: centre (weighted mean,
    half rounded up), weight, first and last position.
    """
    keys = list(keys)
    points = cut(df.groupBy(*keys, F.col(pos).alias("__pos")).agg(F.sum(weight).alias("__w")))
    lab = label_islands(points, keys, "__pos", "__pos", slack=window).select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__s").alias("__r_s"), "__island"
    )
    on = _null_safe([*keys, "__pos"], [*[f"__r_{k}" for k in keys], "__r_s"])
    sums = (
        points.join(lab, on)
        .groupBy(*keys, "__island")
        .agg(
            F.sum("__w").alias("weight"),
            F.sum(F.col("__pos") * F.col("__w")).alias("__m"),
            F.max("__pos").alias("last"),
        )
    )
    return sums.where(F.col("weight") >= least).select(
        *keys,
        F.floor(F.col("__m") / F.col("weight") + 0.5).alias("centre"),
        "weight",
        F.col("__island").alias("first"),
        "last",
    )


def merge_points(clusters: DataFrame, points: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """Points merged into the first cluster within ``window`` (integer mean of both); others stay as they are."""
    c = clusters.select(*keys, F.col("centre").alias("pos"))
    near = tolerance_join(points.select(*keys, "pos"), c, keys, ["pos"], window)
    first = near.groupBy(*keys, "pos").agg(F.min("r_pos").alias("__c"))
    return points.join(first, [*keys, "pos"], "left").withColumn(
        "merged", F.when(F.col("__c").isNotNull(), F.floor((F.col("__c") + F.col("pos")) / 2)).otherwise(F.col("pos"))
    ).drop("__c")

"""Merging overlapping intervals into periods and listing the gaps.

The textbook plan (one window per entity ordered by start) puts a whole entity
into one task. Here no window partition can grow with the data:

1. rows with equal (entity, start) collapse to the largest end, combined
   map-side;
2. an entity's axis is cut into bins of ``2**bin_bits`` positions, so after
   step 1 a bin holds at most that many rows;
3. the running maximum of previous ends inside a bin is completed with a carry
   from the earlier bins of the entity, computed on one row per bin;
4. island labels (the first start of the island) are carried likewise;
5. periods are an ordinary aggregation over the label, again combined map-side.

Windows over bins hold one row per occupied bin of an entity: 32,768 rows for a
coordinate range of 2**31 with the default bin size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_S, _E, _B = "__s", "__e", "__bin"


def label_islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    slack: int = 0,
    bin_bits: int = 16,
) -> DataFrame:
    """One row per distinct (keys, start) with its island.

    Columns: keys, ``__s`` (start), ``__e`` (largest end at that start),
    ``__prev`` (largest end of all earlier starts, null for the first),
    ``__island`` (start of the island). A row opens an island when its start
    exceeds ``__prev + slack``. Rows whose start or end is null are dropped;
    keys may be null and null is a key of its own.
    """
    keys = list(keys)
    # one struct holds the keys: it is never null and compares null fields as equal, so joins
    # and windows agree on one partitioning
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("__k")
    base = df.select(key, F.col(start).cast("long").alias(_S), F.col(end).cast("long").alias(_E))
    base = base.withColumn(_B, F.shiftright(F.col(_S), bin_bits)).where(
        F.col(_S).isNotNull() & F.col(_E).isNotNull() & F.col(_B).isNotNull()
    )
    pre = base.groupBy("__k", _B, _S).agg(F.max(_E).alias(_E))
    over_bins = Window.partitionBy("__k").orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    in_bin = Window.partitionBy("__k", _B).orderBy(_S)

    def carried(x: DataFrame, value: str, name: str) -> DataFrame:
        """Per bin the largest value of the earlier bins of the entity."""
        m = x.groupBy("__k", _B).agg(F.max(value).alias("__m"))
        return m.select("__k", _B, F.max("__m").over(over_bins).alias(name))

    before = F.max(_E).over(in_bin.rowsBetween(Window.unboundedPreceding, -1))
    prev = F.greatest(F.col("__carry"), F.col("__in_bin"))
    flagged = (
        pre.withColumn("__in_bin", before)
        .join(carried(pre, _E, "__carry"), ["__k", _B])
        .select("__k", _B, _S, _E, prev.alias("__prev"))
        .withColumn("__open", F.when(F.col("__prev").isNull() | (F.col(_S) - slack > F.col("__prev")), F.col(_S)))
    )
    here = F.max("__open").over(in_bin.rowsBetween(Window.unboundedPreceding, 0))
    out = (
        flagged.withColumn("__here", here)
        .join(carried(flagged, "__open", "__label"), ["__k", _B])
        .withColumn("__island", F.coalesce("__here", "__label"))
    )
    return out.select(
        *[F.col(f"__k.k{i}").alias(k) for i, k in enumerate(keys)], _S, _E, "__prev", "__open", "__island"
    )


def periods_and_gaps(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    closed: bool = True,
    bin_bits: int = 16,
) -> DataFrame:
    """Periods covered without interruption, and the gaps between them.

    Result: keys, kind (``period`` or ``gap``), p_start, p_end, in the
    coordinates of the input: both ends included if ``closed``, end excluded
    otherwise. Intervals that leave no base between them belong together.
    Null, reversed and (half-open) empty intervals don't count; repeated rows,
    nesting and ties change nothing; an empty table gives an empty result.
    """
    keys = list(keys)
    s, e = F.col(start), F.col(end)
    ok = df.where((s <= e) if closed else (s < e))
    lab = label_islands(ok, keys, start, end, slack=1 if closed else 0, bin_bits=bin_bits)
    # one pass gives both: a row that opens an island after another one also ends a gap
    step = 1 if closed else 0
    grouped = lab.groupBy(*keys, "__island").agg(
        F.max("__e").alias("__p_end"),
        F.max(F.when(F.col("__open").isNotNull(), F.col("__prev"))).alias("__before"),
    )
    both = F.array(
        F.struct(
            F.lit("period").alias("kind"),
            F.col("__island").alias("p_start"),
            F.col("__p_end").alias("p_end"),
        ),
        F.when(
            F.col("__before").isNotNull(),
            F.struct(
                F.lit("gap").alias("kind"),
                (F.col("__before") + step).alias("p_start"),
                (F.col("__island") - step).alias("p_end"),
            ),
        ),
    )
    return (
        grouped.select(*keys, F.explode(both).alias("__r"))
        .where(F.col("__r").isNotNull())
        .select(*keys, "__r.kind", "__r.p_start", "__r.p_end")
    )

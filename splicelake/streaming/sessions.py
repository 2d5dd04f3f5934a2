"""Sessions, growing regions and repeats on streams; the same functions serve batch frames.

A position takes the place of event time: one base is one second since the epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming else df


def sessions(df: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions per key: first and last window bound and number of events.

    A session ends ``gap`` after its last event. On a stream, rows later than
    ``late`` behind the newest are dropped and sessions come out once the
    watermark has passed them; a batch frame gives all at once."""
    x = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__ts", F.col(ts).cast("timestamp"))
    w = F.session_window("__ts", gap)
    g = _watermarked(x, "__ts", late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def as_time(pos) -> F.Column:
    """A position as a timestamp: seconds since the epoch."""
    return F.timestamp_seconds(pos)


def growing_regions(df: DataFrame, runoff: int = 200, late_bases: int = 100_000) -> DataFrame:
    """Regions of alignments (chrom, start, end) as sessions with a gap per row: its own
    length plus ``runoff``. Rows may come out of order by up to ``late_bases``."""
    x = df.where("chrom IS NOT NULL AND start < end").withColumn("__ts", as_time(F.col("start")))
    gap = F.concat((F.col("end") - F.col("start") + runoff + 1).cast("string"), F.lit(" seconds"))
    w = F.session_window("__ts", gap)
    g = _watermarked(x, "__ts", f"{late_bases} seconds").groupBy("chrom", w.alias("w")).agg(F.count(F.lit(1)).alias("n_reads"))
    end = F.unix_timestamp(F.col("w.end").cast("timestamp")) - runoff - 1
    return g.select("chrom", F.unix_timestamp("w.start").alias("region_start"), end.alias("region_end"), "n_reads")


def first_seen(df: DataFrame, keys: list[str], start: str = "start", late_bases: int = 100_000) -> DataFrame:
    """S3: repeats of equal ``keys`` dropped; on a stream the state is bounded by the watermark."""
    x = df.withColumn("__ts", as_time(F.col(start)))
    if df.isStreaming:
        return x.withWatermark("__ts", f"{late_bases} seconds").dropDuplicatesWithinWatermark(keys).drop("__ts")
    return x.dropDuplicates(keys).drop("__ts")


def check_order(df: DataFrame, keys: list[str], pos: str, order: str) -> DataFrame:
    """Keys whose positions fall along ``order``, with the number of descents."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("__prev", F.lag(pos).over(w)).where(F.col("__prev") > F.col(pos))
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_descents"))

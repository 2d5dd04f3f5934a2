"""Per-key results where few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, sample_rows: int = 200_000, seed: int = 7) -> DataFrame:
    """Keys that hold about ``share`` of the rows or more, by sampling.

    A Bernoulli sample of about ``sample_rows`` keys is counted; at most
    ``1/share`` keys can reach the threshold, so the result is safe to
    broadcast whatever the size of the table. A key missed or wrongly reported
    only changes which path computes it, never a result. Null keys are no keys.
    """
    keys = df.select(F.col(key).alias("__key")).where(F.col("__key").isNotNull())
    n = df.count()
    picked = keys.sample(fraction=min(1.0, sample_rows / max(n, 1)), seed=seed)
    counts = picked.groupBy("__key").count()
    least = max(1.0, share * min(n, sample_rows))
    rows = counts.where(F.col("count") >= least).orderBy(F.desc("count")).limit(int(1 / share)).collect()
    return df.sparkSession.createDataFrame([(r["__key"],) for r in rows], keys.schema)


def per_key_report(
    df: DataFrame,
    key: str,
    thing: str,
    amount: Column,
    share: float = 0.02,
    salts: int = 64,
) -> DataFrame:
    """Rows, distinct non-null ``thing`` and sum of ``amount`` per non-null key.

    Heavy keys, found by sampling, reach the rows by a broadcast join that
    deals each of them into ``salts`` slices by the hash of ``thing``; slices
    are aggregated on their own and added up (a value lives in one slice, so
    distinct counts add). All other keys take the ordinary shuffle. Both parts
    are united. Null amounts count 0; an empty table gives an empty result.
    """
    base = df.select(
        F.col(key).alias("__key"),
        F.col(thing).alias("__thing"),
        F.coalesce(amount, F.lit(0)).cast("long").alias("__amount"),
    ).where(F.col("__key").isNotNull())
    hot = F.broadcast(heavy_keys(df, key, share).withColumnRenamed("__key", "__hot"))
    on = F.col("__key") == F.col("__hot")
    measures = [
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("__thing").alias("n_things"),
        F.sum("__amount").alias("total"),
    ]
    sliced = (
        base.join(hot, on)
        .withColumn("__slice", F.pmod(F.xxhash64("__thing"), F.lit(salts)).cast("int"))
        .groupBy("__key", "__slice")
        .agg(*measures)
    )
    heavy = sliced.groupBy("__key").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_things", "total")])
    light = base.join(hot, on, "left_anti").groupBy("__key").agg(*measures)
    return heavy.unionByName(light).withColumnRenamed("__key", key)

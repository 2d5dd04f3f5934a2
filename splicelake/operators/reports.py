"""Comparisons of runs, stages and logs (A42, A43, P17, J35, and the offline tools)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.operators.ranges import overlap_join


def diff_logs(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two decision logs side by side: keys, fate (only_a, only_b, same, changed), and the columns
    that differ. Keys compare null-safely; repeated keys are compared as bags by their number."""
    side = lambda x, s: x.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct(*values, "__n"))).alias(s)
    )
    left = side(a, "__a")
    right = side(b, "__b").select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    j = left.join(right, on, "full")
    one = (F.size("__a") == 1) & (F.size("__b") == 1)
    first = lambda s, c: F.get(s, F.lit(0))[c]
    differ = F.array_compact(F.array(*[F.when(~first("__a", c).eqNullSafe(first("__b", c)), F.lit(c)) for c in values]))
    fate = (
        F.when(F.col("__b").isNull(), "only_a")
        .when(F.col("__a").isNull(), "only_b")
        .when(F.col("__a") == F.col("__b"), "same")
        .otherwise("changed")
    )
    keyed = [F.when(F.col("__a").isNotNull(), F.col(k)).otherwise(F.col(f"__k_{k}")).alias(k) for k in keys]
    return j.select(*keyed, fate.alias("fate"), F.when((fate == "changed") & one, F.array_join(differ, ",")).otherwise("").alias("columns"))


def kill_stage(references: DataFrame, stages: Sequence[tuple[str, DataFrame]], key: str = "ref_id") -> DataFrame:
    """The first stage, in order, at which a reference is missing ('' if it survives all)."""
    x = references.select(key).distinct()
    lost = F.lit("")
    for i, (name, df) in reversed(list(enumerate(stages))):
        seen = df.select(key).distinct().withColumn(f"__s{i}", F.lit(True))
        x = x.join(seen, key, "left")
        lost = F.when(F.col(f"__s{i}").isNull(), F.lit(name)).otherwise(lost)
    return x.select(key, lost.alias("lost_at"))


def stage_counts(stages: Sequence[tuple[str, DataFrame]], by: Sequence[str]) -> DataFrame:
    """P1, shadow counts: rows per group and stage, one column a stage."""
    out = None
    for name, df in stages:
        x = df.select(*by, F.lit(name).alias("stage"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy(*by).pivot("stage", [n for n, _ in stages]).count().fillna(0, [n for n, _ in stages])


def match_regions(found: DataFrame, expected: DataFrame, keys: Sequence[str] = ("chrom",), slack: int = 0) -> DataFrame:
    """Expected regions with their best match: exact (both bounds within ``slack``), overlap or missing,
    counted. Both need chrom, start, end."""
    e = expected.select(*keys, "start", "end").distinct().withColumn("id", F.monotonically_increasing_id())
    hit = overlap_join(e, found.select(*keys, "start", "end"), keys)
    same = (F.abs(F.col("start") - F.col("r_start")) <= slack) & (F.abs(F.col("end") - F.col("r_end")) <= slack)
    best = hit.groupBy(*keys, "start", "end").agg(F.max(same.cast("int")).alias("same"))
    x = e.drop("id").join(best, [*keys, "start", "end"], "left")
    fate = F.when(F.col("same").isNull(), "missing").when(F.col("same") == 1, "exact").otherwise("overlap")
    return x.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


def junction_trace(targets: DataFrame, stages: Sequence[tuple[str, DataFrame]], value: str = "mrcount") -> DataFrame:
    """Support of target junctions at each stage, one column a stage (null where absent)."""
    key = ["chrom", "strand", "donor", "acceptor"]
    x = targets.select(*key).distinct()
    for name, df in stages:
        x = x.join(df.groupBy(*key).agg(F.sum(value).alias(name)), key, "left")
    return x


def compare_graphs(a: DataFrame, b: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Graphs of two runs per bundle: shared and own parts (nodes by bounds or edges by ends), and
    whether they are the same."""
    x = a.select(*keys, *parts).distinct().withColumn("__a", F.lit(1))
    y = b.select(*keys, *parts).distinct().withColumn("__b", F.lit(1))
    j = x.join(y, [*keys, *parts], "full")
    c = lambda k: F.count(F.when(k, 1))
    out = j.groupBy(*keys).agg(
        c(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("shared"),
        c(F.col("__b").isNull()).alias("only_a"), c(F.col("__a").isNull()).alias("only_b"),
    )
    return out.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def panel(df: DataFrame, score: Sequence[Column], n: int, tie: str) -> DataFrame:
    """The ``n`` rows of highest scores in order (a top-n report); ties by ``tie``."""
    return df.orderBy(*[F.desc_nulls_last(s) if isinstance(s, str) else s.desc_nulls_last() for s in score], tie).limit(n)


def chain_collapse(refs: DataFrame) -> DataFrame:
    """Reference transcripts of one place and intron chain collapsed: the widest (ties: smallest id)
    stands for all, with their number. Needs tx_id, chrom, strand, exons."""
    from splicelake.operators.transcripts import with_structure

    x = with_structure(refs).where("n_exons > 1")
    best = F.max(F.struct((F.col("end") - F.col("start")).alias("w"), (-F.col("tx_id")).alias("i")))
    return x.groupBy("chrom", "strand", "chain").agg((-best["i"]).alias("tx_id"), F.count(F.lit(1)).alias("n_refs")).drop("chain")


def coherence(members: DataFrame, value: str) -> DataFrame:
    """Family coherence: members, mean and coefficient of variation of a value per family."""
    m, sd = F.avg(value), F.stddev_pop(value)
    return members.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), m.alias("mean"), F.when(m != 0, sd / m).otherwise(F.lit(0.0)).alias("cv")
    )

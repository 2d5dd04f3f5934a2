"""Projections of the supplied tables to the frames the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.functions import chains
from splicelake.operators import transcripts as T
from splicelake.session import spread
from splicelake.sources.tables import table

BUNDLE = ["run_id", "chrom", "bdstart", "bdend", "strand"]


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Alignments: row_id, run_id, chrom, strand (0 unknown), read_name, exons, start, end, weight.

    Rows without chromosome or with exons that are missing, empty, reversed or out
    of order don't count."""
    x = table(spark, d, "aligned_reads").where("chrom IS NOT NULL AND exons IS NOT NULL")
    # parsing is the heavy part of small scans; a scan with enough splits is left alone
    x = spread(x.select("row_id", "run_id", "chrom", "strand", "read_name", "exons"))
    x = x.select(
        "row_id", "run_id", "chrom", F.coalesce("strand", F.lit(0)).alias("strand"), "read_name",
        # one generated row each: filters on the parsed value stay above, so it is parsed once
        F.explode(F.array(chains.packed_exons(F.col("exons")))).alias("exons"),
    )
    e = F.col("exons")
    sane = F.forall(e, lambda k: k["start"] < k["end"]) & F.forall(chains.junctions(e), lambda j: j["donor"] <= j["acceptor"])
    b = chains.bounds(e)
    x = x.where((F.size(e) > 0) & sane)
    return x.select("*", b["start"].alias("start"), b["end"].alias("end"), F.lit(1).cast("long").alias("weight"))


def exon_rows(r: DataFrame) -> DataFrame:
    return r.select("row_id", "chrom", "strand", F.explode("exons").alias("e")).select(
        "row_id", "chrom", "strand", F.col("e.start").alias("start"), F.col("e.end").alias("end")
    )


def chain_transcripts(r: DataFrame) -> DataFrame:
    """Transcripts of the multi-exon reads: one per (place, intron chain) with its outermost ends."""
    x = T.read_chains(r)
    ex = chains.exons_of_chain(F.col("start"), F.col("chain"), F.col("end"))
    return x.select("tx_id", "chrom", "strand", ex.alias("exons"), F.col("coverage").cast("double").alias("coverage"), F.col("coverage").alias("longcov"))


def transcripts(r: DataFrame) -> DataFrame:
    """Transcripts of all reads: those of chains, and each distinct single exon as one of its own. One shuffle."""
    x = T.with_structure(r)
    lone = F.when(F.col("n_exons") == 1, F.struct("start", "end"))
    g = x.groupBy(*T.PLACE, "chain", lone.alias("lone")).agg(
        F.min("row_id").alias("tx_id"), F.sum("weight").alias("longcov"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    ex = chains.exons_of_chain(F.col("start"), F.col("chain"), F.col("end"))
    return g.select("tx_id", "chrom", "strand", ex.alias("exons"), F.col("longcov").cast("double").alias("coverage"), "longcov")


def retaining(r: DataFrame, gap: int = 2500) -> DataFrame:
    """Reads of which every seventh keeps its introns of at most ``gap`` bases: the tables hold no retained introns."""
    kept = F.when(F.col("row_id") % 7 == 0, chains.merge_gaps(F.col("exons"), gap)).otherwise(F.col("exons"))
    return r.withColumn("exons", kept)


def halves(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads of cells 1 and 2 and of all other cells (named in the read; reads without a name are
    among these): two samples to compare."""
    x = r.withColumn("__cell", F.coalesce(F.regexp_extract("read_name", "_s([0-9]+)/", 1), F.lit("")))
    first = F.col("__cell").isin("1", "2")
    return x.where(first).drop("__cell"), x.where(~first).drop("__cell")


def flow_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths pushed through bundle graphs: bundle, path, abundance. Null parts and empty paths don't count."""
    x = table(spark, d, "flow_iterations").where("path_nodes IS NOT NULL AND bottleneck IS NOT NULL AND chrom IS NOT NULL")
    p = F.transform(F.regexp_extract_all("path_nodes", F.lit("[0-9]+"), F.lit(0)), lambda v: v.cast("long"))
    return x.select(*BUNDLE, p.alias("path"), F.col("bottleneck").alias("abundance")).where(F.size("path") > 0)


def panels(spark: SparkSession, d: str) -> DataFrame:
    """Needy loci as ranges: row_id, chrom, start, end."""
    x = table(spark, d, "ggo19_needy_top15").where("chrom IS NOT NULL AND panel_start < panel_end")
    return x.select("row_id", "chrom", F.col("panel_start").alias("start"), F.col("panel_end").alias("end"))


def placements(r: DataFrame) -> DataFrame:
    """Reads by locus: read, locus (chromosome and region start), compat (tenths of exons, at most 1)."""
    from splicelake.operators.ranges import regions

    x = regions(r, ["chrom"]).where("read_name IS NOT NULL")
    compat = F.least(F.size("exons"), F.lit(10)) / 10.0
    return x.select(F.col("read_name").alias("read"), F.concat_ws(":", "chrom", "region_start").alias("locus"), compat.alias("compat"))

"""Read-level filters and corrections (2.3, 2.4): frames in the columns of the SAM and BAM readers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.functions import chains
from splicelake.functions import sequences as S
from splicelake.operators.ranges import overlap_semi


def mask_regions(reads: DataFrame, masks: DataFrame, ident: str = "row_id") -> DataFrame:
    """Alignments that overlap no mask (chrom, start, end)."""
    return overlap_semi(reads, masks, ["chrom"], ident, anti=True)


def drop_secondary(reads: DataFrame, keep: bool = False) -> DataFrame:
    """Secondary and supplementary rows dropped unless ``keep`` (family mode)."""
    return reads if keep else reads.where("is_primary")


def drop_tail_artefacts(reads: DataFrame) -> DataFrame:
    """Reads of at most two exons whose aligned tail is A or T dropped (columns a_tail, t_tail)."""
    tail = F.coalesce(F.col("a_tail"), F.lit(False)) | F.coalesce(F.col("t_tail"), F.lit(False))
    return reads.where(~((F.size("exons") <= 2) & tail))


def cap_span(exons: Column, cap: int) -> Column:
    """Exons before the first intron longer than ``cap``."""
    j = chains.junctions(exons)
    first = F.array_position(F.transform(j, lambda x: (x["acceptor"] - x["donor"]) > cap), True)
    return F.when(first > 0, F.slice(exons, F.lit(1), first.cast("int"))).otherwise(exons)


def kept_exons(reads: DataFrame, good: DataFrame, ident: str = "row_id", tiny: int = 50, share: float = 0.5) -> DataFrame:
    """G2 keep-exon rule: exons with keep. A tiny exon (below ``tiny`` bases and ``share`` of the
    read's exonic length) needs a good junction (chrom, donor, acceptor) beside it."""
    g = good.select("chrom", "donor", "acceptor").distinct().withColumn("ok", F.lit(True))
    j = reads.select(ident, "chrom", F.posexplode(chains.junctions(F.col("exons"))).alias("i", "j"))
    j = j.select(ident, "chrom", "i", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor")).join(g, ["chrom", "donor", "acceptor"])
    beside = j.select(ident, F.explode(F.array("i", F.col("i") + 1)).alias("i")).distinct().withColumn("ok", F.lit(True))
    total = chains.exonic_length(F.col("exons"))
    e = reads.select(ident, "chrom", total.alias("total"), F.posexplode("exons").alias("i", "e")).join(beside, [ident, "i"], "left")
    n = F.col("e.end") - F.col("e.start")
    small = (n < tiny) & (n < F.col("total") * F.lit(share))
    return e.select(ident, "chrom", "i", F.col("e.start").alias("start"), F.col("e.end").alias("end"), (~small | F.col("ok").isNotNull()).alias("keep"))


def neutralise(reads: DataFrame, good: DataFrame, ident: str = "row_id") -> DataFrame:
    """Multi-exon reads without any good junction lose their strand (0)."""
    g = good.select("chrom", "donor", "acceptor").distinct()
    j = reads.select(ident, "chrom", F.explode(chains.junctions(F.col("exons"))).alias("j"))
    j = j.select(ident, "chrom", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor"))
    some = j.join(g, ["chrom", "donor", "acceptor"], "left_semi").select(ident).distinct().withColumn("__some", F.lit(True))
    x = reads.join(some, ident, "left")
    lost = (F.size("exons") > 1) & F.col("__some").isNull()
    return x.withColumn("strand", F.when(lost, F.lit(0)).otherwise(F.col("strand"))).drop("__some")


def without_killed(tx: DataFrame, killed: DataFrame, ident: str = "tx_id") -> DataFrame:
    """Transcripts (or reads) that use no killed junction (chrom, donor, acceptor)."""
    k = killed.select("chrom", "donor", "acceptor").distinct()
    j = tx.select(ident, "chrom", F.explode(chains.junctions(F.col("exons"))).alias("j"))
    j = j.select(ident, "chrom", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor"))
    return tx.join(j.join(k, ["chrom", "donor", "acceptor"], "left_semi").select(ident).distinct(), ident, "left_anti")


def terminal_valid(length: Column, killed: Column, support: int = 10) -> Column:
    """A terminal exon is valid if it is long enough or its junction lives."""
    return (length >= support) | ~killed


def mates_joinable(gap: Column, left_valid: Column, right_valid: Column, localdist: int = 50) -> Column:
    return (gap < localdist) & left_valid & right_valid


def trim_tail_exons(reads: DataFrame) -> DataFrame:
    """Terminal exons flagged as tails (last_is_a, first_is_t) dropped; a read of two exons with both
    flags, or of one with any, is discarded."""
    n = F.size("exons")
    a, t = F.coalesce("last_is_a", F.lit(False)), F.coalesce("first_is_t", F.lit(False))
    left = n - a.cast("int") - t.cast("int")
    cut = F.slice("exons", F.when(t, 2).otherwise(1), F.greatest(left, F.lit(0)))
    return reads.where(left > 0).withColumn("exons", F.when(left > 0, cut).otherwise(F.col("exons")))


def mismatch_weight(weight: Column, nm: Column, length: Column, clipped: Column, nh: Column, long_reads: bool = True, fraction: float = 0.02) -> Column:
    """Weight that counts as mismatched: all of it for long reads; else where the edit rate exceeds
    the fraction, an end is clipped, or the read has more than two placements."""
    if long_reads:
        return weight
    bad = (nm > length * F.lit(fraction)) | clipped | (nh > 2)
    return F.when(bad, weight).otherwise(F.lit(0.0))


def pair_weight(weight: Column, nh: Column, mate_nh: Column) -> Column:
    """1 / mate NH where the mate is placed more often, else the own weight."""
    return F.when(mate_nh > nh, F.lit(1.0) / mate_nh).otherwise(weight)


def strand_kill_filter(juncs: DataFrame, strand: int) -> DataFrame:
    """Live junctions of one strand: matching strand, not killed, mm not negative."""
    return juncs.where((F.col("strand") == strand) & (F.col("strand") != 0) & (F.coalesce("mm", F.lit(0)) >= 0))


def mismatches(start: int, cigar: list[tuple[int, str]], seq: str, reference: str, ref_start: int) -> list[tuple[int, str]]:
    """(position, base) where a read differs from the reference over aligned columns. Positions
    beyond the given reference piece are skipped; N and = count as no difference."""
    out, r, q = [], start, 0
    for n, op in cigar:
        if op in "M=X":
            for k in range(n):
                at = r + k - ref_start
                if 0 <= at < len(reference) and q + k < len(seq):
                    a, b = seq[q + k].upper(), reference[at].upper()
                    if a != b and a not in "N=" and b != "N":
                        out.append((r + k, a))
        if op in "M=XDN":
            r += n
        if op in "M=XIS":
            q += n
    return out


def read_mismatches(reads: DataFrame, contigs: DataFrame, ident: str = "row_id") -> DataFrame:
    """A27 input: (ident, pos, base) of all mismatches. ``contigs``: name, seq. The reference piece
    of each read is cut out by a join on the contig, then compared in Arrow batches."""
    from splicelake.sources.text import fetch

    r = reads.where("is_mapped AND seq IS NOT NULL").select(F.col(ident).alias("__id"), "chrom", "start", "end", "cigar", F.col("seq").alias("query"))
    x = fetch(contigs, r).select("__id", "start", "cigar", "query", "seq")
    kind = x.schema["__id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        op = re.compile(S.CIGAR_OP)
        for b in batches:
            ids, pos, base = [], [], []
            for i, start, cigar, query, ref in zip(*(b.column(k).to_pylist() for k in range(5))):
                for p, c in mismatches(start, [(int(n), o) for n, o in op.findall(cigar)], query, ref or "", start):
                    ids.append(i)
                    pos.append(p)
                    base.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(pos, pa.int64()), pa.array(base, pa.string())], names=["__id", "pos", "base"])

    return x.mapInArrow(run, f"__id {kind}, pos bigint, base string").withColumnRenamed("__id", ident)


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a hash as a signed number. Spark joins use the value itself or xxhash64."""
    h = 0xCBF29CE484222325  # fixed value of the hash
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h

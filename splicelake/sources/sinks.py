"""Writers: GTF, abundance tables, exon and intron tables, JSON lines, signatures.

All write through Spark's file sinks, so a result is a folder of part files
written in parallel; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.functions import chains


def _mark(strand: Column) -> Column:
    s = strand.cast("string")
    return F.when(s.isin("1", "+"), "+").when(s.isin("-1", "-"), "-").otherwise(".")


def gtf_lines(tx: DataFrame, source: str = "assembly") -> DataFrame:
    """Transcript and exon lines in order (column value). 1-based closed bounds, six decimals.
    Needs tx_id, gene_id, chrom, strand, exons, coverage; fpkm, tpm, longcov if there."""
    q = lambda k, v: F.concat(F.lit(f'{k} "'), v.cast("string"), F.lit('"; '))
    six = lambda c: F.format_string("%.6f", c.cast("double"))
    ids = F.concat(q("gene_id", F.col("gene_id")), q("transcript_id", F.col("tx_id")))
    extra = F.concat(
        q("cov", six(F.col("coverage"))), *[q(n, six(F.col(c))) for n, c in (("FPKM", "fpkm"), ("TPM", "tpm"), ("longcov", "longcov")) if c in tx.columns]
    )
    b = chains.bounds(F.col("exons"))
    line = lambda kind, s, e, attrs: F.concat_ws(
        "\t", F.col("chrom"), F.lit(source), F.lit(kind), (s + 1).cast("string"), e.cast("string"), F.lit("1000"), _mark(F.col("strand")), F.lit("."), F.trim(attrs)
    )
    head = tx.select("chrom", b["start"].alias("s"), "tx_id", F.lit(0).alias("n"), line("transcript", b["start"], b["end"], F.concat(ids, extra)).alias("value"))
    ex = tx.select("*", F.posexplode("exons").alias("i", "e"))
    rows = ex.select(
        "chrom", b["start"].alias("s"), "tx_id", (F.col("i") + 1).alias("n"),
        line("exon", F.col("e.start"), F.col("e.end"), F.concat(ids, q("exon_number", F.col("i") + 1), q("cov", six(F.col("coverage"))))).alias("value"),
    )
    return head.unionByName(rows)


def write_gtf(tx: DataFrame, path: str, source: str = "assembly") -> None:
    """GTF in genome order, as a folder of part files in order."""
    x = gtf_lines(tx, source).repartitionByRange("chrom", "s", "tx_id").sortWithinPartitions("chrom", "s", "tx_id", "n")
    x.select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """A tab-separated table with header."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def gene_table(genes: DataFrame) -> DataFrame:
    """Gene abundance rows: 1-based start, mean coverage besides the sums."""
    return genes.select(
        "gene_id", "chrom", _mark(F.col("strand")).alias("strand"), (F.col("start") + 1).alias("start"), "end", "n_tx",
        "coverage", (F.col("coverage") / F.col("n_tx")).alias("mean_coverage"), "fpkm", "tpm",
    )


def exon_rows(tx: DataFrame) -> DataFrame:
    """Distinct exons with an id in genome order by hash: chrom, strand, start (1-based), end, n_tx."""
    x = tx.select("chrom", "strand", "tx_id", F.explode("exons").alias("e"))
    return x.groupBy("chrom", "strand", (F.col("e.start") + 1).alias("start"), F.col("e.end").alias("end")).agg(
        F.countDistinct("tx_id").alias("n_tx"), F.array_sort(F.collect_set("tx_id")).alias("tx_ids")
    )


def intron_rows(tx: DataFrame) -> DataFrame:
    """Distinct introns: chrom, strand, start (1-based first base), end, n_tx. The junction
    table of final transcripts is the same with donor + 1 and acceptor."""
    x = tx.select("chrom", "strand", "tx_id", F.explode(chains.junctions(F.col("exons"))).alias("j"))
    return x.groupBy("chrom", "strand", (F.col("j.donor") + 1).alias("start"), F.col("j.acceptor").alias("end")).agg(
        F.countDistinct("tx_id").alias("n_tx")
    )


def write_ctab(tx: DataFrame, path: str) -> None:
    """Transcript, exon and intron tables in three folders."""
    b = chains.bounds(F.col("exons"))
    t = tx.select("tx_id", "gene_id", "chrom", _mark(F.col("strand")).alias("strand"), (b["start"] + 1).alias("start"), b["end"].alias("end"), F.size("exons").alias("num_exons"), chains.exonic_length(F.col("exons")).alias("length"), "coverage", "fpkm")
    write_table(t, f"{path}/t_data")
    write_table(exon_rows(tx).drop("tx_ids"), f"{path}/e_data")
    write_table(intron_rows(tx), f"{path}/i_data")


def segment_signature(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Partition geometry: segments ``s-e`` (1-based) joined by ``+`` in order per key."""
    one = F.concat((F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"))
    x = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", one.alias("t")))).alias("l"))
    return x.select(*keys, F.array_join(F.col("l.t"), "+").alias("signature"))


def write_events(df: DataFrame, path: str, **only) -> None:
    """Decision log as JSON lines, filtered by equal values of ``only``."""
    for k, v in only.items():
        df = df.where(F.col(k) == v)
    df.write.mode("overwrite").json(path)


def structure_hash(columns: list[Column]) -> Column:
    """Hash of a structure for change detection."""
    return F.xxhash64(*columns)

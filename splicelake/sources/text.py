"""Readers of line formats: SAM, GTF, FASTA, tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.functions import sequences as S

SAM_FIELDS = "read_name flag chrom pos mapq cigar mate_chrom mate_pos tlen seq qual".split()


def _tag(rest: Column, name: str) -> Column:
    v = F.regexp_extract(rest, rf"(?:^|\t){name}:[A-Za-z]:([^\t]*)", 1)
    return F.when(v != "", v)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text: one row per mapped record with exons and typed tags.

    Unmapped records keep null exons. Positions become 0-based half-open."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    p = F.split("value", "\t", 12)
    x = lines.select(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(SAM_FIELDS)], F.coalesce(F.get(p, F.lit(11)), F.lit("")).alias("tags"))
    flag = F.col("flag").try_cast("int")
    mapped = (flag.bitwiseAND(4) == 0) & (F.col("cigar") != "*")
    reverse = flag.bitwiseAND(16) != 0
    clip = S.clips(F.col("cigar"))
    x = x.select(
        "read_name",
        flag.alias("flag"),
        F.when(F.col("chrom") != "*", F.col("chrom")).alias("chrom"),
        (F.col("pos").try_cast("long") - 1).alias("start"),
        F.col("mapq").try_cast("int").alias("mapq"),
        "cigar",
        "seq",
        mapped.alias("is_mapped"),
        (flag.bitwiseAND(0x900) == 0).alias("is_primary"),
        reverse.alias("reverse"),
        F.when(mapped, S.exons_of_cigar(F.col("pos").try_cast("long") - 1, F.col("cigar"))).alias("exons"),
        F.coalesce(_tag(F.col("tags"), "NH").try_cast("int"), F.lit(1)).alias("nh"),
        F.coalesce(_tag(F.col("tags"), "HI").try_cast("int"), F.lit(0)).alias("hi"),
        _tag(F.col("tags"), "NM").try_cast("long").alias("nm_tag"),
        _tag(F.col("tags"), "nM").try_cast("long").alias("n_m_tag"),
        F.coalesce(_tag(F.col("tags"), "YC").try_cast("double"), F.lit(1.0)).alias("yc"),
        F.coalesce(_tag(F.col("tags"), "YK").try_cast("double"), F.lit(0.0)).alias("yk"),
        _tag(F.col("tags"), "ts").alias("ts"),
        _tag(F.col("tags"), "HP").try_cast("int").alias("hp"),
        _tag(F.col("tags"), "AS").try_cast("long").alias("score"),
        ((clip["left"] > 0).try_cast("int") + (clip["right"] > 0).try_cast("int")).alias("clipped_ends"),
    )
    return x.withColumn("end", F.try_element_at("exons", F.lit(-1))["end"]).withColumn(
        "strand", S.read_strand(F.col("ts"), F.col("reverse"))
    ).withColumn("weight", S.read_weight(F.col("yk"), F.col("yc"), F.col("nh"))).withColumn(
        "edits", S.edit_distance(F.col("nm_tag"), F.col("n_m_tag"), F.col("flag").bitwiseAND(1) != 0, F.col("clipped_ends"))
    )


def usable(alignments: DataFrame, min_span: int = 10, primary: bool = False, chrom: str | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Mapped rows of sufficient span; optionally primary ones, one chromosome, without some."""
    x = alignments.where(F.col("is_mapped") & (F.col("end") - F.col("start") >= min_span))
    if primary:
        x = x.where("is_primary")
    if chrom is not None:
        x = x.where(F.col("chrom") == chrom)
    return x.where(~F.col("chrom").isin(*skip)) if skip else x


def score_margin(alignments: DataFrame, margin: float, ratio: bool = False) -> DataFrame:
    """Secondary rows kept only near the score of their read's primary: within ``margin``, or
    with ``ratio`` at least that share of it. Primary, supplementary and unmapped rows stay."""
    best = alignments.where("is_primary").groupBy("read_name").agg(F.max("score").alias("__best"))
    x = alignments.join(best, "read_name", "left")
    near = F.col("score") >= F.col("__best") * F.lit(margin) if ratio else F.col("__best") - F.col("score") <= margin
    secondary = F.col("flag").bitwiseAND(0x100) != 0
    return x.where(~secondary | ~F.col("is_mapped") | F.coalesce(near, F.lit(False))).drop("__best")


def primary_sequences(alignments: DataFrame, needed: DataFrame) -> DataFrame:
    """Sequence of the primary record of each needed read (column read_name), once per name."""
    p = alignments.where("is_primary").join(needed.select("read_name").distinct(), "read_name", "left_semi")
    return p.groupBy("read_name").agg(F.min("seq").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): contigs upper-cased; the name ends at the first blank."""
    x = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    return x.select(F.split(F.trim(head), r"\s+")[0].alias("name"), F.upper(body).alias("seq"))


def tile(contigs: DataFrame, size: int = 5000, stride: int | None = None, overlap: int = 0) -> DataFrame:
    """Contigs cut into tiles (name, start, seq), each ``overlap`` bases longer than its stride allows."""
    step = stride or size
    last = F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / step)
    return contigs.select("name", "seq", F.explode(F.sequence(F.lit(0).try_cast("long"), last)).alias("i")).select(
        "name", (F.col("i") * step).alias("start"), F.substring("seq", (F.col("i") * step + 1).try_cast("int"), F.lit(size + overlap)).alias("seq")
    )


def fetch(contigs: DataFrame, ranges: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Half-open sub-sequences of ``ranges`` (chrom, start, end, ...), clamped to the contig.

    Contigs are cut into tiles first, so a range meets the tiles it touches and never a
    whole contig; equal ranges are read once. Ranges of unknown contigs are left out."""
    s = F.greatest("start", F.lit(0)).cast("long")
    e = F.greatest("end", s).cast("long")
    d = ranges.select("chrom", "start", "end").distinct().select("*", s.alias("__s"), e.alias("__e"))
    t = tile(contigs, size).select(F.col("name").alias("chrom"), F.floor(F.col("start") / size).alias("__t"), F.col("seq").alias("__seq"))
    touched = F.explode(F.sequence(F.floor(F.col("__s") / size), F.floor(F.greatest(F.col("__e") - 1, F.col("__s")) / size)))
    x = d.select("*", touched.alias("__t")).join(t, ["chrom", "__t"])
    g = x.groupBy("chrom", "start", "end", "__s", "__e").agg(F.array_sort(F.collect_list(F.struct("__t", "__seq"))).alias("__l"))
    at = F.col("__s") - F.get("__l", F.lit(0))["__t"] * size
    g = g.select("chrom", "start", "end", F.substring(F.array_join(F.col("__l.__seq"), ""), (at + 1).cast("int"), (F.col("__e") - F.col("__s")).cast("int")).alias("seq"))
    known = ranges.join(contigs.select(F.col("name").alias("chrom")).distinct(), "chrom", "left_semi")
    return known.join(g, ["chrom", "start", "end"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))


GTF = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def attribute(name: str, column: str = "attributes") -> Column:
    """A quoted GTF attribute, or null."""
    v = F.regexp_extract(column, rf'(?:^|[;\s]){name}\s+"([^"]*)"', 1)
    return F.when(v != "", v)


def read_gtf(spark: SparkSession, *paths: str) -> DataFrame:
    """Transcripts of GTF files: transcript_id, gene_id, chrom, strand, source, exons (half-open, sorted), file."""
    x = spark.read.schema(GTF).csv(list(paths), sep="\t", comment="#", quote="").withColumn("file", F.input_file_name())
    e = x.where("feature = 'exon'").select(
        attribute("transcript_id").alias("transcript_id"), attribute("gene_id").alias("gene_id"), "chrom", "strand", "source", "file",
        F.struct((F.col("start") - 1).alias("start"), F.col("end").alias("end")).alias("e"),
    )
    return e.groupBy("file", "transcript_id", "chrom", "strand").agg(
        F.min("gene_id").alias("gene_id"), F.min("source").alias("source"), F.array_sort(F.collect_list("e")).alias("exons")
    )


def reference_junctions(transcripts: DataFrame) -> DataFrame:
    """Distinct junctions with the transcripts and genes that hold them."""
    from splicelake.functions.chains import junctions

    x = transcripts.select("chrom", "strand", "transcript_id", "gene_id", F.explode(junctions(F.col("exons"))).alias("j"))
    return x.groupBy("chrom", "strand", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor")).agg(
        F.array_sort(F.collect_set("transcript_id")).alias("transcripts"), F.array_sort(F.collect_set("gene_id")).alias("genes")
    )


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """Comparison tracking rows: query_id, xloc, ref_gene, ref_id, class_code."""
    p = F.split("value", "\t")
    at = lambda k: F.get(p, F.lit(k))
    return spark.read.text(path).where(F.size(p) >= 4).select(
        at(0).alias("query_id"), at(1).alias("xloc"),
        F.when(at(2) != "-", F.get(F.split(at(2), r"\|"), F.lit(0))).alias("ref_gene"),
        F.when(at(2) != "-", F.get(F.split(at(2), r"\|"), F.lit(1))).alias("ref_id"), at(3).alias("class_code"),
    )


def read_bundle_log(spark: SparkSession, path: str) -> DataFrame:
    """Regions of lines ``>bundle CHROM:START-END``."""
    pat = r"^>bundle\s+(\S+):([0-9]+)-([0-9]+)"
    x = spark.read.text(path).where(F.col("value").rlike(pat))
    g = lambda k: F.regexp_extract("value", pat, k)
    return x.select(g(1).alias("chrom"), g(2).try_cast("long").alias("start"), g(3).try_cast("long").alias("end"))


def parse_chain(text: str) -> list[tuple[int, int]]:
    """Intron chain ``d-a,d-a``; raises on anything else or on a reversed intron."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        d, dash, a = part.partition("-")
        if not dash or not d.strip().isdigit() or not a.strip().isdigit() or int(a) <= int(d):
            raise ValueError(f"bad intron {part!r}")
        out.append((int(d), int(a)))
    if not out:
        raise ValueError("empty chain")
    return out


def path_list(path: str) -> list[str]:
    """Paths of a list file: one a line, # comments, sorted, without repeats."""
    with open(path) as f:
        lines = (x.split("#", 1)[0].strip() for x in f)
        return sorted({x for x in lines if x})

"""Queries over formats, read filters and read-level expressions. Each stands beside its SQL.

Files are written to the shared folder and read again, so a format is tested both ways.
Sequences are letters drawn from hashes of names, as the tables hold none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.functions import chains, coords
from splicelake.functions import sequences as S
from splicelake.operators import coverage as CV
from splicelake.operators import families as FA
from splicelake.operators import junctions as J
from splicelake.operators import profiles as P
from splicelake.operators import reads as RD
from splicelake.plans import lifts
from splicelake.plans import loci_sql as Q
from splicelake.plans.registry import Registry, exon_text
from splicelake.session import shared_folder
from splicelake.sources import bam, sinks, text
from splicelake.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
W = Q.w
EXT = "array_to_string(list_transform({}, lambda x: x.s || '-' || x.e), ',')"


# formats ---------------------------------------------------------------------------------


def _letters(c: Column) -> Column:
    """64 bases drawn from a text."""
    two = F.concat(F.md5(F.concat(c, F.lit("1"))), F.md5(F.concat(c, F.lit("2"))))
    return F.translate(two, "0123456789abcdef", "ACGTACGTACGTACGT")


def _letters_sql(c: str) -> str:
    return f"translate(md5({c} || '1') || md5({c} || '2'), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Alignments as records: read_name, flag, chrom, start, mapq, cigar, seq, tags (a map). Flags, clips and tags
    follow row_id."""
    i = F.col("row_id")
    rest = lambda n: F.pmod(i, F.lit(n))
    flag = rest(2) * 16 + F.when(rest(5) == 0, 256).otherwise(0) + F.when(rest(17) == 0, 4).otherwise(0)
    cigar = F.concat(F.when(rest(3) == 0, "5S").otherwise(""), S.cigar_of_exons(F.col("exons")), F.when(rest(4) == 0, "7S").otherwise(""))
    tags = {
        "NH": rest(3) + 1, "HI": rest(3), "NM": F.when(rest(2) == 0, rest(4)), "nM": F.when(rest(2) != 0, rest(6)),
        "ts": F.when(F.col("strand") > 0, "+").when(F.col("strand") < 0, "-"), "YC": F.when(rest(7) == 0, F.lit("2.0")),
        "AS": F.col("end") - F.col("start") - rest(50), "XI": i,
    }
    pairs = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v.cast("string"))])
    name = F.coalesce("read_name", F.lit("*"))
    return lifts.reads(spark, d).select(
        name.alias("read_name"), flag.cast("int").alias("flag"), "chrom", "start", F.lit(60).alias("mapq"), cigar.alias("cigar"),
        _letters(name).alias("seq"), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("tags"),
    )


# tags of SAM text are typed
TYPES = {"ts": "A", "YC": "f"}


def _sam(spark: SparkSession, d: str) -> DataFrame:
    """The records written as SAM text and read again."""
    tag = F.transform(F.map_entries("tags"), lambda e: F.concat_ws(":", e["key"], F.coalesce(*[F.when(e["key"] == k, v) for k, v in TYPES.items()], F.lit("i")), e["value"]))
    line = F.concat_ws("\t", "read_name", F.col("flag").cast("string"), "chrom", (F.col("start") + 1).cast("string"), F.lit("60"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"), F.array_join(tag, "\t"))
    at = shared_folder(spark, "sam")
    head = spark.createDataFrame([("@HD\tVN:1.6",)], "value string")
    head.unionByName(_records(spark, d).select(line.alias("value"))).write.text(at)
    return text.read_sam(spark, at)


SAM = (
    Q.READS
    + """,
sam AS (SELECT row_id, coalesce(read_name, '*') AS read_name, (row_id % 2) * 16 + CASE WHEN row_id % 5 = 0 THEN 256 ELSE 0 END + CASE WHEN row_id % 17 = 0 THEN 4 ELSE 0 END AS flag,
  chrom, s AS start, CASE WHEN row_id % 17 <> 0 THEN e END AS "end", row_id % 17 <> 0 AS is_mapped, row_id % 5 <> 0 AS is_primary,
  CASE WHEN row_id % 2 = 1 THEN -strand ELSE strand END AS strand, row_id % 3 + 1 AS nh, row_id % 3 AS hi,
  CASE WHEN row_id % 7 = 0 THEN 2.0 ELSE 1.0 END / (row_id % 3 + 1) AS weight, e - s - row_id % 50 AS score,
  CASE WHEN row_id % 2 = 0 THEN row_id % 4 ELSE row_id % 6 END + (row_id % 3 = 0)::INT + (row_id % 4 = 0)::INT AS edits,
  CASE WHEN row_id % 17 <> 0 THEN ex END AS ex FROM reads)"""
)


SCAN = W(SAM, f'SELECT read_name, flag, chrom, start, "end", is_mapped, is_primary, strand, nh, hi, round(weight, 6) AS weight, score, edits, {EXT.format("ex")} AS exons FROM sam')


def _scanned(x: DataFrame) -> DataFrame:
    return x.select("read_name", "flag", "chrom", "start", "end", "is_mapped", "is_primary", "strand", "nh", "hi", F.round("weight", 6).alias("weight"), "score", "edits", exon_text())


@R.query(SCAN)
def sam_scan(spark: SparkSession, d: str) -> DataFrame:
    """Record to read row, tags, strand, weight, edit distance, exons of a CIGAR string."""
    return _scanned(_sam(spark, d))


@R.query(SCAN)
def bam_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same through BAM files, written in parallel and read by byte ranges smaller than a file."""
    at = shared_folder(spark, "bam")
    bam.write_bam_folder(_records(spark, d), at)
    return _scanned(bam.alignments(bam.read_bam(spark, at, split_bytes=200_000)))


@R.query(W(SAM, """SELECT read_name, flag, chrom, start, "end" FROM sam WHERE is_mapped AND "end" - start >= 300 AND is_primary AND chrom NOT IN ('chr_q1', 'chr_q19')"""))
def usable_alignments(spark: SparkSession, d: str) -> DataFrame:
    x = text.usable(_sam(spark, d), min_span=300, primary=True, skip=("chr_q1", "chr_q19"))
    return x.select("read_name", "flag", "chrom", "start", "end")


@R.query(
    W(
        SAM + ", best AS (SELECT read_name, max(score) AS b FROM sam WHERE is_primary GROUP BY 1)",
        "SELECT read_name, flag, chrom, start, score FROM sam LEFT JOIN best USING (read_name) WHERE flag & 256 = 0 OR NOT is_mapped OR coalesce(b - score <= 500, false)",
    )
)
def score_margin(spark: SparkSession, d: str) -> DataFrame:
    return text.score_margin(_sam(spark, d), 500).select("read_name", "flag", "chrom", "start", "score")


@R.query(W(SAM, f"SELECT read_name, {_letters_sql('read_name')} AS seq FROM (SELECT DISTINCT read_name FROM sam WHERE is_primary AND read_name IN (SELECT read_name FROM sam WHERE flag & 256 <> 0))"))
def primary_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of the primary records of reads that also have secondary ones."""
    x = _sam(spark, d)
    return text.primary_sequences(x, x.where("NOT is_primary"))


CONTIGS = "ctg AS (SELECT 'd' || doc_id AS name, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents WHERE text IS NOT NULL), contigs AS (SELECT * FROM ctg WHERE length(seq) >= 30)"


def _contigs(spark: SparkSession, d: str) -> DataFrame:
    """Contigs of the letters A, C, G, T of documents, written as FASTA in lines of 60 and read again."""
    x = table(spark, d, "documents").where("text IS NOT NULL")
    x = x.select(F.concat(F.lit("d"), "doc_id").alias("name"), F.regexp_replace("text", "[^ACGTacgt]", "").alias("seq")).where(F.length("seq") >= 30)
    at = shared_folder(spark, "fasta")
    x.select(F.concat(F.lit(">"), "name", F.lit(" of a text\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value")).write.text(at)
    return text.read_fasta(spark, at)


@R.query(W(CONTIGS, "SELECT name, k * 40 AS start, substr(seq, k * 40 + 1, 50) AS seq FROM contigs, LATERAL (SELECT unnest(range(0, (length(seq) - 1) // 40 + 1)) AS k) u"))
def fasta_tiles(spark: SparkSession, d: str) -> DataFrame:
    return text.tile(_contigs(spark, d), 50, stride=40)


@R.query(W(CONTIGS, 'SELECT name AS chrom, start, "end", substr(seq, greatest(start, 0) + 1, greatest("end" - greatest(start, 0), 0)) AS seq FROM (SELECT name, seq, unnest([-5, length(seq) // 4, length(seq) - 10]) AS start, unnest([20, length(seq) // 2, length(seq) + 10]) AS "end" FROM contigs)'))
def fasta_fetch(spark: SparkSession, d: str) -> DataFrame:
    c = _contigs(spark, d)
    n = F.length("seq")
    at = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("start") if isinstance(a, int) else a.cast("long").alias("start"), F.lit(b).cast("long").alias("end") if isinstance(b, int) else b.cast("long").alias("end")) for a, b in ((-5, 20), (F.floor(n / 4), F.floor(n / 2)), (n - 10, n + 10))]))
    return text.fetch(c, c.select(F.col("name").alias("chrom"), at.alias("r")).select("chrom", "r.*"), size=64)


def _gtf(spark: SparkSession, d: str) -> DataFrame:
    """All transcripts written as GTF and read again; a gene is a chromosome's strand."""
    t = lifts.transcripts(lifts.reads(spark, d)).withColumn("gene_id", F.concat_ws("/", "chrom", "strand")).withColumn("tpm", F.col("coverage") / 2)
    at = shared_folder(spark, "gtf")
    sinks.write_gtf(t, at)
    return text.read_gtf(spark, at)


MARK = "CASE WHEN strand > 0 THEN '+' WHEN strand < 0 THEN '-' ELSE '.' END"
GTF = Q.ALL + f", gtf AS (SELECT tx_id::VARCHAR AS transcript_id, chrom || '/' || strand AS gene_id, chrom, {MARK} AS strand, ex FROM tx)"


@R.query(W(GTF, f"SELECT transcript_id, gene_id, chrom, strand, 'assembly' AS source, {EXT.format('ex')} AS exons FROM gtf"))
def gtf_scan(spark: SparkSession, d: str) -> DataFrame:
    return _gtf(spark, d).select("transcript_id", "gene_id", "chrom", "strand", "source", exon_text())


@R.query(
    W(
        GTF + ", j AS (SELECT transcript_id, gene_id, chrom, strand, ex[i].e AS donor, ex[i + 1].s AS acceptor FROM (SELECT *, unnest(range(1, len(ex))) AS i FROM gtf))",
        "SELECT chrom, strand, donor, acceptor, count(DISTINCT transcript_id) AS n_tx, min(transcript_id) AS first_tx, count(DISTINCT gene_id) AS n_genes FROM j GROUP BY ALL",
    )
)
def reference_junctions(spark: SparkSession, d: str) -> DataFrame:
    x = text.reference_junctions(_gtf(spark, d))
    return x.select("chrom", "strand", "donor", "acceptor", F.size("transcripts").alias("n_tx"), F.get("transcripts", F.lit(0)).alias("first_tx"), F.size("genes").alias("n_genes"))


@R.query(
    """SELECT row_id::VARCHAR AS query_id, run_id AS xloc, CASE WHEN row_id % 3 > 0 THEN chrom END AS ref_gene,
  CASE WHEN row_id % 3 > 0 THEN locus_id END AS ref_id, substr('=jcmxiypnsu', (row_id % 11)::INT + 1, 1) AS class_code FROM ggo19_needy_top15 WHERE locus_id IS NOT NULL AND chrom IS NOT NULL AND run_id IS NOT NULL"""
)
def tracking_scan(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "ggo19_needy_top15").where("locus_id IS NOT NULL AND chrom IS NOT NULL AND run_id IS NOT NULL")
    code = F.substring(F.lit("=jcmxiypnsu"), (F.pmod("row_id", F.lit(11)) + 1).cast("int"), F.lit(1))
    ref = F.when(F.pmod("row_id", F.lit(3)) > 0, F.concat_ws("|", "chrom", "locus_id")).otherwise("-")
    at = shared_folder(spark, "tracking")
    x.select(F.concat_ws("\t", F.col("row_id").cast("string"), "run_id", ref, code).alias("value")).write.text(at)
    return text.read_tracking(spark, at)


@R.query('SELECT DISTINCT chrom, bdstart AS start, bdend AS "end" FROM nodes WHERE chrom IS NOT NULL AND bdstart IS NOT NULL AND bdend IS NOT NULL')
def bundle_log_scan(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nodes").where("chrom IS NOT NULL AND bdstart IS NOT NULL AND bdend IS NOT NULL").select("chrom", "bdstart", "bdend").distinct()
    lines = F.explode(F.array(F.format_string(">bundle %s:%d-%d now", "chrom", "bdstart", "bdend"), F.lit("other line")))
    at = shared_folder(spark, "bundles")
    x.select(lines.alias("value")).write.text(at)
    return text.read_bundle_log(spark, at)


@R.query(W(Q.ALL, 'SELECT chrom, strand, x.s + 1 AS start, x.e AS "end", count(DISTINCT tx_id) AS n_tx FROM (SELECT chrom, strand, tx_id, unnest(ex) AS x FROM tx) GROUP BY ALL'))
def exon_table(spark: SparkSession, d: str) -> DataFrame:
    return sinks.exon_rows(lifts.transcripts(lifts.reads(spark, d))).drop("tx_ids")


@R.query(W(Q.ALL, f'SELECT gene_id, chrom, strand, s + 1 AS start, e AS "end", n AS num_exons, list_sum(list_transform(ex, lambda x: x.e - x.s))::BIGINT AS length, cov AS coverage FROM (SELECT *, chrom AS gene_id FROM (SELECT * REPLACE ({MARK} AS strand) FROM tx))'))
def transcript_table(spark: SparkSession, d: str) -> DataFrame:
    """The transcript table of the three written for abundance tools, read again."""
    t = lifts.transcripts(lifts.reads(spark, d)).withColumn("gene_id", F.col("chrom")).withColumn("fpkm", F.lit(0.0))
    at = shared_folder(spark, "ctab")
    sinks.write_ctab(t, at)
    schema = "tx_id long, gene_id string, chrom string, strand string, start long, end long, num_exons int, length long, coverage double, fpkm double"
    return spark.read.csv(f"{at}/t_data", sep="\t", header=True, schema=schema).drop("tx_id", "fpkm")


@R.query(W(Q.ALL, f'SELECT chrom AS gene_id, chrom, {MARK} AS strand, min(s) + 1 AS start, max(e) AS "end", count(*) AS n_tx, sum(cov) AS coverage, round(sum(cov) / count(*), 6) AS mean_coverage, sum(cov) * 2 AS tpm FROM tx GROUP BY chrom, strand'))
def gene_table(spark: SparkSession, d: str) -> DataFrame:
    from splicelake.operators.transcripts import gene_abundance

    t = lifts.transcripts(lifts.reads(spark, d)).withColumn("gene_id", F.col("chrom")).withColumn("fpkm", F.lit(0.0)).withColumn("tpm", F.col("coverage") * 2)
    return sinks.gene_table(gene_abundance(t)).withColumn("mean_coverage", F.round("mean_coverage", 6)).drop("fpkm")


@R.query("SELECT run_id, stage_id, chrom, n_reads, count(*) AS n FROM ggo19_needy_next5_run_strg_29 WHERE strand = '+' GROUP BY ALL")
def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Decisions written as JSON lines, filtered by strand, and read again."""
    at = shared_folder(spark, "events")
    sinks.write_events(table(spark, d, "ggo19_needy_next5_run_strg_29").select("run_id", "stage_id", "chrom", "strand", "n_reads"), at, strand="+")
    x = spark.read.schema("run_id string, stage_id string, chrom string, n_reads long").json(at)
    return x.groupBy("run_id", "stage_id", "chrom", "n_reads").agg(F.count(F.lit(1)).alias("n"))


# sequence expressions ------------------------------------------------------------------------

NAMES = f"nm AS (SELECT DISTINCT read_name AS read, {_letters_sql('read_name')} AS seq FROM aligned_reads WHERE read_name IS NOT NULL)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "aligned_reads").where("read_name IS NOT NULL").select(F.col("read_name").alias("read")).distinct().withColumn("seq", _letters(F.col("read")))


@R.query(
    W(
        NAMES,
        """SELECT read, reverse(translate(seq, 'ACGT', 'TGCA')) AS other, regexp_matches(seq, 'AA$') OR length(replace(right(seq, 10), 'A', '')) <= 6 AS a_end,
  regexp_matches(seq, '^TT') OR length(replace(left(seq, 10), 'T', '')) <= 6 AS t_start, round((64 - length(replace(replace(seq, 'G', ''), 'C', ''))) / 64, 6) AS gc,
  length(replace(right(seq, 8), 'A', '')) <= 4 AS last_is_a, length(replace(left(seq, 8), 'T', '')) <= 4 AS first_is_t,
  len(list_filter(range(1, 33), lambda i: substr(seq, i, 1) <> substr(seq, i + 32, 1))) AS distance, len(list_distinct(list_transform(range(1, 60), lambda i: substr(seq, i, 6)))) AS n_kmers FROM nm""",
    )
)
def sequence_measures(spark: SparkSession, d: str) -> DataFrame:
    """Reverse complement, tails, tail exons, letter shares, distance of the halves, k-mers."""
    s = F.col("seq")
    tail = S.tail_flags(s, window=10, run=2, share=0.4)
    ends = S.terminal_tail_exon(F.substring(s, -8, 8), F.substring(s, 1, 8), 0.5)
    return _named(spark, d).select(
        "read", S.reverse_complement(s).alias("other"), tail["a_end"].alias("a_end"), tail["t_start"].alias("t_start"),
        F.round(S.share_of(s, "GC"), 6).alias("gc"), ends["last_is_a"].alias("last_is_a"), ends["first_is_t"].alias("first_is_t"),
        S.hamming(F.substring(s, 1, 32), F.substring(s, 33, 32)).alias("distance"), F.size(F.array_distinct(S.kmers(s, 6))).alias("n_kmers"),
    )


@R.query(
    W(
        NAMES + ", c AS (SELECT read, seq, b, 64 - length(replace(seq, b, '')) AS k FROM nm, (VALUES ('A'), ('C'), ('G'), ('T')) v(b)), h AS (SELECT read, min(seq) AS seq, sum(CASE WHEN k > 0 THEN -(k / 64) * log2(k / 64) ELSE 0 END) AS h FROM c GROUP BY read)",
        "SELECT read, round(h, 6) AS entropy FROM h",
    )
)
def sequence_entropy(spark: SparkSession, d: str) -> DataFrame:
    counts = F.array(*[(F.lit(64) - F.length(F.replace("seq", F.lit(b)))).cast("double") for b in "ACGT"])
    return _named(spark, d).select("read", F.round(S.entropy(counts), 6).alias("entropy"))


KMERS = f"""fam AS (SELECT DISTINCT chrom AS family, substr(x.s, u.i, 15) AS kmer FROM (SELECT DISTINCT chrom, {_letters_sql("read_name")} AS s FROM aligned_reads WHERE read_name IS NOT NULL AND chrom IS NOT NULL AND row_id % 3 = 0) x, LATERAL (SELECT unnest(range(1, 51)) AS i) u),
b AS (SELECT read, 1 AS st, seq AS q FROM nm UNION ALL SELECT read, -1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM nm), k AS (SELECT read, st, substr(q, u.i, 15) AS kmer FROM b, LATERAL (SELECT unnest(range(1, 51)) AS i) u),
h AS (SELECT read, family, max(n) AS hits FROM (SELECT read, st, family, count(*) AS n FROM k JOIN fam USING (kmer) GROUP BY ALL) GROUP BY ALL)"""


@R.query(
    W(
        NAMES + "," + KMERS,
        "SELECT read, family, hits FROM h WHERE hits >= 3 QUALIFY row_number() OVER (PARTITION BY read ORDER BY hits DESC, family) = 1",
    )
)
def novel_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads matched to chromosomes' k-mers of both strands (of every third row's sequence)."""
    x = table(spark, d, "aligned_reads").where("read_name IS NOT NULL AND chrom IS NOT NULL AND row_id % 3 = 0")
    k = x.select(F.col("chrom").alias("family"), _letters(F.col("read_name")).alias("seq")).distinct().select("family", F.explode(S.kmers(F.col("seq"), 15)).alias("kmer"))
    return FA.novel_reads(_named(spark, d), k).select("read", "family", "hits")


@R.query()
def profile_scores(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood of the letters of every bundle under the profiles of three of them (the first of each strand)."""
    x = table(spark, d, "nodes").where("chrom IS NOT NULL AND bdstart IS NOT NULL AND strand IS NOT NULL")
    x = x.select("strand", F.concat_ws(":", "chrom", "bdstart", "strand").alias("read")).distinct().withColumn("seq", _letters(F.col("read")))
    first = x.groupBy("strand").agg(F.min(F.struct("read", "seq")).alias("m"))
    models = {r["strand"]: P.from_sequence(r["m"]["seq"]) for r in first.collect()}
    return P.score_reads(x, models).withColumn("loglik", F.round("loglik", 3))


@R.query()
def family_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Four copies of each bundle's letters, which differ in a tail, aligned."""
    n = table(spark, d, "nodes").where("chrom IS NOT NULL AND bdstart IS NOT NULL").select(F.concat_ws(":", "chrom", "bdstart").alias("family"), (F.col("node_idx") % 4).alias("copy")).distinct()
    seq = F.concat(F.substring(_letters(F.col("family")), 1, 40), F.substring(_letters(F.concat_ws("/", "family", "copy")), 1, 6))
    return P.family_profiles(n.withColumn("seq", seq)).withColumn("identity", F.round("identity", 6))


# read filters ----------------------------------------------------------------------------------

GOOD = Q.STATS + ", good AS (SELECT DISTINCT chrom, donor, acceptor FROM stats WHERE mrcount >= 3)"


def _good(r: DataFrame) -> DataFrame:
    return J.junction_stats(r).where("mrcount >= 3")


@R.query(W(Q.READS + "," + Q.PANEL, "SELECT row_id FROM reads r WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.chrom = r.chrom AND p.s < r.e AND r.s < p.e)"))
def masked_reads(spark: SparkSession, d: str) -> DataFrame:
    return RD.mask_regions(lifts.reads(spark, d), lifts.panels(spark, d)).select("row_id")


@R.query(
    W(
        Q.READS + ", f AS (SELECT row_id, list_position(list_transform(range(1, len(ex)), lambda i: ex[i + 1].s - ex[i].e > 5000), true) AS k, ex FROM reads)",
        f"SELECT row_id, {EXT.format('CASE WHEN coalesce(k, 0) > 0 THEN ex[1:k] ELSE ex END')} AS exons FROM f",
    )
)
def capped_spans(spark: SparkSession, d: str) -> DataFrame:
    x = lifts.reads(spark, d)
    return x.select("row_id", exon_text(RD.cap_span(F.col("exons"), 5000)))


@R.query(
    W(
        GOOD
        + """, n AS (SELECT row_id, x.i AS i FROM junc x JOIN good USING (chrom, donor, acceptor)), near AS (SELECT DISTINCT row_id, unnest([i, i + 1]) AS i FROM n),
t AS (SELECT row_id, list_sum(list_transform(ex, lambda x: x.e - x.s)) AS total FROM reads)""",
        'SELECT x.row_id, x.i - 1 AS i, x.s AS start, x.e AS "end", NOT (x.e - x.s < 200 AND x.e - x.s < total * 0.5) OR near.i IS NOT NULL AS keep FROM exon x JOIN t USING (row_id) LEFT JOIN near ON x.row_id = near.row_id AND x.i = near.i',
    )
)
def kept_exons(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    return RD.kept_exons(r, _good(r), tiny=200).drop("chrom")


@R.query(W(GOOD + ", held AS (SELECT DISTINCT row_id FROM junc JOIN good USING (chrom, donor, acceptor))", "SELECT row_id, CASE WHEN len(ex) > 1 AND row_id NOT IN (SELECT row_id FROM held) THEN 0 ELSE strand END AS strand FROM reads"))
def neutralised(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    return RD.neutralise(r, _good(r)).select("row_id", "strand")


@R.query(W(Q.STATS + ", k AS (SELECT DISTINCT chrom, donor, acceptor FROM stats WHERE strand = 0)", "SELECT row_id FROM reads WHERE row_id NOT IN (SELECT row_id FROM junc JOIN k USING (chrom, donor, acceptor))"))
def without_killed(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    return RD.without_killed(r, J.killed(J.junction_stats(r)), "row_id").select("row_id")


@R.query(W(Q.STATS, "SELECT chrom, strand, donor, acceptor FROM stats WHERE strand = -1"))
def strand_junctions(spark: SparkSession, d: str) -> DataFrame:
    return RD.strand_kill_filter(J.junction_stats(lifts.reads(spark, d)), -1).select(*J.JKEY)


@R.query(
    W(
        Q.READS + ", f AS (SELECT row_id, ex, len(ex) AS n, row_id % 3 = 0 AS a, row_id % 4 = 0 AS t FROM reads), g AS (SELECT *, n - a::INT - t::INT AS k FROM f)",
        f"SELECT row_id, {EXT.format('CASE WHEN t THEN ex[2:k + 1] ELSE ex[1:k] END')} AS exons FROM g WHERE k > 0",
    )
)
def trimmed_tails(spark: SparkSession, d: str) -> DataFrame:
    """Terminal exons flagged as tails (here by row_id) dropped."""
    x = lifts.reads(spark, d).withColumn("last_is_a", F.col("row_id") % 3 == 0).withColumn("first_is_t", F.col("row_id") % 4 == 0)
    return RD.trim_tail_exons(x).select("row_id", exon_text())


@R.query(W(Q.READS, "SELECT row_id FROM reads WHERE row_id % 5 <> 0 AND NOT (len(ex) <= 2 AND (row_id % 3 = 0 OR row_id % 4 = 0))"))
def tail_artefacts(spark: SparkSession, d: str) -> DataFrame:
    """Secondary rows, then short reads with aligned tails dropped (both flagged by row_id)."""
    x = lifts.reads(spark, d).withColumn("a_tail", F.col("row_id") % 3 == 0).withColumn("t_tail", F.col("row_id") % 4 == 0).withColumn("is_primary", F.col("row_id") % 5 != 0)
    return RD.drop_tail_artefacts(RD.drop_secondary(x)).select("row_id")


@R.query(
    W(
        Q.STATS + ", b AS (SELECT *, ['GT', 'GC', 'CT', 'AA'][donor % 4 + 1] AS x, ['AG', 'AC', 'GC'][acceptor % 3 + 1] AS y FROM stats)",
        """SELECT chrom, strand, donor, acceptor, CASE strand WHEN 1 THEN x IN ('GT', 'GC') AND y = 'AG' WHEN -1 THEN x = 'CT' AND y IN ('AC', 'GC')
        ELSE (x IN ('GT', 'GC') AND y = 'AG') OR (x = 'CT' AND y IN ('AC', 'GC')) END AS consensus FROM b""",
    )
)
def splice_consensus(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda c, *v: F.get(F.array(*[F.lit(x) for x in v]), F.col(c) % len(v))
    s = J.junction_stats(lifts.reads(spark, d)).withColumn("donor_bases", pick("donor", "GT", "GC", "CT", "AA")).withColumn("acceptor_bases", pick("acceptor", "AG", "AC", "GC"))
    return J.splice_consensus(s).select(*J.JKEY, "consensus")


@R.query(
    W(
        Q.READS + ", f AS (SELECT row_id, e - s AS len, row_id % 4 AS nh, row_id % 3 AS m, (row_id % 10) / 10.0 AS p, row_id % 40 AS nm FROM reads)",
        """SELECT row_id, len >= 300 OR m <> 0 AS valid, m < 2 AND len >= 300 AS joinable, CASE WHEN nm > len * 0.02 OR m = 1 OR nh > 2 THEN 2.0 ELSE 0.0 END AS bad_weight,
        CASE WHEN m + 2 > nh THEN round(1.0 / (m + 2), 6) ELSE 2.0 END AS pair_weight, CASE WHEN len <= 25 THEN 1.0 WHEN len <= 100 THEN 0.5 WHEN len <= 200 THEN 0.25 ELSE 0.1 END AS ratio,
        round(greatest(0, least(1, 1 - 0.5 * p - 0.5 * m / 3)), 6) AS identity, round(greatest(0.1, 1 + 0.5 * p - 0.3 * m), 6) AS factor,
        round(CASE m WHEN 1 THEN nh + CASE WHEN p > 0 THEN nm * nh / (nh + p) ELSE nm END WHEN 2 THEN p + CASE WHEN nh > 0 THEN nm * p / (nh + p) ELSE nm END ELSE nm END, 6) AS owned,
        nm * 0.5 * (nh + 1) > m * (nh + 2) AS falls FROM f""",
    )
)
def read_gates(spark: SparkSession, d: str) -> DataFrame:
    """Read-level rules on values that follow row_id: terminal exons, mates, weights, demotion tiers,
    identity, allele factor, strand's share of coverage, coverage drop."""
    i = F.col("row_id")
    x = lifts.reads(spark, d).select(
        "row_id", (F.col("end") - F.col("start")).alias("len"), (i % 4).alias("nh"), (i % 3).alias("m"), ((i % 10) / 10.0).alias("p"), (i % 40).alias("nm")
    )
    c = F.col
    strand = F.when(c("m") == 1, 1).when(c("m") == 2, -1).otherwise(0)
    return x.select(
        "row_id",
        RD.terminal_valid(c("len"), c("m") == 0, 300).alias("valid"),
        RD.mates_joinable(c("m"), c("m") < 2, c("len") >= 300).alias("joinable"),
        RD.mismatch_weight(F.lit(2.0), c("nm"), c("len"), c("m") == 1, c("nh"), long_reads=False).alias("bad_weight"),
        F.round(RD.pair_weight(F.lit(2.0), c("nh"), c("m") + 2), 6).alias("pair_weight"),
        S.demotion_ratio(c("len")).alias("ratio"),
        F.round(S.identity_proxy(c("p"), c("m") / 3), 6).alias("identity"),
        F.round(S.allele_factor(c("p"), c("m")), 6).alias("factor"),
        F.round(S.strand_coverage(c("nh"), c("p"), c("nm"), strand), 6).alias("owned"),
        CV.coverage_drop(c("nm"), c("nh") + 2, c("m"), c("nh") + 1).alias("falls"),
    )


# chains and intervals ------------------------------------------------------------------------


@R.query(
    W(
        Q.READS,
        f"""SELECT row_id, {EXT.format("list_concat(list_slice(ex, 1, len(ex) - 1), [{'s': ex[len(ex)].s, 'e': ex[len(ex)].e - least(20, ex[len(ex)].e - ex[len(ex)].s - 1)}])")} AS short_end,
        {EXT.format("list_concat([{'s': ex[1].s + least(20, ex[1].e - ex[1].s - 1), 'e': ex[1].e}], list_slice(ex, 2, len(ex)))")} AS short_start,
        array_to_string(list_filter(list_transform(range(1, len(ex)), lambda i: ex[i + 1].s - ex[i].e), lambda x: x > 1), ',') AS introns,
        list_sum(list_transform(ex, lambda x: x.e - x.s))::BIGINT * 2 AS score, len(list_filter(range(1, len(ex)), lambda i: ex[i + 1].s - ex[i].e >= 500)) > 0 AS long_gap,
        array_to_string(list_transform(range(1, len(ex)), lambda i: (ex[i].e - i) || '-' || (ex[i + 1].s + i)), ',') AS moved FROM reads""",
    )
)
def exon_edits(spark: SparkSession, d: str) -> DataFrame:
    """Terminal exons shortened, intron lengths, score, long gaps of the CIGAR, junctions moved by deletions."""
    e = F.col("exons")
    j = chains.junctions(e)
    dels = F.when(F.size(j) > 0, F.sequence(F.lit(1), F.size(j))).otherwise(F.array().cast("array<int>"))
    moved = chains.deletion_aware_junctions(j, dels, dels)
    return lifts.reads(spark, d).select(
        "row_id", exon_text(chains.shorten_terminal(e, 20, True)).alias("short_end"), exon_text(chains.shorten_terminal(e, 20, False)).alias("short_start"),
        F.array_join(chains.intron_lengths(e).cast("array<string>"), ",").alias("introns"), chains.score(e, F.lit(2)).alias("score"),
        S.has_long_indel(S.cigar_of_exons(e), 500).alias("long_gap"), F.array_join(F.transform(moved, lambda x: F.concat_ws("-", x["donor"], x["acceptor"])), ",").alias("moved"),
    )


@R.query(
    W(
        Q.READS
        + ", x AS (SELECT row_id, i, s, e, lag(e) OVER (PARTITION BY row_id ORDER BY i) AS p FROM exon), g AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS k FROM x), m AS (SELECT row_id, k, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)",
        "SELECT row_id, string_agg(s || '-' || e, ',' ORDER BY s) AS exons FROM m GROUP BY row_id",
    )
)
def merged_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Exons joined over introns of at most 300 bases, whatever their order."""
    return lifts.reads(spark, d).select("row_id", exon_text(chains.merge_gaps(F.array_sort(F.reverse("exons")), 300)))


@R.query(
    W(
        f'n AS (SELECT DISTINCT {Q.B}, start AS s, "end" AS e FROM nodes WHERE chrom IS NOT NULL AND start < "end"), u AS (SELECT *, sum(nw) OVER (PARTITION BY {Q.B} ORDER BY s, e) AS k FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY {Q.B} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM n)), i AS (SELECT {Q.B}, k, min(s) AS s, max(e) AS e FROM u GROUP BY ALL)',
        f"SELECT {Q.B}, string_agg(s || '-' || e, ',' ORDER BY s) AS exons FROM i GROUP BY ALL",
    )
)
def node_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of the nodes of a bundle as one array."""
    n = table(spark, d, "nodes").where("chrom IS NOT NULL AND start < end")
    g = n.groupBy(*lifts.BUNDLE).agg(F.collect_set(F.struct("start", "end")).alias("exons"))
    return g.select(*lifts.BUNDLE, exon_text(chains.union_intervals(F.col("exons"))))


@R.query(
    W(
        f'n AS (SELECT row_id, chrom, strand, start AS s, "end" AS e, lead(start) OVER w AS s2, lead("end") OVER w AS e2, lead(strand) OVER w AS t2 FROM nodes WHERE chrom IS NOT NULL AND start < "end" WINDOW w AS (PARTITION BY chrom ORDER BY start, "end", row_id)), f AS (SELECT *, greatest(least(e, e2) - greatest(s, s2), 0) AS o FROM n WHERE s2 IS NOT NULL)',
        """SELECT row_id, o AS shared, s < e2 AND s2 < e AS overlaps, e = s2 AS touches, round(o / least(e - s, e2 - s2), 6) AS of_smaller, round(o / greatest(e - s, e2 - s2), 6) AS reciprocal,
        o / least(e - s, e2 - s2) >= 0.5 AND ((strand = '+' AND t2 = '-') OR (strand = '-' AND t2 = '+')) AS mirror, s + 1 AS first_base, greatest(s - 1, 0) AS back FROM f""",
    )
)
def interval_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring nodes of a chromosome: overlap, touch, shares, mirrors, coordinates."""
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("start", "end", "row_id")
    x = table(spark, d, "nodes").where("chrom IS NOT NULL AND start < end")
    x = x.select("row_id", "chrom", "strand", F.col("start").alias("s"), F.col("end").alias("e"), F.lead("start").over(w).alias("s2"), F.lead("end").over(w).alias("e2"), F.lead("strand").over(w).alias("t2")).where("s2 IS NOT NULL")
    s, e, s2, e2 = (F.col(c) for c in ("s", "e", "s2", "e2"))
    mirror = coords.is_strand_mirror(F.col("chrom"), s, e, F.col("strand"), F.col("chrom"), s2, e2, F.col("t2"), 0.5)
    return x.select(
        "row_id", coords.overlap(s, e, s2, e2).alias("shared"), coords.overlaps(s, e, s2, e2).alias("overlaps"), coords.contiguous(e, s2).alias("touches"),
        F.round(coords.overlap_fraction_of_smaller(s, e, s2, e2), 6).alias("of_smaller"), F.round(coords.reciprocal_overlap(s, e, s2, e2), 6).alias("reciprocal"),
        F.coalesce(mirror, F.lit(False)).alias("mirror"), coords.to_closed(s).alias("first_base"), coords.from_closed(s).alias("back"),
    )


@R.query(
    W(
        Q.TX + ", l AS (SELECT chrom, strand, tx_id, n, list_transform(chain, lambda j: j.a - j.d) AS l FROM tx), p AS (SELECT x.tx_id, y.tx_id AS other, x.l AS a, y.l AS b FROM l x JOIN l y ON x.chrom = y.chrom AND x.strand = y.strand AND x.n < y.n AND x.l[1] // 1000 = y.l[1] // 1000)",
        "SELECT tx_id, other, coalesce(list_min(list_filter(range(0, len(b) - len(a) + 1), lambda o: len(list_filter(range(1, len(a) + 1), lambda k: abs(b[o + k] - a[k]) > 100)) = 0)), -1) AS at FROM p",
    )
)
def chain_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where a chain of intron lengths stands in a longer one of its place within 100 bases; pairs share
    the thousands of their first length."""
    x = lifts.chain_transcripts(lifts.reads(spark, d)).select("chrom", "strand", "tx_id", F.size("exons").alias("n"), F.transform(chains.junctions(F.col("exons")), lambda j: j["acceptor"] - j["donor"]).alias("l"))
    x = x.withColumn("b", F.floor(F.get("l", F.lit(0)) / 1000))
    y = x.select("chrom", "strand", "b", F.col("tx_id").alias("other"), F.col("n").alias("m"), F.col("l").alias("k"))
    p = x.join(y, ["chrom", "strand", "b"]).where("n < m")
    return p.select("tx_id", "other", chains.contiguous_offset(F.col("l"), F.col("k"), 100).cast("long").alias("at"))

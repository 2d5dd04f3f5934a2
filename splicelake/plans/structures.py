"""Queries over junctions, transcripts, families and runs. Each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.functions import chains
from splicelake.operators import coverage as CV
from splicelake.operators import families as FA
from splicelake.operators import junctions as J
from splicelake.operators import profiles as P
from splicelake.operators import ranges as RG
from splicelake.operators import reports as RP
from splicelake.operators import transcripts as T
from splicelake.plans import lifts
from splicelake.plans import loci_sql as Q
from splicelake.plans.registry import Registry, exon_text
from splicelake.session import cut
from splicelake.sources.tables import table
from splicelake.streaming import sessions as SS

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
W = Q.w
SAME = "x.chrom = y.chrom AND x.strand = y.strand"
JK = "chrom, strand, donor, acceptor"
NEXT5 = "ggo19_needy_next5_run_strg_29"
JUNC = "array_to_string(list_transform({}, lambda x: x.d || '-' || x.a), ',')"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return lifts.halves(lifts.reads(spark, d))


# junctions -----------------------------------------------------------------------------------


@R.query(
    """WITH RECURSIVE p AS (SELECT row_id AS src, row_id // 3 AS dst FROM aligned_reads WHERE row_id % 7 <> 0),
f AS (SELECT src, dst FROM p UNION ALL SELECT f.src, p.dst FROM f JOIN p ON f.dst = p.src)
SELECT src, min(dst) AS dst FROM f GROUP BY src"""
)
def resolved_pointers(spark: SparkSession, d: str) -> DataFrame:
    """Pointers from a row to a third of its number (none from multiples of seven), followed to their ends."""
    x = table(spark, d, "aligned_reads").where("row_id % 7 <> 0").select(F.col("row_id").alias("src"), F.floor(F.col("row_id") / 3).alias("dst"))
    return J.resolve_redirects(x)


@R.query(W(Q.STATS, f"SELECT {JK}, mrcount FROM stats WHERE ({JK}) IN (SELECT ({JK}) FROM jx WHERE row_id % 5 <> 0)"))
def primary_supported(spark: SparkSession, d: str) -> DataFrame:
    """Junctions with a primary read (every fifth row counts as secondary)."""
    r = lifts.reads(spark, d).withColumn("is_primary", F.col("row_id") % 5 != 0)
    return J.primary_supported(J.junction_stats(r), r).select(*J.JKEY, "mrcount")


@R.query(
    W(
        Q.STATS + f", a AS (SELECT {JK}, sum(w) AS mrcount FROM jx WHERE ({Q._RUN}) = 0 GROUP BY ALL), b AS (SELECT DISTINCT {JK} FROM jx WHERE ({Q._RUN}) = 1)",
        f"SELECT {JK}, mrcount::BIGINT AS mrcount FROM a UNION ALL SELECT {JK}, 2 FROM b ANTI JOIN a USING ({JK})",
    )
)
def injected_guides(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    return J.inject_guides(J.junction_stats(a), J.junction_stats(b), 2).select(*J.JKEY, "mrcount")


@R.query(
    W(
        Q.STATS + f", a AS (SELECT {JK}, sum(w)::BIGINT AS m FROM jx WHERE ({Q._RUN}) = 0 GROUP BY ALL), b AS (SELECT {JK}, sum(w)::BIGINT AS m FROM jx WHERE ({Q._RUN}) = 1 GROUP BY ALL)",
        f"SELECT {JK}, a.m AS first, b.m AS second FROM stats LEFT JOIN a USING ({JK}) LEFT JOIN b USING ({JK}) WHERE mrcount >= 2",
    )
)
def junction_trace(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    a, b = lifts.halves(r)
    return RP.junction_trace(J.junction_stats(r).where("mrcount >= 2"), [("first", J.junction_stats(a)), ("second", J.junction_stats(b))])


@R.query(
    W(
        Q.TWO
        + f""", rj AS (SELECT row_id, chrom, i, donor, acceptor FROM junc WHERE ({Q._RUN}) = 1),
p AS (SELECT tx_id || '/' || i AS pair_id, chrom, chain[i].d AS d1, chain[i].a AS a1, chain[i + 1].d AS d2, chain[i + 1].a AS a2 FROM (SELECT *, unnest(range(1, len(chain))) AS i FROM ta))""",
        """SELECT pair_id, EXISTS (SELECT 1 FROM rj x JOIN rj y ON x.row_id = y.row_id AND x.i < y.i WHERE x.chrom = p.chrom AND abs(x.donor - p.d1) <= 5 AND abs(x.acceptor - p.a1) <= 5
        AND abs(y.donor - p.d2) <= 5 AND abs(y.acceptor - p.a2) <= 5) AS seen FROM p""",
    )
)
def two_splice_witness(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    j = chains.junctions(F.col("exons"))
    x = lifts.chain_transcripts(a).select("tx_id", "chrom", j.alias("j"))
    i = F.explode(F.when(F.size("j") > 1, F.sequence(F.lit(1), F.size("j") - 1)))
    x = x.select("tx_id", "chrom", "j", i.alias("i"))
    at = lambda k: F.element_at("j", F.col("i") + k)
    p = x.select(F.concat_ws("/", "tx_id", "i").alias("pair_id"), "chrom", at(0)["donor"].alias("d1"), at(0)["acceptor"].alias("a1"), at(1)["donor"].alias("d2"), at(1)["acceptor"].alias("a2"))
    return J.two_splice_witness(p, b).select("pair_id", "seen")


@R.query()
def high_error_demotion(spark: SparkSession, d: str) -> DataFrame:
    """Junctions all of whose reads count as mismatched (every other donor), and where they go."""
    s = J.junction_stats(lifts.reads(spark, d)).withColumn("nm", F.when(F.col("donor") % 2 == 0, F.col("mrcount")).otherwise(0).cast("long"))
    return J.demote_high_error(s, 2000).select(*J.JKEY, "to_donor", "to_acceptor")


@R.query()
def preprocessed_junctions(spark: SparkSession, d: str) -> DataFrame:
    return J.preprocess(J.junction_stats(lifts.reads(spark, d))).select(*J.JKEY, "mrcount", "nreads_good")


# coverage ----------------------------------------------------------------------------------------


@R.query(
    W(
        Q.STATS
        + f", seg AS ({Q._segments('exon', 'chrom')}), v AS (SELECT *, unnest(['di', 'do', 'ao', 'ai']) AS side, unnest([donor - 5, donor, acceptor - 5, acceptor]) AS p FROM stats), "
        + """c AS (SELECT chrom, strand, donor, acceptor, side, coalesce(sum((least(p + 5, g."end") - greatest(p, g.start)) * g.depth), 0)::BIGINT AS c FROM v LEFT JOIN seg g USING (chrom) WHERE g.start IS NULL OR (p < g."end" AND g.start < p + 5) GROUP BY ALL),
s AS (SELECT chrom, strand, donor, acceptor, side, coalesce(max(c), 0) AS c FROM v LEFT JOIN c USING (chrom, strand, donor, acceptor, side) GROUP BY ALL),
f AS (SELECT chrom, strand, donor, acceptor, max(CASE WHEN side = 'di' THEN c END) AS donor_in, max(CASE WHEN side = 'do' THEN c END) AS donor_out, max(CASE WHEN side = 'ai' THEN c END) AS acceptor_in, max(CASE WHEN side = 'ao' THEN c END) AS acceptor_out FROM s GROUP BY ALL)""",
        "SELECT *, donor_out <= donor_in * 0.9 AND acceptor_out <= acceptor_in * 0.9 AS seen FROM f",
    )
)
def junction_windows(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    return CV.witness(J.junction_stats(r), cut(RG.coverage_segments(lifts.exon_rows(r), ["chrom"])))


@R.query(
    W(
        Q.READS
        + f", pt AS (SELECT chrom, strand, s, s AS e, sum(w) AS w FROM reads GROUP BY ALL), c AS (SELECT * FROM ({Q._islands('pt', 'chrom, strand', 5, 'floor(sum(s * w) / sum(w) + 0.5)::BIGINT AS centre, sum(w) AS w')}) WHERE w >= 3), p AS (SELECT DISTINCT chrom, strand, s AS pos FROM reads)",
        "SELECT p.chrom, p.strand, p.pos, coalesce(floor((min(c.centre) + any_value(p.pos)) / 2), any_value(p.pos))::BIGINT AS merged FROM p LEFT JOIN c ON p.chrom = c.chrom AND p.strand = c.strand AND abs(p.pos - c.centre) <= 20 GROUP BY p.chrom, p.strand, p.pos",
    )
)
def merged_points(spark: SparkSession, d: str) -> DataFrame:
    """Distinct read starts drawn to a cluster of starts within 20 bases."""
    x = lifts.reads(spark, d).select("chrom", "strand", F.col("start").alias("pos"), "weight")
    c = cut(RG.cluster_positions(x, ["chrom", "strand"], window=5, least=3))
    return RG.merge_points(c, x.select("chrom", "strand", "pos").distinct(), ["chrom", "strand"], 20)


# transcripts -----------------------------------------------------------------------------------------


@R.query(
    W(
        Q.TWO
        + f""", r AS (SELECT DISTINCT chrom, strand, tx_id AS ref, unnest(chain) AS j FROM tb), x AS (SELECT chrom, strand, tx_id, n, u.i AS i, chain[u.i] AS j FROM ta, LATERAL (SELECT unnest(range(1, n)) AS i) u WHERE n > 2),
h AS (SELECT tx_id, n, ref, i FROM x JOIN r USING (chrom, strand, j)), known AS (SELECT tx_id, n FROM h GROUP BY ALL HAVING count(DISTINCT i) = n - 1), v AS (SELECT tx_id, ref, min(i) AS lo, max(i) AS hi FROM h GROUP BY ALL)""",
        "SELECT tx_id FROM known k WHERE EXISTS (SELECT 1 FROM (SELECT unnest(range(1, k.n - 1)) AS c) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.tx_id = k.tx_id AND lo <= c AND hi > c))",
    )
)
def chimeric_transcripts(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    return T.chimeras(lifts.chain_transcripts(a), lifts.chain_transcripts(b))


@R.query(W(Q.TX + ", o AS (SELECT x.tx_id, x.cov, sum(y.cov) AS others FROM tx x JOIN tx y ON x.chrom = y.chrom AND x.tx_id <> y.tx_id AND x.s < y.e AND y.s < x.e GROUP BY ALL)", "SELECT tx_id FROM o WHERE cov < others"))
def underrepresented(spark: SparkSession, d: str) -> DataFrame:
    return T.underrepresented(lifts.chain_transcripts(lifts.reads(spark, d)), 1.0)


@R.query(
    W(
        Q.TX + f", p AS (SELECT x.tx_id, x.chain AS a, y.chain AS b, x.n FROM tx x JOIN tx y ON {SAME} AND x.n = y.n AND x.tx_id <> y.tx_id AND x.s < y.e AND y.s < x.e WHERE y.cov > x.cov OR (y.cov = x.cov AND y.tx_id < x.tx_id)), q AS (SELECT *, list_filter(range(1, n), lambda i: a[i] <> b[i]) AS k FROM p)",
        "SELECT DISTINCT tx_id FROM q WHERE len(k) BETWEEN 1 AND 2 AND len(list_filter(k, lambda i: a[i].d <> b[i].d AND a[i].a <> b[i].a)) = 0",
    )
)
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return T.near_duplicates(lifts.chain_transcripts(lifts.reads(spark, d)))


@R.query(
    W(
        Q.ALL
        + """, o AS (SELECT * FROM tx WHERE n = 1), p AS (SELECT x.tx_id AS a, y.tx_id AS b, (x.e + y.s) // 2 AS mid FROM o x JOIN o y ON x.chrom = y.chrom AND x.strand * y.strand < 0 AND x.s < y.s AND x.e < y.e AND y.s < x.e AND x.e - y.s <= 500),
m AS (SELECT tx_id, s, e, coalesce((SELECT max(mid) FROM p WHERE b = tx_id), s) AS s2, coalesce((SELECT min(mid) FROM p WHERE a = tx_id), e) AS e2 FROM o)""",
        "SELECT tx_id, CASE WHEN s2 < e2 THEN s2 ELSE s END AS start, CASE WHEN s2 < e2 THEN e2 ELSE e END AS \"end\" FROM m",
    )
)
def split_conflicts(spark: SparkSession, d: str) -> DataFrame:
    x = T.split_strand_conflicts(cut(lifts.transcripts(lifts.reads(spark, d))), 500).where(F.size("exons") == 1)
    e = F.get("exons", F.lit(0))
    return x.select("tx_id", e["start"].alias("start"), e["end"].alias("end"))


@R.query(
    W(
        Q.TX
        + f""", p AS (SELECT x.tx_id AS a, y.tx_id AS b, x.cov AS ca, y.cov AS cb FROM tx x JOIN tx y ON {SAME} AND x.n = y.n AND x.tx_id < y.tx_id AND abs(x.chain[1].d - y.chain[1].d) <= 500 AND abs(x.s - y.s) <= 5000 AND abs(x.e - y.e) <= 5000
 WHERE len(list_filter(range(1, x.n), lambda i: abs(x.chain[i].d - y.chain[i].d) > 500 OR abs(x.chain[i].a - y.chain[i].a) > 500)) = 0 AND (ca <= cb * 0.9 OR cb <= ca * 0.9))""",
        "SELECT tx_id, cov AS coverage FROM tx WHERE tx_id NOT IN (SELECT CASE WHEN cb <= ca * 0.9 THEN b ELSE a END FROM p)",
    )
)
def near_equal_collapse(spark: SparkSession, d: str) -> DataFrame:
    return T.near_equal_collapse(cut(lifts.chain_transcripts(lifts.reads(spark, d))), 500, 5000, 0.9).select("tx_id", "coverage")


@R.query(
    W(
        Q.RETAINING + Q._RAW
        + f""", i AS (SELECT chrom, strand, j.d AS d, j.a AS a, max(cov) AS c FROM (SELECT chrom, strand, cov, unnest({Q.CHAIN}) AS j FROM raw WHERE n > 1) WHERE j.d < j.a GROUP BY ALL),
x AS (SELECT chrom, strand, tx_id, cov, n, u.k AS k, ex[u.k] AS b FROM raw, LATERAL (SELECT unnest(range(1, n + 1)) AS k) u), h AS (SELECT DISTINCT tx_id, k, n FROM x JOIN i y ON {SAME} AND x.b.s < y.d AND x.b.e > y.a AND y.c > x.cov)""",
        "SELECT tx_id, sum(CASE WHEN k = 1 THEN 3 WHEN k = n THEN 1 ELSE 2 END)::BIGINT AS ri_score FROM h GROUP BY tx_id",
    )
)
def intron_retention_score(spark: SparkSession, d: str) -> DataFrame:
    return T.rank_penalised(T.raw_transcripts(lifts.retaining(lifts.reads(spark, d))))


@R.query(
    W(
        Q.TWO
        + f""", c AS (SELECT chrom, strand, {Q.CHAIN} AS chain FROM reads WHERE ({Q._RUN}) = 1 AND len(ex) > 1), seen AS (SELECT DISTINCT chrom, strand, chain[i:i + k - 1] AS w FROM (SELECT *, unnest(range(1, len(chain) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM c) WHERE len(chain) >= k)),
t AS (SELECT tx_id, chrom, strand, chain[i:i + k - 1] AS w FROM (SELECT *, unnest(range(1, len(chain) - k + 2)) AS i FROM (SELECT *, least(len(chain), 3) AS k FROM ta)))""",
        "SELECT DISTINCT tx_id FROM t ANTI JOIN seen USING (chrom, strand, w)",
    )
)
def window_witness(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    return T.window_witness(lifts.chain_transcripts(a), b, 3)


@R.query(
    W(
        Q.RAW + f", c AS (SELECT *, {Q.CHAIN} AS chain FROM raw WHERE n > 1)",
        "SELECT chrom, strand, arg_max(tx_id, {'w': e - s, 'i': -tx_id}) AS tx_id, count(*) AS n_refs FROM c GROUP BY chrom, strand, chain",
    )
)
def chain_representatives(spark: SparkSession, d: str) -> DataFrame:
    return RP.chain_collapse(T.raw_transcripts(lifts.reads(spark, d)))


# families ----------------------------------------------------------------------------------------------

BUNDLES = "b AS (SELECT DISTINCT chrom, bdstart AS s, bdend AS e, strand, chrom || ':' || bdstart || '-' || bdend || strand AS locus FROM nodes WHERE chrom IS NOT NULL AND bdstart < bdend AND strand IS NOT NULL)"


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nodes").where("chrom IS NOT NULL AND bdstart < bdend AND strand IS NOT NULL")
    x = x.select("chrom", F.col("bdstart").alias("start"), F.col("bdend").alias("end"), "strand").distinct()
    return x.withColumn("locus", F.concat("chrom", F.lit(":"), "start", F.lit("-"), "end", "strand"))


@R.query(
    W(
        BUNDLES + ", p AS (SELECT x.locus AS a, y.locus AS b, x.strand AS t1, y.strand AS t2, least(x.e, y.e) - greatest(x.s, y.s) AS o, least(x.e - x.s, y.e - y.s) AS m FROM b x JOIN b y ON x.chrom = y.chrom AND x.locus < y.locus AND x.s < y.e + 50000 AND y.s < x.e + 50000)",
        "SELECT a, b FROM p WHERE NOT (((t1 = '+' AND t2 = '-') OR (t1 = '-' AND t2 = '+')) AND greatest(o, 0) / m >= 0.5)",
    )
)
def unmirrored_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of bundles closer than 50,000 bases without those that mirror each other on the other strand."""
    x = cut(_bundles(spark, d))
    wide = x.select("chrom", (F.col("start") - 50_000).alias("start"), "end", "locus")
    reach = x.select("chrom", "start", (F.col("end") + 50_000).alias("end"), "locus")
    hit = RG.overlap_join(wide, x.select("chrom", "start", "end", "locus"), ["chrom"]).select("locus", "r_locus")
    hit = hit.unionByName(RG.overlap_join(reach, x.select("chrom", "start", "end", "locus"), ["chrom"]).select("locus", "r_locus"))
    links = hit.where("locus <> r_locus").select(F.least("locus", "r_locus").alias("a"), F.greatest("locus", "r_locus").alias("b")).distinct()
    return FA.drop_mirrors(links, x, 0.5)


@R.query(W(BUNDLES, "SELECT locus, chrom || '/' || strand AS part FROM b QUALIFY count(*) OVER (PARTITION BY chrom, strand) > 1"))
def strand_families(spark: SparkSession, d: str) -> DataFrame:
    return FA.strand_partition(_bundles(spark, d).withColumn("family", F.col("chrom"))).select("locus", "part")


@R.query(
    W(
        """m AS (SELECT chrom AS family, bdstart, bdend, strand, count(DISTINCT node_idx) - 1 AS n FROM nodes WHERE chrom IS NOT NULL GROUP BY ALL), f AS (SELECT family, count(*) AS n_copies, avg(n) AS mean_introns, stddev_pop(n) AS sd FROM m GROUP BY 1),
e AS (SELECT chrom AS family, count(*) AS n_shared FROM flow_iterations WHERE chrom IS NOT NULL GROUP BY 1), x AS (SELECT family, n_copies, round(mean_introns, 6) AS mean_introns, coalesce(n_shared, 0) AS n_shared, CASE WHEN mean_introns > 0 THEN sd / mean_introns ELSE 0 END AS cv FROM f LEFT JOIN e USING (family))""",
        "SELECT family, n_copies, mean_introns, n_shared, round(cv, 6) AS cv, n_copies BETWEEN 2 AND 30 AND n_shared >= 10 AND n_shared / n_copies >= 1 AND cv <= 1.5 AS keep, CASE WHEN n_copies < 2 OR mean_introns = 0 THEN 'skip' WHEN n_copies > 20 THEN 'too_many' WHEN n_copies * greatest(n_shared, 10) > 2000 THEN 'too_large' ELSE 'em' END AS route FROM x",
    )
)
def family_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality and route of families (here chromosomes of bundles; what they share are flow paths)."""
    n = table(spark, d, "nodes").where("chrom IS NOT NULL")
    m = n.groupBy(F.col("chrom").alias("family"), "bdstart", "bdend", "strand").agg((F.countDistinct("node_idx") - 1).alias("n_introns"))
    e = table(spark, d, "flow_iterations").where("chrom IS NOT NULL").groupBy(F.col("chrom").alias("family")).agg(F.count(F.lit(1)).alias("n_shared"))
    x = FA.family_quality(m, e)
    x = FA.em_route(x.withColumn("n_reads", F.col("n_shared")).withColumn("n_introns", F.col("mean_introns")), max_copies=20)
    return x.select("family", "n_copies", F.round("mean_introns", 6).alias("mean_introns"), "n_shared", F.round("cv", 6).alias("cv"), "keep", "route")


@R.query(W(Q.READS, "SELECT chrom AS family, floor(donor / 10 + 0.5)::BIGINT * 10 AS donor, floor(acceptor / 10 + 0.5)::BIGINT * 10 AS acceptor, count(DISTINCT copy) AS n_copies FROM (SELECT *, regexp_extract(read_name, '_s([0-9]+)/', 1) AS copy FROM junc) GROUP BY ALL HAVING count(DISTINCT copy) >= 2"))
def junction_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Rounded junctions of a chromosome that several sequencing cells (as copies) show."""
    x = lifts.reads(spark, d).select(F.col("chrom").alias("family"), F.regexp_extract("read_name", "_s([0-9]+)/", 1).alias("copy"), F.explode(chains.junctions(F.col("exons"))).alias("j"))
    return FA.junction_consensus(x.select("family", "copy", "j.donor", "j.acceptor"))


MEMBERS = "mb AS (SELECT DISTINCT chrom || ':' || bdstart || strand AS family, run_id AS copy, node_idx AS node, start FROM nodes WHERE chrom IS NOT NULL AND bdstart IS NOT NULL AND strand IS NOT NULL AND run_id IS NOT NULL AND start IS NOT NULL)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nodes").where("chrom IS NOT NULL AND bdstart IS NOT NULL AND strand IS NOT NULL AND run_id IS NOT NULL AND start IS NOT NULL")
    return x.select(F.concat("chrom", F.lit(":"), "bdstart", "strand").alias("family"), F.col("run_id").alias("copy"), F.col("node_idx").alias("node"), "start").distinct()


@R.query(W(MEMBERS, "SELECT family, node AS u, next AS v, count(DISTINCT copy) AS support FROM (SELECT *, lead(node) OVER (PARTITION BY family, copy ORDER BY start, node) AS next FROM mb) WHERE next IS NOT NULL GROUP BY ALL"))
def family_edges(spark: SparkSession, d: str) -> DataFrame:
    return FA.family_edges(_members(spark, d))


@R.query(W(MEMBERS, "SELECT family, copy FROM (SELECT family, copy, count(DISTINCT node) AS n FROM mb GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, copy) = 1"))
def representative_copies(spark: SparkSession, d: str) -> DataFrame:
    return FA.representative_copy(_members(spark, d))


@R.query(W(Q.TX, f"SELECT * REPLACE (family AS family) FROM ({Q._islands('(SELECT strand AS family, chrom, s, e FROM tx)', 'family, chrom', 5000, 'min(s) AS locus_start, max(e) AS locus_end, count(*) AS n_tx')})"))
def gene_loci(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of a strand (as family) chained over gaps of at most 5,000 bases."""
    return FA.gene_loci(T.with_structure(lifts.chain_transcripts(lifts.reads(spark, d))).withColumn("family", F.col("strand")))


@R.query(
    """WITH RECURSIVE x AS (SELECT chrom || ':' || bdstart || strand AS family, row_id AS id, start - bdstart AS s, "end" - bdstart AS e FROM nodes WHERE chrom IS NOT NULL AND strand IS NOT NULL AND bdstart <= start AND start < "end"),
l AS (SELECT a.id AS u, b.id AS v FROM x a JOIN x b ON a.family = b.family AND a.s < b.e AND b.s < a.e WHERE (least(a.e, b.e) - greatest(a.s, b.s)) / greatest(a.e - a.s, b.e - b.s) >= 0.3),
r AS (SELECT id AS u, id AS v FROM x UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u) SELECT u AS exon_id, min(v) AS node FROM r GROUP BY u"""
)
def exon_classes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a place, over all runs, clustered by reciprocal overlap."""
    x = table(spark, d, "nodes").where("chrom IS NOT NULL AND strand IS NOT NULL AND bdstart <= start AND start < end")
    x = x.select(F.concat("chrom", F.lit(":"), "bdstart", "strand").alias("family"), F.col("row_id").alias("exon_id"), (F.col("start") - F.col("bdstart")).alias("start"), (F.col("end") - F.col("bdstart")).alias("end"))
    return FA.exon_classes(x).select("exon_id", "node")


@R.query(W(Q.FLOW, "SELECT chrom AS family, array_to_string(p, ',') AS path, count(*) AS n_reads, round(avg(w), 6) AS loglik FROM flow GROUP BY ALL HAVING count(*) >= 3"))
def synthesized_bundles(spark: SparkSession, d: str) -> DataFrame:
    x = lifts.flow_paths(spark, d).select(F.col("chrom").alias("family"), F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), F.col("abundance").alias("loglik"))
    return FA.synthesize_bundles(x).withColumn("loglik", F.round("loglik", 6))


@R.query(W(Q.TX + f", t AS ({Q._islands('tx', 'chrom, strand', 100, 'min(s) AS i, max(e) AS z')})", "SELECT tx_id, chrom AS by_gene, tx.chrom || ':' || tx.strand || ':' || t.i AS by_span FROM tx JOIN t ON tx.chrom = t.chrom AND tx.strand = t.strand AND tx.s BETWEEN t.i AND t.z").replace("chrom AS by_gene", "tx.chrom AS by_gene"))
def template_families(spark: SparkSession, d: str) -> DataFrame:
    x = T.with_structure(lifts.chain_transcripts(lifts.reads(spark, d))).withColumn("gene_id", F.col("chrom"))
    a = FA.template_families(x).select("tx_id", F.col("template").alias("by_gene"))
    return a.join(FA.template_families(x, by_gene=False).select("tx_id", F.col("template").alias("by_span")), "tx_id")


@R.query(
    W(
        Q.TWO
        + """, o AS (SELECT DISTINCT tx_id, chrom, strand, unnest(chain) AS j FROM ta), r AS (SELECT DISTINCT 'T' || (s // 100000) || chrom || strand AS t, chrom, strand, unnest(chain) AS j FROM tb), n1 AS (SELECT tx_id, count(*) AS a FROM o GROUP BY 1), n2 AS (SELECT t, count(*) AS b FROM r GROUP BY 1),
x AS (SELECT tx_id, t, count(*) AS n FROM o JOIN r USING (chrom, strand, j) GROUP BY ALL), y AS (SELECT tx_id, t, n / (a + b - n) AS jac FROM x JOIN n1 USING (tx_id) JOIN n2 USING (t))""",
        "SELECT tx_id, t || '-like' AS name, round(jac, 6) AS jaccard FROM y WHERE jac > 0.1 QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY jac DESC, t) = 1",
    )
)
def family_names(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of one sample named after the template (100,000 bases of the other) with the best shared junctions."""
    a, b = _halves(spark, d)
    t = T.with_structure(lifts.chain_transcripts(b)).withColumn("template", F.concat(F.lit("T"), F.floor(F.col("start") / 100_000), "chrom", "strand"))
    return FA.family_names(lifts.chain_transcripts(a), t, 0.1).withColumn("jaccard", F.round("jaccard", 6))


@R.query(
    W(
        Q.PLACES + ", s AS (SELECT read, locus AS copy, compat * 20 + ln(0.5 + length(locus) % 2) AS s FROM pl), m AS (SELECT *, max(s) OVER (PARTITION BY read) AS b FROM s), z AS (SELECT *, sum(exp(s - b)) OVER (PARTITION BY read) AS z, max(CASE WHEN s < b THEN s END) OVER (PARTITION BY read) AS second FROM m)",
        "SELECT read, copy, round(CASE WHEN second IS NOT NULL AND b - second >= 10 THEN CASE WHEN s = b THEN 1 ELSE 0 END ELSE exp(s - b) / z END, 6) AS weight FROM z",
    )
)
def likelihood_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of placements from log-likelihoods (here twenty times the fit) and priors of copies."""
    p = cut(lifts.placements(lifts.reads(spark, d)).groupBy("read", F.col("locus").alias("copy")).agg(F.max("compat").alias("c")))
    priors = p.select("copy").distinct().withColumn("prior", 0.5 + F.length("copy") % 2)
    return P.hmm_weights(p.select("read", "copy", (F.col("c") * 20).alias("loglik")), priors).withColumn("weight", F.round("weight", 6))


@R.query("SELECT row_id, CASE WHEN (row_id % 6) * 15 < 40 THEN 'below' WHEN (row_id % 10) / 10.0 > 0.3 THEN 'masked' ELSE 'external' END AS rescue_class FROM aligned_reads")
def rescue_classes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "aligned_reads").select("row_id", (F.col("row_id") % 6).alias("hits"), ((F.col("row_id") % 10) / 10.0).alias("masked_share"))
    return FA.rescue_class(x).select("row_id", "rescue_class")


@R.query(
    W(
        Q.READS + ", p AS (SELECT *, count(*) OVER (PARTITION BY read_name, chrom) AS c, sum(s) OVER (PARTITION BY read_name, chrom) - s AS m FROM reads WHERE read_name IS NOT NULL)",
        "SELECT x.row_id, y.row_id AS mate_id FROM p x JOIN p y ON x.read_name = y.read_name AND x.chrom = y.chrom AND x.c = 2 AND y.c = 2 AND x.s = y.m AND y.s = x.m AND (x.s < y.s OR (x.s = y.s AND x.row_id < y.row_id))",
    )
)
def mate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The two placements of a name on one chromosome as mates."""
    from pyspark.sql import Window

    w = Window.partitionBy("read_name", "chrom")
    x = lifts.reads(spark, d).where("read_name IS NOT NULL").withColumn("__c", F.count(F.lit(1)).over(w))
    x = x.withColumn("mate_start", F.when(F.col("__c") == 2, F.sum("start").over(w) - F.col("start"))).withColumn("hi", F.lit(0))
    return CV.pair_mates(x)


# runs and reports --------------------------------------------------------------------------------------


@R.query(
    W(
        Q.REGION + "," + Q.PANEL + ", f AS (SELECT chrom, region_start AS s, max(e) AS e FROM reg GROUP BY ALL), x AS (SELECT DISTINCT chrom, s, e FROM panel), h AS (SELECT x.chrom, x.s, x.e, max((abs(x.s - f.s) <= 5000 AND abs(x.e - f.e) <= 5000)::INT) AS same FROM x JOIN f ON x.chrom = f.chrom AND x.s < f.e AND f.s < x.e GROUP BY ALL)",
        "SELECT CASE WHEN same IS NULL THEN 'missing' WHEN same = 1 THEN 'exact' ELSE 'overlap' END AS fate, count(*) AS n FROM x LEFT JOIN h USING (chrom, s, e) GROUP BY ALL",
    )
)
def matched_regions(spark: SparkSession, d: str) -> DataFrame:
    found = RG.region_table(lifts.reads(spark, d)).select("chrom", F.col("region_start").alias("start"), F.col("region_end").alias("end"))
    return RP.match_regions(found, lifts.panels(spark, d), slack=5000)


@R.query(
    """WITH r AS (SELECT locus_id, max(priority_score >= 10) AS a, max(n_needy_refs >= 2) AS b, max(subopt_refs >= 1) AS c FROM ggo19_needy_top15 GROUP BY ALL)
SELECT locus_id AS ref_id, CASE WHEN NOT coalesce(a, false) THEN 'score' WHEN NOT coalesce(b, false) THEN 'refs' WHEN NOT coalesce(c, false) THEN 'subopt' ELSE '' END AS lost_at FROM r WHERE locus_id IS NOT NULL"""
)
def lost_references(spark: SparkSession, d: str) -> DataFrame:
    """The first condition at which a needy locus falls."""
    x = table(spark, d, "ggo19_needy_top15").where("locus_id IS NOT NULL").withColumnRenamed("locus_id", "ref_id")
    stages = [("score", x.where("priority_score >= 10")), ("refs", x.where("n_needy_refs >= 2")), ("subopt", x.where("subopt_refs >= 1"))]
    return RP.kill_stage(x, stages)


@R.query(W(Q.READS, "SELECT chrom, count(*) AS mapped, count(*) FILTER (len(ex) > 1) AS spliced, count(*) FILTER (strand <> 0) AS stranded FROM reads GROUP BY chrom"))
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    return RP.stage_counts([("mapped", r), ("spliced", r.where(F.size("exons") > 1)), ("stranded", r.where("strand <> 0"))], ["chrom"])


def _two_stages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, d, NEXT5)
    return x.where("stage_id < 'm'"), x.where("stage_id >= 'm'")


LOGK = 'run_id, chrom, start, "end", strand'


@R.query(
    f"""WITH g AS (SELECT stage_id < 'm' AS side, {LOGK}, n_nodes, n_edges, count(*) AS n FROM {NEXT5} WHERE stage_id IS NOT NULL GROUP BY ALL),
l AS (SELECT side, {LOGK}, list({{'a': n_nodes, 'b': n_edges, 'n': n}} ORDER BY n_nodes, n_edges, n) AS v FROM g GROUP BY ALL)
SELECT coalesce(x.run_id, y.run_id) AS run_id, coalesce(x.chrom, y.chrom) AS chrom, coalesce(x.start, y.start) AS start, coalesce(x."end", y."end") AS "end", coalesce(x.strand, y.strand) AS strand,
CASE WHEN y.v IS NULL THEN 'only_a' WHEN x.v IS NULL THEN 'only_b' WHEN x.v = y.v THEN 'same' ELSE 'changed' END AS fate FROM (SELECT * FROM l WHERE side) x FULL JOIN (SELECT * FROM l WHERE NOT side) y
ON x.run_id IS NOT DISTINCT FROM y.run_id AND x.chrom IS NOT DISTINCT FROM y.chrom AND x.start IS NOT DISTINCT FROM y.start AND x."end" IS NOT DISTINCT FROM y."end" AND x.strand IS NOT DISTINCT FROM y.strand"""
)
def log_differences(spark: SparkSession, d: str) -> DataFrame:
    """Counters of bundles at early and late stages side by side."""
    a, b = _two_stages(spark, d)
    return RP.diff_logs(a, b, ["run_id", "chrom", "start", "end", "strand"], ["n_nodes", "n_edges"]).drop("columns")


@R.query(
    """WITH x AS (SELECT DISTINCT chrom, start, "end" FROM nodes WHERE chrom IS NOT NULL AND strand = '+'), y AS (SELECT DISTINCT chrom, start, "end" FROM nodes WHERE chrom IS NOT NULL AND strand = '-'),
f AS (SELECT coalesce(x.chrom, y.chrom) AS chrom, x.chrom IS NOT NULL AS a, y.chrom IS NOT NULL AS b FROM x FULL JOIN y ON x.chrom = y.chrom AND x.start = y.start AND x."end" = y."end")
SELECT chrom, count(*) FILTER (a AND b) AS shared, count(*) FILTER (NOT b) AS only_a, count(*) FILTER (NOT a) AS only_b, count(*) FILTER (NOT (a AND b)) = 0 AS same FROM f GROUP BY chrom"""
)
def compared_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the two strands of a chromosome compared."""
    n = table(spark, d, "nodes").where("chrom IS NOT NULL")
    return RP.compare_graphs(n.where("strand = '+'"), n.where("strand = '-'"), ["chrom"], ["start", "end"])


@R.query(W(Q.ALL, "SELECT chrom AS family, count(*) AS n, round(avg(cov), 6) AS mean, round(CASE WHEN avg(cov) <> 0 THEN stddev_pop(cov) / avg(cov) ELSE 0 END, 6) AS cv FROM tx GROUP BY chrom"))
def family_coherence(spark: SparkSession, d: str) -> DataFrame:
    x = RP.coherence(lifts.transcripts(lifts.reads(spark, d)).withColumn("family", F.col("chrom")), "coverage")
    return x.withColumn("mean", F.round("mean", 6)).withColumn("cv", F.round("cv", 6))


@R.query(W(Q.READS, Q._islands("reads", "chrom", 201, "min(s) AS region_start, max(e) AS region_end, count(*) AS n_reads")))
def growing_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions as sessions whose gap is an alignment's own length, on a batch frame."""
    return SS.growing_regions(lifts.reads(spark, d))


@R.query(W(Q.READS, f"SELECT DISTINCT chrom, strand, {Q.EXON_TEXT} AS exons FROM reads"))
def first_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Repeated alignments dropped as they come."""
    return SS.first_seen(lifts.reads(spark, d), ["chrom", "strand", "exons"]).select("chrom", "strand", exon_text())


@R.query("SELECT run_id, chrom, count(*) AS n_descents FROM (SELECT run_id, chrom, start, lag(start) OVER (PARTITION BY run_id, chrom ORDER BY row_id) AS p FROM aligned_reads) WHERE p > start GROUP BY ALL")
def order_guard(spark: SparkSession, d: str) -> DataFrame:
    return SS.check_order(table(spark, d, "aligned_reads"), ["run_id", "chrom"], "start", "row_id")


FAM = (
    "RECURSIVE " + Q.PLACES + ", l AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links), r AS (SELECT u, u AS v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u), fm AS (SELECT u AS locus, min(v) AS family FROM r GROUP BY u)"
    + """, rb AS (SELECT chrom || ':' || region_start AS locus, chrom, region_start AS s, max(e) AS e FROM reg GROUP BY chrom, region_start),
ji AS (SELECT locus, count(DISTINCT j) AS n FROM (SELECT chrom || ':' || region_start AS locus, unnest(list_transform(range(1, len(ex)), lambda i: {'d': ex[i].e, 'a': ex[i + 1].s})) AS j FROM reg) GROUP BY 1),
m AS (SELECT fm.family, fm.locus, rb.chrom, rb.s, rb.e, coalesce(ji.n, 0) AS n FROM fm JOIN rb USING (locus) LEFT JOIN ji USING (locus)),"""
    + f"gl AS (SELECT family, count(*) AS n_loci FROM ({Q._islands('m', 'family, chrom', 5000, 'min(s) AS i')}) GROUP BY family),"
    + "ev AS (SELECT family, sum(n_shared) AS n_shared FROM links JOIN fm ON links.a = fm.locus GROUP BY 1), q AS (SELECT family, count(*) AS n_copies, CASE WHEN avg(n) > 0 THEN stddev_pop(n) / avg(n) ELSE 0 END AS cv FROM m GROUP BY 1)"
)


@R.query(W(FAM, "SELECT family, n_copies, n_loci, n_shared::BIGINT AS n_shared, round(n_shared / n_copies, 6) AS shared_per_copy, round(cv, 6) AS cv, n_copies BETWEEN 2 AND 30 AND n_shared >= 10 AND n_shared / n_copies >= 1 AND cv <= 1.5 AS keep FROM q JOIN gl USING (family) JOIN ev USING (family)"))
def family_report(spark: SparkSession, d: str) -> DataFrame:
    """The full report of families of linked loci: copies, gene loci over gaps of 5,000 bases, shared reads in all and
    a copy, variation of the number of introns, and whether the family is kept."""
    r = cut(lifts.reads(spark, d))
    links = cut(FA.locus_links(lifts.placements(r)))
    fam = cut(FA.families(links).select("locus", "family"))
    name = F.concat_ws(":", "chrom", "region_start").alias("locus")
    bounds = RG.region_table(r).select(name, "chrom", F.col("region_start").alias("start"), F.col("region_end").alias("end"))
    j = RG.regions(r, ["chrom"]).select(name, F.explode(chains.junctions(F.col("exons"))).alias("j")).groupBy("locus").agg(F.countDistinct("j").alias("n_introns"))
    m = cut(fam.join(bounds, "locus").join(j, "locus", "left").fillna(0, ["n_introns"]))
    shared = links.join(fam.withColumnRenamed("locus", "a"), "a").select("family", "n_shared")
    loci = FA.gene_loci(m).groupBy("family").agg(F.count(F.lit(1)).alias("n_loci"))
    x = FA.family_quality(m, shared).join(loci, "family")
    return x.select("family", "n_copies", "n_loci", "n_shared", F.round(F.col("n_shared") / F.col("n_copies"), 6).alias("shared_per_copy"), F.round("cv", 6).alias("cv"), "keep")

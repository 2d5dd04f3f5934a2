"""Queries over audits, coverage rules, family measures and graph repairs. Each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splicelake.functions import chains
from splicelake.operators import audits as A
from splicelake.operators import bundles as B
from splicelake.operators import graphs as G
from splicelake.operators import islands as I
from splicelake.operators import junctions as J
from splicelake.operators import nested as N
from splicelake.operators import ranges as RG
from splicelake.operators import transcripts as T
from splicelake.plans import alignments as PA
from splicelake.plans import bundles as PB
from splicelake.plans import lifts
from splicelake.plans import loci_sql as Q
from splicelake.plans import structures as PS
from splicelake.plans.lifts import BUNDLE
from splicelake.plans.registry import Registry, exon_text
from splicelake.session import cut, shared_folder
from splicelake.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
W = Q.w
JK = "chrom, strand, donor, acceptor"
SAME = "x.chrom = y.chrom AND x.strand = y.strand"
SEG = f"seg AS ({Q._segments('exon', 'chrom')})"


def _segments(r: DataFrame) -> DataFrame:
    return cut(RG.coverage_segments(lifts.exon_rows(r), ["chrom"]))


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a, b = lifts.halves(lifts.reads(spark, d))
    return cut(lifts.transcripts(a)), cut(lifts.transcripts(b))


# runs and references ----------------------------------------------------------------------------


@R.query(
    """WITH k AS (SELECT DISTINCT 'graph' AS l, chrom, bdstart AS s, bdend AS e FROM nodes UNION ALL SELECT DISTINCT 'flow', chrom, bdstart, bdend FROM flow_iterations UNION ALL SELECT DISTINCT 'geometry', chrom, start, "end" FROM partition_geometry)
SELECT chrom, s AS start, e AS "end", bool_or(l = 'graph') AS graph, bool_or(l = 'flow') AS flow, bool_or(l = 'geometry') AS geometry, CASE WHEN bool_or(l = 'graph') THEN 'graph' WHEN bool_or(l = 'flow') THEN 'flow' ELSE 'geometry' END AS layer FROM k GROUP BY chrom, s, e"""
)
def bundle_layers(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t: table(spark, d, t).select("chrom", F.col("bdstart").alias("start"), F.col("bdend").alias("end"))
    return A.presence([("graph", own("nodes")), ("flow", own("flow_iterations")), ("geometry", table(spark, d, "partition_geometry"))], ["chrom", "start", "end"])


@R.query(
    """WITH c AS (SELECT unnest(regexp_extract_all(classes, '([=a-z]):', 1)) AS code FROM ggo19_needy_top15)
SELECT CASE WHEN code = '=' THEN 'exact' WHEN contains('jcmno', code) THEN 'variant' WHEN contains('ieki', code) THEN 'inside' WHEN contains('xspuyr', code) THEN 'apart' ELSE 'other' END AS bucket, code, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY code"""
)
def class_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "ggo19_needy_top15").select(F.explode(F.regexp_extract_all("classes", F.lit("([=a-z]):"), F.lit(1))).alias("class_code"))
    return A.class_gaps(c).withColumn("share", F.round("share", 6))


MATCH = Q.ALL_TWO + f", m AS (SELECT x.tx_id, y.tx_id AS ref_id, x.cov AS a, y.cov AS b FROM ta x JOIN tb y ON {SAME} AND ((x.n > 1 AND y.n > 1 AND x.chain = y.chain) OR (x.n = 1 AND y.n = 1 AND x.s = y.s AND x.e = y.e)))"


@R.query(W(MATCH, "SELECT count(*) AS n, round(corr(a, b), 6) AS correlation, round(avg(a / b), 6) AS mean_ratio FROM m"))
def attribute_agreement(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    x = A.attribute_agreement(a, b)
    return x.select("n", F.round("correlation", 6).alias("correlation"), F.round("mean_ratio", 6).alias("mean_ratio"))


@R.query(W(Q.READS + "," + Q.PANEL, "SELECT p.row_id, count(r.row_id) AS n_reads, count(r.row_id) FILTER (len(ex) > 1) AS n_spliced FROM panel p LEFT JOIN reads r ON p.chrom = r.chrom AND p.s < r.e AND r.s < p.e GROUP BY p.row_id"))
def absent_references(spark: SparkSession, d: str) -> DataFrame:
    return A.region_support(lifts.panels(spark, d), lifts.reads(spark, d), "row_id")


@R.query(
    W(
        MATCH
        + f""", kn AS (SELECT DISTINCT chrom, strand, unnest(chain) AS j FROM tb), o AS (SELECT tx_id, count(k.chrom) AS k, count(*) AS n FROM (SELECT tx_id, chrom, strand, unnest(chain) AS j FROM ta) x LEFT JOIN kn k ON x.chrom = k.chrom AND x.strand = k.strand AND x.j = k.j GROUP BY 1)""",
        f"""SELECT x.tx_id, CASE WHEN x.tx_id IN (SELECT tx_id FROM m) THEN 'exact' WHEN o.k = o.n THEN 'known_introns' WHEN o.k > 0 THEN 'some_introns'
        WHEN EXISTS (SELECT 1 FROM tb y WHERE {SAME} AND x.s < y.e AND y.s < x.e) THEN 'overlap' ELSE 'novel' END AS fate FROM ta x LEFT JOIN o USING (tx_id)""",
    )
)
def transcript_fates(spark: SparkSession, d: str) -> DataFrame:
    return A.transcript_fates(*_two(spark, d))


@R.query(W(Q.PANEL + ", g AS (SELECT DISTINCT chrom || ':' || bdstart AS gene, chrom, bdstart AS s, bdend AS e FROM nodes WHERE chrom IS NOT NULL)", "SELECT DISTINCT p.row_id, gene FROM panel p JOIN g ON p.chrom = g.chrom AND p.s < g.e AND g.s < p.e"))
def gene_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").where("chrom IS NOT NULL")
    g = n.select(F.concat_ws(":", "chrom", "bdstart").alias("gene"), "chrom", F.col("bdstart").alias("start"), F.col("bdend").alias("end")).distinct()
    return A.overlapping_names(lifts.panels(spark, d), g, "row_id", "gene")


@R.query(W(Q.PANEL + ", g AS (SELECT DISTINCT chrom, bdstart - 1000 AS s, bdend + 1000 AS e FROM nodes)", "SELECT row_id FROM panel p WHERE EXISTS (SELECT 1 FROM g WHERE g.chrom = p.chrom AND p.s < g.e AND g.s < p.e)"))
def housekeeping_control(spark: SparkSession, d: str) -> DataFrame:
    """Panels that lie in a bundle, padded by a thousand bases."""
    g = table(spark, d, "nodes").select("chrom", F.col("bdstart").alias("start"), F.col("bdend").alias("end"))
    return RG.overlap_semi(lifts.panels(spark, d), g, ["chrom"], "row_id", pad=1000).select("row_id")


@R.query("SELECT chrom, count(*) FILTER (c = '1') AS \"1\", count(*) FILTER (c = '2') AS \"2\", count(*) FILTER (c = '3') AS \"3\" FROM (SELECT chrom, regexp_extract(read_name, '_s([0-9]+)/', 1) AS c FROM aligned_reads) GROUP BY chrom")
def paralog_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Reads per chromosome (as family) and sequencing cell (as copy)."""
    x = table(spark, d, "aligned_reads").select("chrom", F.regexp_extract("read_name", "_s([0-9]+)/", 1).alias("copy"))
    return A.paralog_matrix(x, "chrom", "copy", ["1", "2", "3"])


SNAP = "sn AS (SELECT DISTINCT run_id, chrom, bdstart, bdend, strand, node_idx, start AS s, \"end\" AS e FROM nodes WHERE run_id IS NOT NULL AND chrom IS NOT NULL AND bdstart IS NOT NULL AND strand IS NOT NULL AND node_idx IS NOT NULL AND start IS NOT NULL AND \"end\" IS NOT NULL)"


@R.query(W(SNAP, "SELECT run_id || '/' || chrom || '/' || bdstart || '/' || strand AS bundle, (row_number() OVER (PARTITION BY run_id, chrom, bdstart, strand ORDER BY bdend, node_idx, s, e) - 1)::INT AS pos, node_idx::VARCHAR AS id, s::VARCHAR AS start, e::VARCHAR AS \"end\" FROM sn"))
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Bundles written as nested JSON snapshots, one record a line, and read again as a table of nodes."""
    n = table(spark, d, "nodes").where("run_id IS NOT NULL AND chrom IS NOT NULL AND bdstart IS NOT NULL AND strand IS NOT NULL AND node_idx IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    x = n.groupBy(F.concat_ws("/", "run_id", "chrom", "bdstart", "strand").alias("bundle")).agg(F.array_sort(F.collect_set(F.struct("bdend", F.col("node_idx").alias("id"), "start", "end"))).alias("nodes"))
    at = shared_folder(spark, "snapshots")
    x.select(F.to_json(F.struct("bundle", "nodes")).alias("value")).write.text(at)
    lines = spark.read.text(at).withColumn("id", F.xxhash64("value"))
    p = N.pivot_paths(N.path_triples(lines, "id", "value", ["nodes"]), ("bundle", "id", "start", "end"))
    top = p.where("ancestor = ''").select("__id", "bundle")
    return p.where("ancestor = 'nodes[]'").drop("bundle").join(top, "__id").select("bundle", F.element_at("ords", 1).alias("pos"), "id", "start", "end")


@R.query(W(Q.REGION + f", j AS (SELECT DISTINCT chrom, region_start, ex[i].e AS donor, ex[i + 1].s AS acceptor FROM (SELECT *, unnest(range(1, len(ex))) AS i FROM reg))", "SELECT chrom, region_start, string_agg(donor || '-' || acceptor, ',' ORDER BY donor, acceptor) AS junctions FROM j GROUP BY ALL"))
def junction_dump(spark: SparkSession, d: str) -> DataFrame:
    """The junctions of every region as one text."""
    r = RG.regions(lifts.reads(spark, d), ["chrom"])
    j = r.select("chrom", "region_start", F.explode(chains.junctions(F.col("exons"))).alias("j")).groupBy("chrom", "region_start").agg(F.array_sort(F.collect_set("j")).alias("j"))
    return j.select("chrom", "region_start", F.array_join(F.transform("j", lambda x: F.concat_ws("-", x["donor"], x["acceptor"])), ",").alias("junctions"))


# junctions and coverage ----------------------------------------------------------------------------


def _cov(name: str, lo: str, hi: str) -> str:
    """Coverage sums of one stretch per junction."""
    return f"""{name} AS (SELECT {JK}, coalesce(sum((least({hi}, g."end") - greatest({lo}, g.start)) * g.depth) FILTER (g.start < {hi} AND g."end" > {lo}), 0) AS c FROM st LEFT JOIN seg g ON g.chrom = st.chrom AND g.start < {hi} AND g."end" > {lo} GROUP BY ALL)""".replace(f"SELECT {JK}", "SELECT st.chrom, strand, donor, acceptor")


@R.query(
    W(
        Q.STATS + "," + SEG + ", st AS (SELECT * FROM stats WHERE donor < acceptor)," + ",".join([_cov("ca", "(donor - 25)", "donor"), _cov("cb", "donor", "acceptor"), _cov("cc", "acceptor", "(acceptor + 25)")]),
        f"SELECT {JK}, round(cb.c / (acceptor - donor), 6) AS intron, round((ca.c + cc.c) / 50, 6) AS flank, cb.c / (acceptor - donor) >= (ca.c + cc.c) / 50 * 0.5::DOUBLE AS demoted FROM ca JOIN cb USING ({JK}) JOIN cc USING ({JK})",
    )
)
def run_through(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    x = A.run_through(J.junction_stats(r), _segments(r))
    return x.select(*J.JKEY, F.round("intron", 6).alias("intron"), F.round("flank", 6).alias("flank"), "demoted")


@R.query(
    W(
        Q.STATS + ", ee AS (SELECT chrom, strand, e, count(*) AS w FROM exon GROUP BY ALL), es AS (SELECT chrom, strand, s, count(*) AS w FROM exon GROUP BY ALL), "
        + f"d AS (SELECT {JK.replace('chrom', 'x.chrom').replace('strand', 'x.strand')}, sum(y.w) AS w FROM stats x JOIN ee y ON {SAME} AND abs(x.donor - y.e) <= 10 GROUP BY ALL), a AS (SELECT {JK.replace('chrom', 'x.chrom').replace('strand', 'x.strand')}, sum(y.w) AS w FROM stats x JOIN es y ON {SAME} AND abs(x.acceptor - y.s) <= 10 GROUP BY ALL)",
        f"SELECT {JK}, least(d.w, a.w)::BIGINT AS weight FROM d JOIN a USING ({JK})",
    )
)
def exon_pairing(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    return A.exon_pairing(J.junction_stats(r), lifts.exon_rows(r).withColumn("weight", F.lit(1).cast("long")))


@R.query(
    W(
        Q.TX + "," + SEG
        + """, x AS (SELECT tx_id, chrom, u.i AS i, ex[u.i].s AS s, ex[u.i].e AS e FROM tx, LATERAL (SELECT unnest(range(1, n + 1)) AS i) u),
c AS (SELECT tx_id, i, s, e, coalesce(sum((least(e, g."end") - greatest(s, g.start)) * g.depth), 0) / (e - s) AS m FROM x LEFT JOIN seg g ON g.chrom = x.chrom AND g.start < e AND g."end" > s GROUP BY tx_id, i, s, e),
f AS (SELECT *, lag(m) OVER w AS l, lead(m) OVER w AS r FROM c WINDOW w AS (PARTITION BY tx_id ORDER BY i)), k AS (SELECT *, coalesce(m < 0.5::DOUBLE * least(l, r) AND l IS NOT NULL AND r IS NOT NULL, false) AS dip FROM f), p AS (SELECT *, sum(dip::INT) OVER (PARTITION BY tx_id ORDER BY i) AS part FROM k)""",
        "SELECT tx_id, part::BIGINT AS part, string_agg(s || '-' || e, ',' ORDER BY i) AS exons FROM p WHERE NOT dip AND tx_id IN (SELECT tx_id FROM p WHERE dip) GROUP BY tx_id, part",
    )
)
def run_on_splits(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    return A.run_on_splits(lifts.chain_transcripts(r), _segments(r)).select("tx_id", "part", exon_text())


@R.query(
    W(
        Q.TWO + ", l AS (SELECT tx_id, list_filter(list_transform(chain, lambda j: j.a - j.d), lambda x: x > 1) AS l FROM ta), r AS (SELECT DISTINCT list_filter(list_transform(chain, lambda j: j.a - j.d), lambda x: x > 1) AS k FROM tb)",
        "SELECT DISTINCT tx_id FROM l JOIN r ON len(l) = len(k) AND len(l) >= 5 AND abs(l[1] - k[1]) <= 10 WHERE len(list_filter(range(1, len(l) + 1), lambda i: abs(l[i] - k[i]) > 10)) = 0",
    )
)
def chain_registry(spark: SparkSession, d: str) -> DataFrame:
    a, b = lifts.halves(lifts.reads(spark, d))
    return A.chain_registry(lifts.chain_transcripts(a), lifts.chain_transcripts(b))


@R.query(W(Q.READS, "SELECT row_id, len(list_filter(range(1, len(ex)), lambda i: abs(s + row_id % (e - s) - ex[i].e) <= 50 OR abs(s + row_id % (e - s) - ex[i + 1].s) <= 50)) > 0 AS near FROM reads"))
def near_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Whether a position of each read (drawn from row_id) lies within 50 bases of a splice site."""
    at = F.col("start") + F.col("row_id") % (F.col("end") - F.col("start"))
    return lifts.reads(spark, d).select("row_id", A.near_anchor(F.col("exons"), at, 50).alias("near"))


@R.query(W(Q.ALL, "SELECT tx_id, round((cov * (e - s) + c2 * l2) / (e - s + l2), 6) AS stitched FROM (SELECT tx_id, cov, s, e, lead(cov) OVER w AS c2, lead(e - s) OVER w AS l2 FROM tx WHERE n = 1 WINDOW w AS (PARTITION BY chrom, strand ORDER BY s, e, tx_id)) WHERE c2 IS NOT NULL"))
def stitched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each single exon stitched to the next of its place."""
    x = T.with_structure(lifts.transcripts(lifts.reads(spark, d))).where("n_exons = 1")
    w = Window.partitionBy("chrom", "strand").orderBy("start", "end", "tx_id")
    x = x.select("tx_id", "coverage", "tx_len", F.lead("coverage").over(w).alias("c2"), F.lead("tx_len").over(w).alias("l2")).where("c2 IS NOT NULL")
    return x.select("tx_id", F.round(A.stitched_coverage(F.col("coverage"), F.col("tx_len"), F.col("c2"), F.col("l2")), 6).alias("stitched"))


# families ---------------------------------------------------------------------------------------------

ISL = Q.REGION + f", ci AS ({Q._islands('exon', 'chrom', 0, 'min(s) AS s, max(e) AS e')}), rb AS (SELECT chrom, region_start, max(e) AS z FROM reg GROUP BY ALL), ri AS (SELECT ci.*, rb.region_start FROM ci JOIN rb ON ci.chrom = rb.chrom AND ci.s >= rb.region_start AND ci.s < rb.z)"


@R.query(
    W(
        ISL + ", n AS (SELECT chrom, region_start, count(*) AS n FROM ri GROUP BY ALL), h AS (SELECT row_id, r.chrom, r.region_start, count(DISTINCT ri.s) AS k FROM (SELECT row_id, chrom, region_start, unnest(ex) AS x FROM reg) r JOIN ri ON r.chrom = ri.chrom AND r.region_start = ri.region_start AND r.x.s < ri.e AND ri.s < r.x.e GROUP BY ALL)",
        "SELECT row_id, round(k / n, 6) AS share FROM h JOIN n USING (chrom, region_start)",
    )
)
def exon_coverage_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of the covered stretches of its region that a read touches."""
    r = cut(RG.regions(lifts.reads(spark, d), ["chrom"]).select("row_id", "chrom", "region_start", "exons", "start", "end"))
    ex = r.select("chrom", "region_start", F.explode("exons").alias("e")).select("chrom", "region_start", "e.start", "e.end")
    isl = I.label_islands(ex, ["chrom", "region_start"])
    isl = isl.groupBy("chrom", "region_start", F.col("__island").alias("start")).agg(F.max("__e").alias("end"))
    return A.exon_coverage_share(r, isl, ["chrom"], "region_start").withColumn("share", F.round("share", 6))


@R.query(
    W(
        Q.REGION + ", l AS (SELECT row_id, chrom || ':' || region_start AS g, list_sum(list_transform(ex, lambda x: x.e - x.s))::BIGINT AS n FROM reg), w AS (SELECT row_id, n - lag(n) OVER (PARTITION BY g ORDER BY n, row_id) AS a, lead(n) OVER (PARTITION BY g ORDER BY n, row_id) - n AS b FROM l)",
        "SELECT row_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE least(a, b) END AS divergence FROM w",
    )
)
def length_divergence(spark: SparkSession, d: str) -> DataFrame:
    r = RG.regions(lifts.reads(spark, d), ["chrom"]).withColumn("group", F.concat_ws(":", "chrom", "region_start"))
    return A.length_divergence(r, "group")


@R.query(W(PS.MEMBERS, "SELECT family, copy, string_agg(node, ',' ORDER BY start, node) AS path FROM mb GROUP BY ALL"))
def copy_paths(spark: SparkSession, d: str) -> DataFrame:
    x = A.copy_paths(PS._members(spark, d))
    return x.select("family", "copy", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


# graphs ---------------------------------------------------------------------------------------------------


@R.query(W(PB.EDGES + "," + PB.NODE + f", x AS (SELECT {PB.K}, node AS u, lead(node) OVER (PARTITION BY {PB.K} ORDER BY node) AS v FROM nd)", f"SELECT x.* FROM x WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ed WHERE {PB.EQ(x='x', y='ed')} AND ed.u = x.u AND ed.v = x.v)"))
def missing_edges(spark: SparkSession, d: str) -> DataFrame:
    return A.missing_edges(PB._nodes(spark, d), PB._capacities(spark, d), BUNDLE)


@R.query(W(Q.FLOW + f", dp AS (SELECT {PB.K}, p, sum(w) AS w FROM flow GROUP BY ALL)", f"SELECT {PB.K}, array_to_string(p, ',') AS path, row_number() OVER (PARTITION BY {PB.K} ORDER BY round(w, 6) DESC, p) AS rank FROM dp"))
def seed_ranks(spark: SparkSession, d: str) -> DataFrame:
    x = A.seed_ranks(PB._paths(spark, d).withColumn("abundance", F.round("abundance", 6)), BUNDLE)
    return x.select(*BUNDLE, PB._text(), "rank")


@R.query(
    W(
        Q.NODES + ", h AS (SELECT x.chrom, x.s, x.e, min(y.strand) AS lo, max(y.strand) AS hi FROM isl x JOIN isl y ON x.chrom = y.chrom AND x.strand = 0 AND y.strand <> 0 AND x.s < y.e AND y.s < x.e GROUP BY ALL)",
        "SELECT chrom, s AS start, e AS \"end\", CASE WHEN lo = hi THEN lo ELSE 0 END AS colour FROM isl LEFT JOIN h USING (chrom, s, e) WHERE strand = 0",
    )
)
def strand_colours(spark: SparkSession, d: str) -> DataFrame:
    return A.strand_colours(cut(G.exon_islands(lifts.reads(spark, d))))


@R.query(W(Q.NODES + ", h AS (SELECT DISTINCT x.row_id, i.s FROM exon x JOIN isl i ON x.chrom = i.chrom AND x.strand = i.strand AND x.s < i.e AND i.s < x.e)", "SELECT row_id, string_agg(s, ',' ORDER BY s) AS groups FROM h GROUP BY row_id"))
def read_groups(spark: SparkSession, d: str) -> DataFrame:
    r = lifts.reads(spark, d)
    x = A.read_groups(r, G.exon_islands(r))
    return x.select("row_id", F.array_join(F.col("groups").cast("array<string>"), ",").alias("groups"))


@R.query(W(Q.READS, Q._islands("exon", "chrom, strand", 50, 'min(s) AS start, max(e) AS "end"')))
def merged_islands(spark: SparkSession, d: str) -> DataFrame:
    """Exon islands joined over gaps of at most fifty bases."""
    return G.exon_islands(lifts.reads(spark, d), merge=50).select("chrom", "strand", "start", "end")


@R.query(
    W(
        "RECURSIVE " + PB.EDGES + "," + PB.NODE
        + f""", ln AS (SELECT {PB.K}, node, "end" - start AS n FROM nd), g AS (SELECT {PB.K}, v AS node, v AS cur, 0 AS l FROM ed WHERE v >= 0 UNION SELECT {PB.QK.format('g')}, g.node, ed.v, g.l + coalesce(ln.n, 0) FROM g JOIN ed ON {PB.EQ(x='g', y='ed')} AND ed.u = g.cur LEFT JOIN ln ON {PB.EQ(x='ln', y='ed')} AND ln.node = ed.v WHERE g.cur >= 0 AND g.l + coalesce(ln.n, 0) <= 1000)""",
        f"SELECT {PB.K}, node, bool_or(cur = -2) AS near FROM g GROUP BY {PB.K}, node",
    )
)
def sink_within_anchor(spark: SparkSession, d: str) -> DataFrame:
    return B.sink_within(PB._capacities(spark, d), PB._nodes(spark, d), BUNDLE, 1000)


# transcripts -----------------------------------------------------------------------------------------------


@R.query(W(Q.TX + f", p AS (SELECT x.tx_id, x.n - 1 AS n, len(list_filter(x.chain, lambda j: list_contains(y.chain, j))) AS k FROM tx x JOIN tx y ON {SAME} AND x.tx_id <> y.tx_id AND y.cov > x.cov AND x.cov <= y.cov * 0.5::DOUBLE AND x.s < y.e AND y.s < x.e)", "SELECT DISTINCT tx_id FROM p WHERE k >= n * 0.6 - 1e-9"))
def high_overlap(spark: SparkSession, d: str) -> DataFrame:
    return A.high_overlap(cut(lifts.chain_transcripts(lifts.reads(spark, d))), 0.6)


@R.query(
    W(
        Q.TX + f", p AS (SELECT x.tx_id, x.s, x.e, x.chain AS a, y.chain AS b, y.ex AS ye, list_position(y.chain, x.chain[1]) AS k FROM tx x JOIN tx y ON {SAME} AND x.n < y.n AND x.cov < y.cov * 0.5::DOUBLE AND list_has_all(y.chain, x.chain))",
        "SELECT DISTINCT tx_id FROM p WHERE k > 0 AND b[k:k + len(a) - 1] = a AND s >= ye[k].s - 100 AND e <= ye[k + len(a)].e + 100",
    )
)
def included_variants(spark: SparkSession, d: str) -> DataFrame:
    return A.included_variants(lifts.chain_transcripts(lifts.reads(spark, d)))


@R.query(W(Q.ALL + ", x AS (SELECT chrom, strand, cov, unnest(ex) AS b FROM tx)", f"SELECT DISTINCT x.tx_id FROM tx x JOIN x y ON {SAME} AND y.b.s <= x.s AND x.e <= y.b.e AND x.cov < y.cov * 0.3::DOUBLE"))
def within_exon(spark: SparkSession, d: str) -> DataFrame:
    return A.within_exon(cut(lifts.transcripts(lifts.reads(spark, d))))


@R.query(
    W(
        Q.TX + "," + SEG
        + """, x AS (SELECT tx_id, chrom, u.i AS i, ex[u.i].s AS s, ex[u.i].e AS e FROM tx, LATERAL (SELECT unnest(range(1, n + 1)) AS i) u),
c AS (SELECT tx_id, i, s, e, coalesce(sum((least(e, g."end") - greatest(s, g.start)) * g.depth), 0) / (e - s) AS m FROM x LEFT JOIN seg g ON g.chrom = x.chrom AND g.start < e AND g."end" > s GROUP BY tx_id, i, s, e),
f AS (SELECT *, lag(m) OVER w AS l, lead(m) OVER w AS r FROM c WINDOW w AS (PARTITION BY tx_id ORDER BY i))""",
        "SELECT tx_id, string_agg(s || '-' || e, ',' ORDER BY i) AS exons FROM f WHERE NOT coalesce((l IS NULL AND m < r * 0.5::DOUBLE) OR (r IS NULL AND m < l * 0.5::DOUBLE), false) GROUP BY tx_id",
    )
)
def trimmed_terminals(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    return A.trim_weak_terminals(lifts.chain_transcripts(r), _segments(r), 0.5).select("tx_id", exon_text())


@R.query(
    W(
        Q.RETAINING + Q._RAW + f", i AS (SELECT chrom, strand, j.d AS d, j.a AS a, max(cov) AS c FROM (SELECT chrom, strand, cov, unnest({Q.CHAIN}) AS j FROM raw WHERE n > 1 AND strand <> 0) WHERE j.d < j.a GROUP BY ALL), x AS (SELECT chrom, strand, tx_id, cov, unnest(ex) AS b FROM raw WHERE strand <> 0)",
        "SELECT DISTINCT x.tx_id FROM x JOIN i y ON x.chrom = y.chrom AND x.strand = -y.strand AND x.b.s < y.d AND x.b.e > y.a WHERE x.cov < 2 * y.c",
    )
)
def cross_strand_retained(spark: SparkSession, d: str) -> DataFrame:
    return A.cross_strand_retained(cut(T.raw_transcripts(lifts.retaining(lifts.reads(spark, d)))), 2.0)


ENDS = "array_to_string(list_transform(list_concat([{'s': y.centre, 'e': x.ex[1].e}], x.ex[2:]), lambda k: k.s || '-' || k.e), ',')"


@R.query(
    W(
        Q.TX + f", pt AS (SELECT chrom, strand, s, s AS e, sum(w) AS w FROM reads GROUP BY ALL), c AS (SELECT * FROM ({Q._islands('pt', 'chrom, strand', 5, 'floor(sum(s * w) / sum(w) + 0.5)::BIGINT AS centre, sum(w)::BIGINT AS weight')}) WHERE weight >= 2)",
        f"SELECT x.tx_id, y.centre, y.weight, {ENDS} AS exons FROM tx x JOIN c y ON {SAME} AND y.centre >= x.ex[1].s + 5 AND y.centre < x.ex[1].e - 5",
    )
)
def alternative_ends(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    c = RG.cluster_positions(r.select("chrom", "strand", F.col("start").alias("pos"), "weight"), ["chrom", "strand"], window=5, least=2)
    return A.alternative_ends(lifts.chain_transcripts(r), c, 5).select("tx_id", "centre", "weight", exon_text())


@R.query(
    W(
        Q.STATS + "," + Q._tx("tx", "reads") + f", j AS (SELECT tx_id, chrom, strand, ex, u.i AS i, chain[u.i].d AS donor, chain[u.i].a AS acceptor FROM tx, LATERAL (SELECT unnest(range(1, n)) AS i) u), p AS (SELECT x.*, y.donor AS d2 FROM j x JOIN stats y ON {SAME} AND x.acceptor = y.acceptor AND abs(x.donor - y.donor) <= 1000 AND x.donor <> y.donor JOIN stats o ON o.chrom = x.chrom AND o.strand = x.strand AND o.donor = x.donor AND o.acceptor = x.acceptor WHERE y.mrcount >= o.mrcount * 0.7::DOUBLE)",
        "SELECT tx_id, i - 1 AS part, d2 AS donor, array_to_string(list_transform(range(1, len(ex) + 1), lambda k: ex[k].s || '-' || CASE WHEN k = i THEN d2 ELSE ex[k].e END), ',') AS exons FROM p WHERE ex[i].s < d2",
    )
)
def alternative_sites(spark: SparkSession, d: str) -> DataFrame:
    r = cut(lifts.reads(spark, d))
    return A.alternative_sites(cut(lifts.chain_transcripts(r)), J.junction_stats(r), 1000).select("tx_id", "part", "donor", exon_text())


@R.query(W(Q.BOUNDARIES + ", c AS (SELECT chrom, strand, s, e, unnest([s, e]) AS p FROM node UNION SELECT chrom, strand, node_start, e, pos FROM bd)", "SELECT chrom, strand, s AS node, p AS start, nx AS \"end\" FROM (SELECT *, lead(p) OVER (PARTITION BY chrom, strand, s ORDER BY p) AS nx FROM c) WHERE nx IS NOT NULL"))
def longtrimmed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Graph nodes cut where coverage changes."""
    r = cut(lifts.reads(spark, d))
    seg = cut(RG.coverage_segments(lifts.exon_rows(r), ["chrom", "strand"]))
    return A.longtrim(cut(G.split_nodes(r)), seg, ["chrom", "strand"])


@R.query(
    W(
        f"m AS (SELECT chrom || ':' || bdstart || strand AS family, node_idx AS node, \"end\" - start AS n, count(*) AS w FROM nodes WHERE chrom IS NOT NULL AND bdstart IS NOT NULL AND strand IS NOT NULL AND node_idx IS NOT NULL AND start < \"end\" GROUP BY ALL), p AS (SELECT family, node, n AS s, n AS e, w FROM m), c AS ({Q._islands('p', 'family, node', 20, 'sum(w) AS k, floor(sum(s * w) / sum(w) + 0.5)::BIGINT AS centre')})",
        "SELECT family, node, centre AS length, k::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY family, node ORDER BY k DESC, centre) = 1",
    )
)
def length_consensus(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nodes").where("chrom IS NOT NULL AND bdstart IS NOT NULL AND strand IS NOT NULL AND node_idx IS NOT NULL AND start < end")
    x = x.select(F.concat("chrom", F.lit(":"), "bdstart", "strand").alias("family"), F.col("node_idx").alias("node"), (F.col("end") - F.col("start")).alias("length"))
    return A.length_consensus(x)


@R.query(
    W(
        Q.REGION + ", p AS (SELECT *, count(*) OVER (PARTITION BY read_name, chrom) AS c, sum(s) OVER (PARTITION BY read_name, chrom) - s AS m FROM reg WHERE read_name IS NOT NULL)",
        "SELECT x.region_start AS \"group\", y.region_start AS mate_group, count(*) AS n FROM p x JOIN p y ON x.read_name = y.read_name AND x.chrom = y.chrom AND x.c = 2 AND y.c = 2 AND x.s = y.m AND y.s = x.m AND (x.s < y.s OR (x.s = y.s AND x.row_id < y.row_id)) GROUP BY ALL",
    )
)
def local_pair_links(spark: SparkSession, d: str) -> DataFrame:
    """Mates by the starts of the regions they lie in."""
    g = cut(RG.regions(lifts.reads(spark, d), ["chrom"])).select("row_id", F.col("region_start").alias("group"))
    return A.local_pair_links(PS.mate_pairs(spark, d), g)


# guides, rescue and copies -----------------------------------------------------------------------------------


@R.query(
    W(
        Q.TWO + f", st AS (SELECT {JK}, count(*) AS m FROM junc WHERE acceptor - donor >= 20 AND ({Q._RUN}) = 0 GROUP BY ALL), "
        + f"""g AS (SELECT tx_id, chrom, strand, len(chain) AS n, u.i AS i, chain[u.i].d AS d, chain[u.i].a AS a FROM tb, LATERAL (SELECT unnest(range(1, len(chain) + 1)) AS i) u),
b AS (SELECT x.tx_id, x.n, x.i, y.donor, y.acceptor FROM g x JOIN st y ON {SAME} AND abs(x.d - y.donor) <= 500 AND abs(x.a - y.acceptor) <= 500 QUALIFY row_number() OVER (PARTITION BY x.tx_id, x.i ORDER BY abs(x.d - y.donor) + abs(x.a - y.acceptor), y.m DESC, y.donor, y.acceptor) = 1)""",
        "SELECT tx_id, string_agg(donor || '-' || acceptor, ',' ORDER BY i) AS chain FROM b GROUP BY tx_id, n HAVING count(*) = n",
    )
)
def guide_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Chains of one sample as guides, led to the junctions of the other within 500 bases."""
    a, b = lifts.halves(lifts.reads(spark, d))
    x = A.snapped_guides(lifts.chain_transcripts(b), J.junction_stats(a), 500)
    return x.select("tx_id", F.array_join(F.transform("chain", lambda j: F.concat_ws("-", j["donor"], j["acceptor"])), ",").alias("chain"))


@R.query(W(Q.READS, "SELECT row_id, round(CASE WHEN row_id % 4 > 0 THEN least(row_id % 5, len(ex)) / len(ex) * (1 + 0.1 * ln(row_id % 4)) ELSE 0 END, 6) AS fit FROM reads"))
def graph_fit(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility of reads with a graph (matched exons and path length drawn from row_id)."""
    n = F.size("exons")
    fit = A.graph_compatibility(F.least(F.col("row_id") % 5, n), n, F.col("row_id") % 4)
    return lifts.reads(spark, d).select("row_id", F.round(fit, 6).alias("fit"))


@R.query(
    W(
        PS.MEMBERS + "," + Q.FLOW + ", p AS (SELECT DISTINCT chrom || ':' || bdstart || strand AS family, array_to_string(p, ',') AS path, p FROM flow WHERE bdstart IS NOT NULL AND strand IS NOT NULL), m AS (SELECT DISTINCT family, copy, node FROM mb), s AS (SELECT family, copy, count(*) AS n FROM m GROUP BY ALL), k AS (SELECT x.family, x.path, m.copy, count(*) AS k FROM (SELECT DISTINCT family, path, unnest(p) AS node FROM p) x JOIN m ON x.family = m.family AND x.node = m.node GROUP BY ALL)",
        "SELECT family || '/' || path AS pid, copy FROM k JOIN s USING (family, copy) QUALIFY row_number() OVER (PARTITION BY family, path ORDER BY k / n DESC, k DESC, copy) = 1",
    )
)
def copy_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Flow paths of a place given to the run (as copy) whose nodes they cover best."""
    x = lifts.flow_paths(spark, d).where("bdstart IS NOT NULL AND strand IS NOT NULL")
    p = x.select(F.concat("chrom", F.lit(":"), "bdstart", "strand").alias("family"), "path").distinct()
    p = p.withColumn("pid", F.concat_ws("/", "family", F.array_join(F.col("path").cast("array<string>"), ",")))
    return A.assigned_copies(p, PS._members(spark, d), "pid")


@R.query("SELECT row_id AS exon_id, min(row_id) OVER (PARTITION BY chrom, bdstart, node_idx % 2) AS part FROM nodes WHERE chrom IS NOT NULL AND bdstart IS NOT NULL AND node_idx IS NOT NULL")
def minimizer_parts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a place split by their letters, which follow place and parity."""
    from splicelake.operators.families import split_by_minimizers
    from splicelake.plans.alignments import _letters

    n = table(spark, d, "nodes").where("chrom IS NOT NULL AND bdstart IS NOT NULL AND node_idx IS NOT NULL")
    key = F.concat_ws(":", "chrom", "bdstart")
    x = n.select(key.alias("node"), F.col("row_id").alias("exon_id"), _letters(F.concat_ws("/", key, F.col("node_idx") % 2)).alias("seq"))
    return split_by_minimizers(x).select("exon_id", "part")


@R.query(
    W(
        PA.NAMES + "," + PA.KMERS,
        "SELECT family, family AS path, count(*) AS n_reads, round(avg(hits), 6) AS loglik FROM (SELECT read, family, hits FROM h WHERE hits >= 3 QUALIFY row_number() OVER (PARTITION BY read ORDER BY hits DESC, family) = 1) GROUP BY family HAVING count(*) >= 3",
    )
)
def rescued_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Rescue end to end: reads matched to families by k-mers, scored (here by hits), and bundles made of them."""
    from splicelake.operators.families import synthesize_bundles

    x = PA.novel_reads(spark, d).select("family", F.col("family").alias("path"), F.col("hits").cast("double").alias("loglik"))
    return synthesize_bundles(x).withColumn("loglik", F.round("loglik", 6))
